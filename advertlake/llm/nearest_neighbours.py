"""Approximate nearest neighbours: a forest of random-projection trees, searched through one priority queue, leaves reranked exactly.

Trees are fitted on a sample of at most SAMPLE distinct vectors (a documented bound); every vector is indexed. The levels of a tree split along
orthonormal random directions, each node at the sample's median, so the squared margins of the wrong turns on the way to a leaf add up to a lower
bound of the squared distance to it. A query walks all trees through one priority queue by that bound. How many leaves it reads is measured on the
sample: the fewest that find TARGET of the true neighbours of CALIBRATION sample vectors. Vectors in clusters need few leaves, vectors without any
structure many; a table larger than its sample has nearer neighbours than the sample, so the number is on the safe side there.

Leaves read are reranked by exact distance in double precision, and the best of all leaves are the answer. Neighbouring leaves share a unit of
work, so a vector is sent once per tree and a query once per unit, with a bit for each leaf that it reads; a unit holds about CHUNK points, larger
leaves are dealt into chunks, and queries are streamed past the points. Equal vectors are one point of the index with its k + 1 smallest ids, so
copies cost nothing and ties go to the smaller id.

Vectors that are null, zero or hold null or non-finite components take no part, rows without vec_id neither. Vectors are searched among those of
their own length. Rows that repeat a vec_id count once (with different vectors: the one whose hash is smaller). An empty table gives an empty
result. Only vec_id and embedding are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from advertlake.llm.common import written
from advertlake.llm.vectors import key, lengths, lists, matrix, runs, usable

TREES, SAMPLE, LEAF, CHUNK, ASKED = 4, 16384, 16, 4096, 1 << 16
TARGET, CALIBRATION = 0.96, 96


class Forest:
    """Trees fitted on a sample; `read` is the number of leaves that a query reads."""

    def __init__(self, sample: np.ndarray, k: int = 10, trees: int = TREES, target: float = TARGET, seed: int = 5):
        rng = np.random.default_rng(seed)
        sample = sample.astype(np.float64)
        n, dim = sample.shape
        self.depth = max(0, min(int(np.log2(max(1, n / LEAF))), dim))
        self.leaves = 1 << self.depth
        self.w = np.stack([np.linalg.qr(rng.standard_normal((dim, dim)))[0][: self.depth] for _ in range(trees)])
        self.b = np.zeros((trees, self.leaves))  # node 0 is not used, the root is 1
        for t in range(trees):
            node = np.ones(n, np.int64)
            for level, p in enumerate(self.w[t] @ sample.T):
                order = np.argsort(node, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
                    self.b[t, node[own[0]]] = np.median(p[own])
                node = 2 * node + (p > self.b[t, node])
        self.read = self._reads(sample, k, target, rng)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaf of each row in each tree."""
        out = np.empty((len(x), len(self.w)), np.int64)
        for t, (w, b) in enumerate(zip(self.w, self.b, strict=True)):
            node = np.ones(len(x), np.int64)
            for p in w @ x.astype(np.float64).T:
                node = 2 * node + (p > b[node])
            out[:, t] = node - self.leaves
        return out

    def search(self, q: np.ndarray) -> Iterator[tuple[int, int]]:
        """(tree, leaf) in the order of one priority queue over all trees."""
        along = (self.w @ q.astype(np.float64)).tolist()
        split = self.b
        queue = [(0.0, t, 1, 0) for t in range(len(along))]
        while queue:
            bound, t, node, level = heapq.heappop(queue)
            for p in along[t][level:]:
                level += 1
                m = p - split[t, node]
                heapq.heappush(queue, (bound + m * m, t, 2 * node + int(m <= 0), level))
                node = 2 * node + int(m > 0)
            yield t, node - self.leaves

    def _reads(self, sample: np.ndarray, k: int, target: float, rng: np.random.Generator) -> int:
        """The fewest leaves that find the share `target` of the k nearest of some sample vectors."""
        total = len(self.w) * self.leaves
        if len(sample) < 2:
            return total
        asked = np.sort(rng.choice(len(sample), min(CALIBRATION, len(sample)), replace=False))
        leaf = self.leaf_of(sample)
        found = []
        for i in asked:
            d = ((sample - sample[i]) ** 2).sum(1)
            d[i] = np.inf
            near = np.argsort(d, kind="stable")[: min(k, len(sample) - 1)]
            left = set(near.tolist())
            for done, (t, f) in enumerate(self.search(sample[i]), 1):
                hit = [j for j in left if leaf[j, t] == f]
                found += [done] * len(hit)
                left.difference_update(hit)
                if not left:
                    break
        found.sort()
        return min(total, found[min(len(found) - 1, int(np.ceil(target * len(found))) - 1)])


def neighbours(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """For each usable row whose vec_id is divisible by `every`: query_id, rank (from 1), vec_id and score (Euclidean distance) of its k nearest found."""
    rows = usable(vectors.select("vec_id", "embedding")).withColumn("key", key())
    parts = [_of_one_length(rows.filter(F.col("n") == n), k, every) for n in lengths(rows)]
    if not parts:
        empty = rows.limit(0)
        return empty.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    return reduce(DataFrame.unionByName, parts)


def _of_one_length(rows: DataFrame, k: int, every: int) -> DataFrame:
    one = written(rows.groupBy("id").agg(F.min("key").alias("key")))
    place = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    first = one.withColumn("r", place).filter(F.col("r") <= k + 1).groupBy("key").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids"))
    first = written(first)
    found = rows.select("id", "key", "v").join(first.select(F.col("rep").alias("id"), "key"), ["id", "key"])
    points = written(found.dropDuplicates(["id", "key"]).select("id", "v"))
    asked = written(one.filter(F.col("id") % every == 0).join(first.select("key", "rep"), "key").select(F.col("id").alias("query_id"), F.col("rep").alias("q")))
    n, questions = points.count(), asked.select("q").distinct().count()
    picked = points.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()
    forest = Forest(matrix(picked["v"]), k)
    in_leaf = n / forest.leaves
    shared = int(np.clip(np.log2(max(1.0, CHUNK / in_leaf)), 0, min(6, forest.depth)))  # bits: 2 ** shared leaves are one unit
    chunks = max(1, round(in_leaf * 2**shared / CHUNK))
    slices = max(1, -(-questions // ASKED))

    def unit_of(t, leaf, chunk, part):
        return (((t * forest.leaves + leaf) >> shared) * chunks + chunk) * slices + part

    def packed(unit, kind, bits, ids, vs) -> pa.RecordBatch:
        cols = [pa.array(unit, pa.int64()), pa.array(np.full(len(unit), kind), pa.int32()), pa.array(bits, pa.int64()), pa.array(ids, pa.int64()), lists(vs)]
        return pa.RecordBatch.from_arrays(cols, ["unit", "kind", "bits", "id", "v"])

    def index(batches):
        for b in batches:
            if b.num_rows:
                ids, x = b.column("id").to_numpy(), matrix(b.column("v"))
                for t, leaf in enumerate(forest.leaf_of(x).T):
                    for part in range(slices):
                        yield packed(unit_of(t, leaf, ids % chunks, part), 0, leaf & ((1 << shared) - 1), ids, x)

    def probe(batches):
        for b in batches:
            ids, x = b.column("id").to_pylist(), matrix(b.column("v"))
            for i, q in zip(ids, x, strict=True):
                masks: dict[int, int] = {}
                for _, (t, leaf) in zip(range(forest.read), forest.search(q), strict=False):
                    for c in range(chunks):
                        u = unit_of(t, leaf, c, i % slices)
                        masks[u] = masks.get(u, 0) | 1 << (leaf & ((1 << shared) - 1))
                bits = np.array(list(masks.values()), np.uint64).view(np.int64)
                yield packed(list(masks), 1, bits, np.full(len(masks), i), np.repeat(q[None], len(masks), 0))

    def rerank(batches):
        unit, held, own = None, [], None
        for u, part in runs(batches):
            if u != unit:
                unit, held, own = u, [], None
            kind = part.column("kind").to_numpy()
            at = int(np.searchsorted(kind, 1))
            if at:
                held.append(part.slice(0, at))
            if at == len(part) or not held:
                continue
            if own is None:
                t = pa.Table.from_batches(held)
                own = t["id"].to_numpy(), matrix(t["v"]).astype(np.float64), np.uint64(1) << t["bits"].to_numpy().astype(np.uint64)
            got = _best(own, part.slice(at), k + 1)
            if got:
                yield got

    schema = f"unit long, kind int, bits long, id long, v {points.schema['v'].dataType.simpleString()}"
    met = points.mapInArrow(index, schema).unionByName(points.join(asked.select(F.col("q").alias("id")).distinct(), "id").mapInArrow(probe, schema))
    dealt = met.repartition("unit").sortWithinPartitions("unit", "kind")
    best = dealt.mapInArrow(rerank, "q long, rep long, score double").groupBy("q", "rep").agg(F.min("score").alias("score"))
    near = Window.partitionBy("q").orderBy("score", "rep")
    best = written(best.withColumn("r", F.row_number().over(near)).filter(F.col("r") <= k + 1).drop("r"))
    named = best.join(first.select("rep", "ids"), "rep").select("q", "score", F.explode("ids").alias("vec_id"))
    rank = Window.partitionBy("query_id").orderBy("score", "vec_id")
    out = asked.join(named, "q").filter("vec_id <> query_id").withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def _best(own: tuple[np.ndarray, np.ndarray, np.ndarray], asked: pa.RecordBatch, k: int) -> pa.RecordBatch | None:
    """(q, rep, score): the k nearest points, by exact distance, in the leaves that each query reads."""
    ids, x, leaf = own
    q, v, mask = asked.column("id").to_numpy(), matrix(asked.column("v")).astype(np.float64), asked.column("bits").to_numpy().view(np.uint64)
    out = []
    for i in range(len(q)):
        seen = np.flatnonzero(leaf & mask[i])
        with np.errstate(over="ignore"):
            d = np.sqrt(((x[seen] - v[i]) ** 2).sum(axis=1))
        if len(d) > k:
            few = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
            seen, d = seen[few], d[few]
        order = np.lexsort((ids[seen], d))[:k]
        out.append((np.full(len(order), q[i]), ids[seen[order]], d[order]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["q", "rep", "score"]) if out else None
