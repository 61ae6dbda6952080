"""Hard negatives by a vector-approximation file.

Vectors become integers, floor(256 * x) per component with x as double, and the score of two rows is their integer inner product. An anchor's
positives are its best other rows of the same label; for each positive, the hard negatives are the best rows of another label whose score lies in a
window below the positive's.

Rows are dealt into blocks, a block's rows lie in one task, and every anchor passes every block. In a block each dimension is quantised into cells of
about equally many rows, one byte a component, with the least and greatest value of each cell. For an anchor, a table of dimensions x cells holds the
least and greatest product, so two lookups per component give a lower and an upper bound of each row's score. Only rows whose bounds allow them to
enter a window, and whose upper bound reaches the best lower bounds inside it, are scored exactly. A block returns at most `positives` or `negatives`
rows for an anchor and window, which a ranking with partial limits merges; the cells change the work, never the result.

Rows with a null label, a null vector, or any null or non-finite component take no part; neither do rows without vec_id, nor vectors whose integer form
has a square sum of 2**57 or more (their scores do not fit a long). Zero and empty vectors score 0. Vectors of different lengths do not meet. Rows equal in
vec_id, label and integer vector count once; other rows that share a vec_id are rows of their own. Ties go to the smaller vec_id, then to a hash of the row.
An empty table gives an empty result. Only vec_id, embedding and label are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from advertlake.llm.common import shuffle_partitions, written
from advertlake.llm.vectors import lengths, matrix

CELLS, CHUNK = 64, 8192
_SCORED = "id long, row long, positive int, positive_id long, positive_score long, score long, vec_id long, other long"


def integers(vectors: DataFrame) -> DataFrame:
    """(id, label, q, n, row) of the rows that take part: q the integer vector, n its length, row a hash that tells rows of one id apart."""
    inf = float("inf")
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < inf))
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.pow(F.floor(256 * x.cast("double")).cast("double"), 2))
    rows = vectors.filter("vec_id is not null and label is not null and embedding is not null").filter(good).filter(square < float(1 << 57))
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("int")).alias("q"))
    rows = rows.withColumn("row", F.xxhash64("id", "label", "q")).dropDuplicates(["id", "row"])
    return rows.withColumn("n", F.size("q"))


class Approximation:
    """The cells of a block's rows, sorted by label; q is their integer matrix."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, q: np.ndarray, cells: int = CELLS):
        order = np.lexsort((rows, ids, labels))
        self.ids, self.rows, self.labels, self.q = ids[order], rows[order], labels[order], q[order]
        n, dim = q.shape
        self.least, self.most = np.zeros((dim, cells)), np.zeros((dim, cells))
        self.at = np.empty((n, dim), np.int32)  # the cell's place in a table of dim * cells
        for d in range(dim):
            by_size = np.sort(self.q[:, d])
            edges = np.unique(by_size[np.arange(1, cells) * n // cells])
            self.at[:, d] = np.searchsorted(edges, self.q[:, d], side="right") + d * cells
            first = np.concatenate(([0], np.searchsorted(by_size, edges, side="left")))
            last = np.append(first[1:], n) - 1
            used = first <= last
            self.least[d, : len(first)][used] = by_size[first[used]]
            self.most[d, : len(first)][used] = by_size[last[used]]

    def bounds(self, anchor: np.ndarray, part: slice) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of the rows of a slice. The tables are in double precision; the slack covers its rounding."""
        a, b = self.least * anchor[:, None], self.most * anchor[:, None]
        low, high = np.minimum(a, b), np.maximum(a, b)
        slack = 1e-12 * np.maximum(np.abs(low), np.abs(high)).max(axis=1, initial=0.0).sum()
        at = self.at[part]
        return low.ravel().take(at).sum(axis=1) - slack, high.ravel().take(at).sum(axis=1) + slack

    def scores(self, anchor: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.q[at].astype(np.int64) @ anchor.astype(np.int64)

    def label_range(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.labels, label)), int(np.searchsorted(self.labels, label, side="right"))

    def best(self, at: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The first k rows of `at` by score, then vec_id, then row."""
        if len(at) > k:
            some = scores >= np.partition(scores, -k)[-k]
            at, scores = at[some], scores[some]
        order = np.lexsort((self.rows[at], self.ids[at], -scores))[:k]
        return at[order], scores[order]

    def positives(self, id_: int, row: int, label: int, anchor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The anchor's best k other rows of its label."""
        a, z = self.label_range(label)
        at, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for lo in range(a, z, CHUNK):
            part = slice(lo, min(z, lo + CHUNK))
            low, high = self.bounds(anchor, part)
            other = (self.ids[part] != id_) | (self.rows[part] != row)
            sure = np.concatenate([low[other], scores.astype(float)])
            reach = np.partition(sure, -k)[-k] if len(sure) >= k else -np.inf
            new = lo + np.flatnonzero(other & (high >= reach))
            at, scores = self.best(np.concatenate([at, new]), np.concatenate([scores, self.scores(anchor, new)]), k)
        return at, scores

    def negatives(self, label: int, anchor: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window of scores [from, to], the best k rows of other labels in it."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
        a, z = self.label_range(label)
        for lo, hi in ((0, a), (z, len(self.ids))):
            for start in range(lo, hi, CHUNK):
                part = slice(start, min(hi, start + CHUNK))
                low, high = self.bounds(anchor, part)
                maybe = np.zeros(len(low), bool)
                for (least, most), (_, known) in zip(windows, found, strict=True):
                    if least <= most:
                        inside = np.concatenate([low[(low >= least) & (high <= most)], known.astype(float)])
                        reach = np.partition(inside, -k)[-k] if len(inside) >= k else -np.inf
                        maybe |= (high >= max(least, reach)) & (low <= most)
                new = start + np.flatnonzero(maybe)
                scores = self.scores(anchor, new)
                for w, ((least, most), (at, known)) in enumerate(zip(windows, found, strict=True)):
                    own = (scores >= least) & (scores <= most)
                    found[w] = self.best(np.concatenate([at, new[own]]), np.concatenate([known, scores[own]]), k)
        return found


def _passes(rows: DataFrame, anchors: DataFrame, blocks: int, answer) -> DataFrame:
    """Every anchor past every block: a block's rows come first in its task, then the anchors, batch by batch. answer(block, anchor row) gives rows of _SCORED."""
    block = F.pmod(F.xxhash64("id", "row"), F.lit(blocks)).cast("int")
    own = rows.select(block.alias("block"), F.lit(0).alias("kind"), "id", "row", "label", "q")
    more = [c for c in ("ps", "pi") if c in anchors.columns]
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "id", "row", "label", "q", *more)
    both = own.unionByName(asked, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "kind")

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, built = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column("block").to_numpy().astype(np.int64) * 2 + b.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                t, (own_block, kind) = b.slice(lo, hi - lo), divmod(int(key[lo]), 2)
                if own_block != now:
                    now, held, built = own_block, [], None
                if kind == 0:
                    held.append(t)
                elif held or built:
                    if built is None:
                        whole = pa.Table.from_batches(held)
                        built, held = Approximation(*(whole[c].to_numpy() for c in ("id", "row", "label")), _matrix(whole["q"])), []
                    yield _answers(built, t, answer)

    return both.mapInArrow(passed, _SCORED)


def _matrix(column) -> np.ndarray:
    m = matrix(column)
    return m if m.size else np.zeros((len(column), 0), np.int32)


def _answers(built: Approximation, t: pa.RecordBatch, answer) -> pa.RecordBatch:
    asked = t.select([c for c in ("id", "row", "label", "ps", "pi") if c in t.schema.names]).to_pylist()
    out = [x for one, q in zip(asked, _matrix(t.column("q")), strict=True) for x in answer(built, one, q)]
    cols = list(zip(*out, strict=True)) or [()] * 8
    types = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], [x.split()[0] for x in _SCORED.split(", ")])


def _first(scored: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id", "other")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchor: Column | None = None, positives: int = 5, negatives: int = 3, low: tuple[int, int] = (1, 2), high: tuple[int, int] = (19, 20), block_rows: int = 1 << 17) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row where `anchor` holds (a condition on id; by default, divisible
    by 50) and each of its positives, the first negatives with low * positive_score <= negative_score <= high * positive_score (fractions, compared
    exactly)."""
    rows = written(integers(vectors))
    anchor = F.col("id") % 50 == 0 if anchor is None else anchor

    def near(block: Approximation, one: dict, q: np.ndarray):
        at, scores = block.positives(one["id"], one["row"], one["label"], q, positives)
        return [(one["id"], one["row"], None, None, None, s, i, r) for s, i, r in zip(scores.tolist(), block.ids[at].tolist(), block.rows[at].tolist(), strict=True)]

    def hard(block: Approximation, one: dict, q: np.ndarray):
        windows = [(-(-p * low[0] // low[1]), p * high[0] // high[1]) for p in one["ps"]]
        out = []
        for k, (at, scores) in enumerate(block.negatives(one["label"], q, windows, negatives)):
            out += [(one["id"], one["row"], k, one["pi"][k], one["ps"][k], s, i, r) for s, i, r in zip(scores.tolist(), block.ids[at].tolist(), block.rows[at].tolist(), strict=True)]
        return out

    parts = []
    for n in lengths(rows):
        own = rows.filter(F.col("n") == n)
        count = own.count()
        blocks = max(1, -(-count // block_rows), min(shuffle_partitions(rows.sparkSession), count >> 10))
        asked = own.filter(anchor)
        kept = _first(_passes(own, asked, blocks, near), positives, "id", "row")
        best = kept.groupBy("id", "row").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "vec_id"))).alias("p"))  # at most `positives` entries
        asked = written(asked.join(best, ["id", "row"]).select("id", "row", "label", "q", F.col("p.score").alias("ps"), F.col("p.vec_id").alias("pi")))
        parts.append(_first(_passes(own, asked, blocks, hard), negatives, "id", "row", "positive"))
    names = {"id": "anchor_id", "positive_id": "positive_id", "rank": "rank", "vec_id": "negative_id", "positive_score": "positive_score", "score": "negative_score"}
    if not parts:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.unionByName, parts).select(*[F.col(a).alias(b) for a, b in names.items()])
