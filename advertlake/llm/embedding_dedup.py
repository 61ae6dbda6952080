"""Near-duplicate vectors of equal label by cosine: a subspace pigeonhole join.

Unit vectors with cosine >= c lie within squared distance D = 2 - 2c. A random rotation is cut into blocks of BLOCK dimensions, and each block
gets its share of D: a pair within D is within the share in one block at least. Each block is a range join: a tree over the block's principal
directions, split at the medians of a bounded sample, deals vectors into cells; a vector is at home in one cell and probes the cells of smaller
number that its ball reaches, so each pair of a block meets once. Pairs within the block's budget, and within that of no earlier block, are
verified by their cosine in double precision on the original vectors. The depth of the trees weighs copies against comparisons on the sample
(none for small labels, more as labels grow); it changes the work, not the result. Cells with more than TILE points are dealt into tiles that
meet pair by pair, so no group has to fit one task.

A unit of work returns a row per linked vector: how many links it has there, and the smallest vector that the unit's links connect it with. So a
group of n near copies gives about n rows, though all its n * n links count. Equal vectors are one point with a multiplicity.

Vectors that are null, zero or hold null or non-finite components, and rows without a label, link with nothing; vectors of different lengths do
not link; a row without vec_id has no component and is not kept. Rows that repeat a vec_id count as vectors of their own, each with its own n_links;
what links to one of them has the id in its component. An empty table gives an empty result. Only vec_id, embedding and label are read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from advertlake.llm.common import connected_components, spread_join, written
from advertlake.llm.vectors import groups, key, lengths, marked, matrix, scaled

BLOCK, TILE, SAMPLE, DEEPEST = 8, 4096, 4096, 16
#: Cost of sending a vector once more, in comparisons of one block.
COPY = 4000


class Blocks:
    """The rotation, its blocks and their trees, fitted on a sample; `per_label` is the mean number of vectors that a vector shares its label with."""

    def __init__(self, sample: np.ndarray, cosine: float, per_label: float, seed: int = 3):
        dim = sample.shape[1]
        self.rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0]
        self.bounds = [*range(0, dim, BLOCK), dim]
        far = 2 - 2 * cosine
        self.budget = np.array([far * (z - a) / dim for a, z in zip(self.bounds[:-1], self.bounds[1:], strict=True)]) * (1 + 1e-9) + 1e-12
        for a, z in zip(self.bounds[:-1], self.bounds[1:], strict=True):  # principal directions of the block first
            u = self.turned(sample)[:, a:z]
            self.rotation[:, a:z] = self.rotation[:, a:z] @ np.linalg.eigh(u.T @ u - len(u) * np.outer(u.mean(0), u.mean(0)))[1][:, ::-1]
        self.depth = 0
        turned = self.turned(sample)
        self.trees = [self._tree(turned[:, a:z]) for a, z in zip(self.bounds[:-1], self.bounds[1:], strict=True)]
        some = turned[:: max(1, len(turned) // 256)]
        cost = []
        for self.depth in range(int(min(DEEPEST, np.log2(max(1, len(sample) / 8)))) + 1):
            copies = pairs = 0.0
            for b in range(len(self)):
                share = np.bincount(self.homes(turned, b), minlength=1 << self.depth) / len(turned)
                own, cell = self.cells(some, b)
                copies += len(cell) / len(some)
                pairs += share[cell].sum() / len(some)
            cost.append(copies * COPY + pairs * per_label)
            if cost[-1] > 3 * min(cost):
                break
        self.depth = int(np.argmin(cost))

    def __len__(self) -> int:
        return len(self.budget)

    def turned(self, x: np.ndarray) -> np.ndarray:
        u = scaled(x)
        return (u / np.linalg.norm(u, axis=1, keepdims=True)) @ self.rotation

    @staticmethod
    def _tree(u: np.ndarray) -> np.ndarray:
        """The median of each node (the root is 1) along the direction of its level; the levels take the directions in turn."""
        deepest = int(min(DEEPEST, np.log2(max(1, len(u) / 8))))
        at, split = np.ones(len(u), np.int64), np.zeros(1 << deepest)
        for level in range(deepest):
            p = u[:, level % u.shape[1]]
            order = np.argsort(at, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                split[at[own[0]]] = np.median(p[own])
            at = 2 * at + (p > split[at])
        return split

    def homes(self, u: np.ndarray, b: int) -> np.ndarray:
        a, z = self.bounds[b], self.bounds[b + 1]
        at = np.ones(len(u), np.int64)
        for level in range(self.depth):
            at = 2 * at + (u[:, a + level % (z - a)] > self.trees[b][at])
        return at - (1 << self.depth)

    def cells(self, u: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell): the home of each row, and the cells of smaller number that its ball reaches in block b."""
        a, z = self.bounds[b], self.bounds[b + 1]
        row, node, gap = np.arange(len(u)), np.ones(len(u), np.int64), np.zeros((len(u), z - a))
        for level in range(self.depth):
            c = level % (z - a)
            m = u[row, a + c] - self.trees[b][node]
            other = gap.copy()
            other[:, c] = np.maximum(other[:, c], np.abs(m))
            near = (other**2).sum(1) <= self.budget[b]
            row, gap = np.concatenate([row, row[near]]), np.concatenate([gap, other[near]])
            node = np.concatenate([2 * node + (m > 0), (2 * node + (m <= 0))[near]])
        cell = node - (1 << self.depth)
        lower = cell <= self.homes(u, b)[row]
        return row[lower], cell[lower]

    def near(self, left: np.ndarray, right: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j) of rows whose block b is within its budget and no block before it."""
        a, z = self.bounds[b], self.bounds[b + 1]
        x, y = left[:, a:z].astype(np.float32), right[:, a:z].astype(np.float32)
        d = x @ (y.T * np.float32(-2))
        d += (x * x).sum(1)[:, None]
        d += (y * y).sum(1)[None]
        i, j = np.nonzero(d <= self.budget[b] + 1e-5)
        if len(i):
            by = np.add.reduceat((left[i] - right[j]) ** 2, self.bounds[:-1], axis=1) <= self.budget
            first = by[:, b] & ~by[:, :b].any(axis=1)
            i, j = i[first], j[first]
        return i, j


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that the pairs connect each of n rows with: rows take the least root of their neighbours, then that root's root."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        for side in (i, j):
            np.minimum.at(root, before[side], low)
            np.minimum.at(root, side, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def links(points: DataFrame, blocks: Blocks, cosine: float) -> DataFrame:
    """(node, n, id, root) per unit of work and linked point (id, node, label, v, m): its links there, by multiplicity, and the id of a point that
    they connect it with."""

    def unit_of(label: np.ndarray, b: int, cell: np.ndarray) -> np.ndarray:
        u = (label.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64((b + 1) * 0xBF58476D1CE4E5B9 % (1 << 64))
        u = (u ^ (u >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) + cell.astype(np.uint64)
        return ((u ^ (u >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)

    def homes(batches):
        for batch in batches:
            if batch.num_rows:
                u, label = blocks.turned(matrix(batch.column("v"))), batch.column("label").to_numpy()
                for b in range(len(blocks)):
                    yield pa.RecordBatch.from_arrays([pa.array(unit_of(label, b, blocks.homes(u, b)))], ["unit"])

    def copies(batches):
        for batch in batches:
            if batch.num_rows:
                u, label = blocks.turned(matrix(batch.column("v"))), batch.column("label").to_numpy()
                for b in range(len(blocks)):
                    row, cell = blocks.cells(u, b)
                    home = (cell == blocks.homes(u, b)[row]).astype(np.int32)
                    new = [pa.array(unit_of(label[row], b, cell)), pa.array(np.full(len(row), b, np.int32)), pa.array(home)]
                    own = [batch.column(c).take(pa.array(row)) for c in ("id", "node", "label", "v", "m")]
                    yield pa.RecordBatch.from_arrays([*new, *own], ["unit", "block", "home", "id", "node", "label", "v", "m"])

    sizes = points.mapInArrow(homes, "unit long").groupBy("unit").count()
    large = written(sizes.filter(F.col("count") > TILE).select("unit", F.ceil(F.col("count") / TILE).cast("int").alias("tiles")))
    kind = points.schema["v"].dataType.simpleString()
    rows = points.mapInArrow(copies, f"unit long, block int, home int, id long, node long, label long, v {kind}, m long")
    rows = rows.join(large, "unit", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = F.when(F.col("home") == 1, F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).otherwise(-1)
    meets = F.when(F.col("tiles") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.greatest(F.col("own"), F.lit(0)), F.col("tiles") - 1))
    rows = rows.withColumn("own", own).withColumn("tile", F.explode(meets)).withColumn("build", (F.col("own") == F.col("tile")).cast("int"))
    rows = rows.withColumn("unit", F.when(F.col("tile") == 0, F.col("unit")).otherwise(F.xxhash64("unit", "tile"))).drop("tiles", "own", "home")

    def verify(batches):
        for _, t in groups(batches):
            if len(t) < 2:
                continue
            tag = np.stack([t["block"].to_numpy(), t["label"].to_numpy(), t["tile"].to_numpy()], 1)
            for one in np.unique(tag, axis=0):  # one, unless two units share a hash
                s = t.take(pa.array(np.flatnonzero((tag == one).all(1))))
                x = scaled(matrix(s["v"]))
                got = _linked(blocks, int(one[0]), s["build"].to_numpy() == 1, x, s["m"].to_numpy(), cosine)
                if got is not None:
                    who, n, root = got
                    ids, node = s["id"].to_numpy(), s["node"].to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array(node[who]), pa.array(n), pa.array(ids[who]), pa.array(ids[root])], ["node", "n", "id", "root"])

    return rows.repartition("unit").sortWithinPartitions("unit", "id").mapInArrow(verify, "node long, n long, id long, root long")


def _linked(blocks: Blocks, b: int, build: np.ndarray, x: np.ndarray, m: np.ndarray, cosine: float):
    """(row, links, row that it is connected with) of the linked rows of a unit: its build rows meet each other and the rest."""
    u, size = blocks.turned(x), np.sqrt((x * x).sum(1))
    at, other = np.flatnonzero(build), np.flatnonzero(~build)
    n, root = np.zeros(len(x), np.int64), np.arange(len(x))
    for start in range(0, len(at), 512):
        left, right = at[start : start + 512], np.concatenate([at[start:], other])
        for lo in range(0, len(right), 4096):
            part = right[lo : lo + 4096]
            i, j = blocks.near(u[left], u[part], b)
            i, j = left[i], part[j]
            ok = (i < j) | ~build[j]
            for some in np.array_split(np.flatnonzero(ok), max(1, int(ok.sum()) >> 18)):
                p, q = i[some], j[some]
                yes = np.einsum("ij,ij->i", x[p], x[q]) / (size[p] * size[q]) >= cosine
                p, q = p[yes], q[yes]
                np.add.at(n, p, m[q])
                np.add.at(n, q, m[p])
                if len(p):
                    root = _roots(len(x), np.concatenate([p, np.arange(len(x))]), np.concatenate([q, root]))
    who = np.flatnonzero(n)
    return (who, n[who], root[who]) if len(who) else None


def near_duplicates(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """Per row: vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable, itself included) and kept (vec_id = component_id)."""
    whole = marked(vectors.select("vec_id", "embedding", "label"))
    whole = whole.withColumn("key", F.when(F.col("v").isNotNull() & F.col("label").isNotNull(), key("label")))
    rows, brief = whole.filter("key is not null"), whole.select("id", "key")
    per = written(rows.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("m")))
    heads = per.select(F.col("rep").alias("id"), "key", "m")
    points = rows.join(heads, ["id", "key"]).dropDuplicates(["id", "key"]).withColumn("node", F.xxhash64("key"))
    points = written(points.select("id", "node", "n", "label", "v", "m"))
    parts = []
    for n in lengths(points):
        own = points.filter(F.col("n") == n).drop("n")
        each = own.groupBy("label").count().agg(F.sum(F.col("count") * F.col("count")) / F.sum("count")).first()[0]
        sample = own.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()
        parts.append(written(links(own, Blocks(matrix(sample["v"]), cosine, each), cosine)))
    known = per.withColumn("node", F.xxhash64("key"))
    if parts:
        got = reduce(DataFrame.unionByName, parts)
        group = connected_components(got.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
        known = known.join(got.groupBy("node").agg(F.sum("n").alias("n")), "node", "left").join(group, "rep", "left")
    else:
        known = known.withColumns({"n": F.lit(0), "component": F.col("rep")})
    known = known.select("key", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = spread_join(brief, known.filter("n_links > 0"), "key")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept")
    )
