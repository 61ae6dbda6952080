"""Vector operators on odd rows, on groups larger than a tile, with deep trees, and the forest's recall against its reads."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from advertlake.llm import common
from advertlake.llm import embedding_dedup as E
from advertlake.llm import nearest_neighbours as N

SCHEMA = "vec_id long, embedding array<double>, label int, id long, v string, key int, n_links string, rep long"


def _table(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash", 2, "clash", 3) for r in rows], SCHEMA)


def test_lengths_doubles_ties_and_repeated_ids(spark):
    rows = [
        (0, [1e300, 1.0], 1), (1, [1e300, 2.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.0, 0.0], 1), (4, [1.0, 0.01, 0.0], 1), (5, [1e-310, 0.0], 1),
        (6, [0.0, 1.0], 1), (6, [0.0, 1.0], 1), (7, [0.0, 1.0], 1), (None, [0.0, 1.0], 1), (8, [], 1), (9, [0.0, 2.0], None), (10, None, None),
    ]
    got = E.near_duplicates(_table(spark, rows)).collect()
    links = sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id, r.kept) for r in got)
    assert links == sorted([
        (0, 3, 0, True), (1, 3, 0, False), (2, 3, 0, False), (5, 3, 0, False), (3, 1, 3, True), (4, 1, 3, False), (6, 2, 6, True), (6, 2, 6, True), (7, 2, 6, False),
        (-1, 0, None, False), (8, 0, 8, True), (9, 0, 9, True), (10, 0, 10, True),
    ], key=lambda r: (r[0], r[1]))
    near = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in N.neighbours(_table(spark, rows), k=3, every=3).collect())
    assert [x[:3] for x in near if x[0] == 3] == [(3, 1, 4)]
    assert [x[:3] for x in near if x[0] == 6] == [(6, 1, 7), (6, 2, 5), (6, 3, 9)]
    assert [x[2] for x in near if x[0] == 0][0] == 1 and near[0][3] == 1.0 and [x[:3] for x in near if x[0] == 9] == [(9, 1, 6), (9, 2, 7), (9, 3, 5)]
    empty = _table(spark, rows).limit(0)
    assert E.near_duplicates(empty).count() == 0 and N.neighbours(empty).count() == 0


def _clusters(n, seed, dim=32):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n // 20, dim))[rng.integers(0, n // 20, n)]
    x += rng.standard_normal((n, dim)) * rng.choice([0.02, 0.12, 0.2], (n, 1))
    x[: n // 3] = x[0] + 0.06 * rng.standard_normal((n // 3, dim))
    return x


def _links_of_all_pairs(x, labels, cosine):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    yes = (u @ u.T >= cosine) & (labels[:, None] == labels[None])
    np.fill_diagonal(yes, False)
    root = np.arange(len(x))
    while True:
        low = np.minimum(root, np.where(yes, root[None], len(x)).min(axis=1))
        if (low == root).all():
            return yes.sum(1), root
        root = low


@pytest.mark.parametrize("tile, copy", [(4096, 4000), (50, 4000), (50, 0)])
def test_links_in_tiles_and_deep_trees(spark, monkeypatch, tile, copy):
    monkeypatch.setattr(E, "TILE", tile)
    monkeypatch.setattr(E, "COPY", copy)
    x = _clusters(900, 4)
    labels = np.arange(len(x)) % 2
    labels[: len(x) // 3] = 0
    blocks = E.Blocks(x, 0.93, len(x))
    assert (blocks.depth > 2) == (copy == 0)
    n, root = _links_of_all_pairs(x, labels, 0.93)
    rows = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, labels, strict=True))], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in E.near_duplicates(rows.repartition(6)).collect()}
    assert [got[i].n_links for i in range(len(x))] == n.tolist() and n.max() > 200
    assert [got[i].component_id for i in range(len(x))] == root.tolist()


@pytest.mark.parametrize("kind, n, most", [("plain", 2000, 2.0), ("plain", 20000, 1.0), ("clusters", 20000, 0.1), ("flat", 20000, 0.3)])
def test_recall_against_reads(kind, n, most):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((n, 64))
    if kind == "clusters":
        x = rng.standard_normal((n // 100, 64))[rng.integers(0, n // 100, n)] + 0.25 * x
    if kind == "flat":
        x = rng.standard_normal((n, 12)) @ rng.standard_normal((12, 64))
    forest = N.Forest(x[rng.permutation(n)[: N.SAMPLE]])
    leaf = forest.leaf_of(x)
    found, reads = [], []
    for i in range(0, n, n // 60):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        seen = np.zeros(n, bool)
        for _, (t, f) in zip(range(forest.read), forest.search(x[i]), strict=False):
            hit = leaf[:, t] == f
            seen |= hit
            reads.append(hit.sum())
        found.append(seen[np.argsort(d)[:10]].mean())
    share = np.sum(reads) / len(found) / n
    print(kind, n, "recall", np.mean(found), "entries read of the table", share)
    assert np.mean(found) >= 0.9 and share <= most


def test_spread_join_equals_a_plain_one(spark):
    rows = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 11 != 0, F.col("id") % 40).alias("k"))
    known = spark.range(30).select(F.col("id").alias("k"), (F.col("id") * 10).alias("x"))
    want = sorted(map(str, rows.join(known, "k", "left").select("id", "k", "x").collect()))
    for small in (0, 1000):
        got = common.spread_join(rows, known, "k", heavy=4, small=small).select("id", "k", "x").collect()
        assert sorted(map(str, got)) == want
