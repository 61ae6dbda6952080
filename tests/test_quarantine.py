"""Medians of a model's neighbours from counts, against all neighbours; what is sorted is no multiple of the rows."""

import random
import statistics

from advertlake.operators import book
from advertlake.settings import Settings

_COLS = "id long, brand_norm string, model_norm string, year int, km int, price_gbp double"


def _rows():
    rng, inf, out = random.Random(11), float("inf"), []
    for i in range(3000):
        model = rng.choice("abcd")
        price = {"a": 500.0, "b": rng.choice([100.0, 2000.0, 2001.0, 9e8, inf]), "c": rng.lognormvariate(8, 1), "d": float(rng.randrange(11, 90))}[model]
        out.append((i, "x", model, 1980 + rng.choice([0, 1, 2, 3, 6, 12]), 1, price))
    return out + [(9000 + i, "x", "few", 1990, 1, 100.0 * 9**i) for i in range(8)]


def test_equals_all_neighbours(spark):
    rows = _rows()
    want = {}
    for i, _, model, year, _, price in rows:
        other = sorted(r[5] for r in rows if r[0] != i and r[2] == model and abs(r[3] - year) <= 2)
        mid = statistics.median(other) if other else 0
        if len(other) >= 8 and not 0.4 * mid <= price <= 2.5 * mid:
            want[i] = (len(other), mid)
    got = {r.id: (r.peers, r.mid) for r in book.quarantine(spark.createDataFrame(rows, _COLS), Settings()).collect() if r.mid is not None}
    assert got == want and len(want) > 100


def test_few_prices_are_repeated(spark):
    from pyspark.sql import functions as F

    n = 40_000
    rows = spark.range(n).select("id", F.lit("x").alias("brand_norm"), F.lit("m").alias("model_norm"), (1980 + F.col("id") % 8).cast("int").alias("year"), F.lit(1).alias("km"), (20 + F.rand(3) * 9000).alias("price_gbp"))
    df = book.quarantine(rows, Settings())
    df.collect()
    sorted_rows, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if node.nodeName().startswith(("ShuffleQueryStage", "BroadcastQueryStage")):
            todo.append(node.plan())
            continue
        if node.nodeName() == "Generate":
            sorted_rows.append(node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert sum(sorted_rows) < n
