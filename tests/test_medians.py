"""Medians of groups of any size, and curves whose steps are worked out once."""

import random
import statistics

from advertlake.operators import curves as C


def test_medians_equal_the_sorted_middle(spark):
    r, rows = random.Random(8), []
    for g in range(12):
        for _ in range(1 + r.randrange(200)):
            rows.append((f"g{g}", "m" if g % 2 else "n", r.choice([1.0, 2.0, r.gauss(0, 1), 1e9, None] if g % 3 else [7.0])))
    got = {x.brand_norm: x.mid for x in C.medians(spark.createDataFrame(rows, "brand_norm string, model_norm string, v double"), C.KEYS, "v", "mid", cells=16).collect()}
    want = {}
    for g, _, v in rows:
        if v is not None:
            want.setdefault(g, []).append(v)
    assert got == {g: statistics.median(vs) for g, vs in want.items()}


def test_points_are_worked_out_once(spark):
    rows = [(f"{i}", "b", "m", 2000 + i % 9, 10_000 * (1 + i % 17), 1000.0 + 37 * (i % 29), f"s{i % 7}", None) for i in range(200)]
    d = spark.createDataFrame(rows, "id string, brand_norm string, model_norm string, year int, km int, price_gbp double, seller string, steering string")
    from advertlake.settings import Settings

    plan = C.used_points(C.curve_points(d, Settings()), Settings())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 0 and plan.count("Relation") <= 6


def test_backtest_holds_no_confidence_in_one_task(spark):
    from advertlake import registry

    plan = registry.QUERIES["AG36_backtest"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "median(" not in plan and "percentile(" not in plan
