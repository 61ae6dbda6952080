"""Comparable markets against plain Python over all pairs, on one hot model with unknown keys, few sellers and repeated ids."""

import datetime as dt
import random
import statistics

import pytest

from advertlake.operators import cells, market
from advertlake.settings import Settings

S = Settings()
NAMES = ["id", "brand_norm", "model_norm", "year", "km", "price_gbp", "currency", "seller", "is_active", "is_sold", "steering", "transmission", "engine_l", "first_seen_at"]
TYPES = "id string, brand_norm string, model_norm string, year int, km int, price_gbp double, currency string, seller string, is_active boolean, is_sold boolean, steering string, transmission string, engine_l double, first_seen_at timestamp"


@pytest.fixture(scope="module")
def adverts():
    r = random.Random(3)
    return [
        dict(zip(NAMES, (f"{i:04}", r.choice(["X", None]), "Y", r.choice([None, 2017, 2018, 2019, 2020, 2021]), r.choice([None, 0, 40_000, 90_000, 130_000]), float(r.randrange(400, 30_000)),
                         r.choice(["TRY", "GBP", None]), r.choice([None, *"abcdefghijklmnop"]), r.random() < 0.6, r.random() < 0.5, r.choice([None, "RHD", "LHD"]), r.choice([None, "m", "a"]),
                         r.choice([None, 1.0, 1.3, 1.4]), dt.datetime(2026, 9, 1)), strict=True))
        for i in range(500)
    ]


def _pairs(rows, span):
    near = lambda a, b: a is None or b is None or a == b
    for t in rows:
        own = [
            x for x in rows
            if None not in (t["year"], x["year"]) and x["id"] != t["id"] and x["brand_norm"] == t["brand_norm"] and abs(x["year"] - t["year"]) <= span and (x["is_active"] or x["is_sold"])
            and x["price_gbp"] >= S.min_price and (x["steering"] or "RHD") == (t["steering"] or "RHD") and near(x["transmission"], t["transmission"])
            and (near(x["engine_l"], t["engine_l"]) or round(abs(x["engine_l"] - t["engine_l"]), 1) <= S.engine_tolerance)
        ]
        yield t, own


def _closeness(t, x):
    return abs(x["year"] - t["year"]) + (abs(x["km"] - t["km"]) / 30000 if x["km"] and t["km"] else 1.0)


def _believed(rows):
    return [x | {"km": None if x["km"] is not None and x["km"] < 1000 and 2026 - (x["year"] or 2026) >= 2 else x["km"]} for x in rows]


@pytest.mark.parametrize("block, at_once", [(50_000, 1 << 20), (7, 1)])
def test_median_of_capped_comparables(spark, adverts, monkeypatch, block, at_once):
    monkeypatch.setattr(cells, "BLOCK", block)
    monkeypatch.setattr(cells, "AT_ONCE", at_once)
    want = {}
    for t, own in _pairs(_believed(adverts), 1):
        by_seller = {}
        for x in sorted(own, key=lambda x: (_closeness(t, x), x["id"])):
            by_seller.setdefault(x["seller"], []).append(x["price_gbp"])
        prices = [p for ps in by_seller.values() for p in ps[: S.max_per_seller]]
        if len(prices) >= S.min_comparables:
            want[t["id"]] = (len(prices), len(set(by_seller) - {None}), round(statistics.median(prices), 6))
    df = spark.createDataFrame([tuple(x[n] for n in NAMES) for x in adverts], TYPES)
    got = {x.t_id: (x.n, x.sellers_n, round(x["median"], 6)) for x in market.market_median(df, df, S).collect()}
    assert got == want and len(want) > 300


def test_nearest_and_ids(spark, adverts):
    df = spark.createDataFrame([tuple(x[n] for n in NAMES) for x in adverts], TYPES)
    want = {}
    for t, own in _pairs(_believed(adverts), 2):
        far = sorted((_closeness(t, x) + 0.1 * abs(x["price_gbp"] - t["price_gbp"]) / t["price_gbp"], x["id"]) for x in own)[:5]
        want |= {(t["id"], k + 1): (i, round(d, 9)) for k, (d, i) in enumerate(far)}
    assert {(x.t_id, x["rank"]): (x.id, round(x.distance, 9)) for x in market.nearest_comparables(df, df, S).collect()} == want
    got = market.find_market(df, df, S, ids=True).collect()
    assert got and all(len(x.ids) == x.n and x.t_id not in x.ids and x.ids == sorted(x.ids) for x in got)


def test_no_pair_is_shuffled(spark, adverts):
    """Nothing is dealt or sorted by target after targets have met the pool: one row per target leaves the cell."""
    df = spark.createDataFrame([tuple(x[n] for n in NAMES) for x in adverts], TYPES)
    for got in (market.market_median(df, df, S), market.find_market(df, df, S), market.nearest_comparables(df, df, S)):
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        above = plan.split("FlatMapCoGroupsInArrow")[0]
        assert "FlatMapCoGroupsInArrow" in plan and not any(x in above for x in ("Join", "Repartition", "Window", "Sort", "Aggregate"))
