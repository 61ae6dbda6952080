"""The urgent lock against all pairs: small prices, own and repeated ids, and a car that very many adverts share."""

import random

import pytest

from advertlake.operators import twins as T

_COLS = "id long, brand_norm string, model_norm string, year int, seller_phone string, price_gbp double"


def _pairs(rows, sent, share):
    out = {}
    for i, *car, phone, price in rows:
        for j, *other, phone_then, before in sent:
            if i != j and phone and phone == phone_then:
                out[i] = "telefon"
            elif i != j and car == other and (price or 0) > 0 and (before or 0) > 0 and abs(price - before) <= share * before + 0.005:
                out.setdefault(i, "arac")
    return out


@pytest.mark.parametrize("share", [0.05, 0.3])
def test_equals_all_pairs(spark, share):
    rng = random.Random(3)

    def some(n, ids):
        price = lambda: rng.choice([None, 0.0, rng.uniform(0.001, 0.3), rng.uniform(1, 300), float(rng.randrange(1, 60)), 40 * (1 + share)])
        return [(rng.randrange(ids), "b", rng.choice(["m", None]), rng.choice([2001, None]), rng.choice([None, None, None, f"0533{rng.randrange(400):07d}"]), price()) for _ in range(n)]

    rows, sent = list({r[0]: r for r in some(400, 10_000)}.values()), some(40, 10_000)
    sent += [(r[0], *r[1:5], (r[5] or 1) * f) for r in rows[:60] for f in (1.0, 1 + share / 2)]  # own alerts, two for an advert
    sent += [(r[0], *r[1:]) for r in rows[60:90]]
    got = T.locked(spark.createDataFrame(rows, _COLS), spark.createDataFrame(sent, _COLS), share).collect()
    assert {r.id: r.reason for r in got} == _pairs(rows, sent, share)


def test_half_a_penny_counts_where_prices_are_small(spark):
    one = lambda i, p: spark.createDataFrame([(i, "b", "m", 2001, None, p)], _COLS)
    assert [r.reason for r in T.locked(one(1, 0.01), one(2, 0.015)).collect()] == ["arac"]
    assert T.locked(one(1, 0.01), one(2, 0.016)).count() == 0
    assert T.locked(one(1, 0.01), one(1, 0.01)).count() == 0
