"""Greedy duplicates: the walk of a model and year and the rounds of joins against the sequential rule."""

import datetime as dt
import random

import pytest

from advertlake.operators import book
from advertlake.settings import Settings


def _same(a, b):
    """Whether row a may be a copy of head b; rows are (id, brand, model, year, km, price, seller, active, at)."""
    ours = a[6] is not None and a[6] == b[6]
    both = bool(a[4]) and bool(b[4])
    share = 0.03 if both and a[4] % 1000 == 0 and b[4] % 1000 == 0 else 0.15
    close = bool(a[5]) and bool(b[5]) and abs(a[5] - b[5]) <= share * max(a[5], b[5])
    near = both and abs(a[4] - b[4]) <= max(500, 0.02 * max(a[4], b[4]))
    return a[1:4] == b[1:4] and (not a[7] or b[7]) and (near and (ours or (close and a[2] is not None)) if both else ours and close)


@pytest.mark.parametrize("seed", [1, 2])
def test_walk_and_rounds_equal_the_sequential_rule(spark, monkeypatch, seed):
    r, rows = random.Random(seed), []
    for i in range(900):
        km = r.choice([None, 0, 20_000, 24_600, 25_000, 25_400, 61_000, 61_700, 62_300, 140_000, 142_000, 144_500])
        price = r.choice([0.0, None, 1000.0, 1020.0, 1031.0, 1100.0, 1149.0, 1200.0, 5000.0, r.uniform(900, 6000)])
        at = r.choice([None, dt.datetime(2020, 1, 1), dt.datetime(2020, 1, r.randrange(1, 9))])
        rows.append((i, r.choice(["b", "b", "c", None]), r.choice(["m", "m", None]), r.choice([2015, 2015, 2016, None]), km, price, r.choice(["s", "t", "u", None]), r.random() < 0.5, at))
    heads, want = [], {}
    for a in sorted(rows, key=lambda x: (x[8] is None, x[8] or dt.datetime(1970, 1, 1), x[0])):
        can = a[1] is not None and a[3] is not None
        want[a[0]] = next((b[0] for b in heads if can and _same(a, b)), a[0])
        if can and want[a[0]] == a[0]:
            heads.append(a)
    table = spark.createDataFrame(rows, "id long, brand_norm string, model_norm string, year int, km int, price_gbp double, seller string, is_active boolean, first_seen_at timestamp")
    plan = book.greedy_duplicates(table, Settings())
    assert {x.id: x.canonical for x in plan.collect()} == want
    assert "Generate" not in plan._jdf.queryExecution().executedPlan().toString()  # no row is repeated for each cell that it reaches
    rounds, used = book._in_rounds, []
    monkeypatch.setattr(book, "_in_rounds", lambda base: used.append(base.count()) or rounds(base))
    assert {x.id: x.canonical for x in book.greedy_duplicates(table, Settings(), most=60).collect()} == want
    assert 0 < used[0] < 900
