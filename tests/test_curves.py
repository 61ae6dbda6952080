"""Curves without a row against a fit of the other rows, on small models with odd rows."""

import math
import random

import pytest

from advertlake.operators import curves as C
from advertlake.settings import Settings

S = Settings(curve_max_sigma=9.0, curve_max_age_slope=9.0, est_min_curve_sellers=2)


def _fit(points, lam=0.5):
    """Centred ridge by explicit deviations; points (age, km / 10000, ln price)."""
    n = len(points)
    ma, mk, my = (sum(p[i] for p in points) / n for i in range(3))
    d = [(a - ma, k - mk, y - my) for a, k, y in points]
    saa, skk = sum(a * a for a, _, _ in d) + lam, sum(k * k for _, k, _ in d) + lam
    sak, say, sky = sum(a * k for a, k, _ in d), sum(a * y for a, _, y in d), sum(k * y for _, k, y in d)
    det = saa * skk - sak * sak
    b_age, b_km = (say * skk - sky * sak) / det, (sky * saa - say * sak) / det
    if b_km > -0.010:
        b_age, b_km = (say + 0.012 * sak) / saa, -0.012
    rest = sum((y - b_age * a - b_km * k) ** 2 for a, k, y in d)
    return my, b_age, b_km, math.sqrt(rest / max(n - 3, 1))


@pytest.mark.parametrize("seed", [1, 2])
def test_curves_without_a_row_equal_a_refit(spark, seed):
    rng = random.Random(seed)
    rows, points = [], {}
    for m in range(3):
        for i in range(9 + 4 * m):
            year, km = rng.choice([2010, 2012, 2015, 2019][: 4 if m else 3]), 30_000 + 1_000 * rng.randrange(150)
            price = round(20_000 * math.exp(-0.08 * (2026 - year) - 0.03 * km / 10_000 + rng.gauss(0, 0.05)), 2)
            id_ = f"{m}-{i}"
            rows.append((id_, "b", f"m{m}", year, km, price, f"s{rng.randrange(5)}", "RHD"))
            points[id_] = (f"m{m}", 2026 - year, km / 10_000, math.log(price), rows[-1][6], year, km)
    rows += [("x-1", "b", "m2", 2015, None, 9_000.0, "s1", "RHD"), ("x-2", "b", "m2", 2015, 90_000, 9_000.0, "s1", "LHD"), ("x-3", "b", "none", 2015, 90_000, 9_000.0, "s1", None)]
    d = spark.createDataFrame(rows, "id string, brand_norm string, model_norm string, year int, km int, price_gbp double, seller string, steering string")
    used = {r.id for r in C.used_points(C.curve_points(d, S, weighted=False), S).select("id").collect()}
    got = {r.id: r for r in C.curves_without(d, S).collect()}
    for id_, _, model, *_ in rows:
        others = [p for i, p in points.items() if p[0] == model and i != id_ and i in used]
        if len(others) < 8 or len({p[5] for p in others}) < 3:
            assert id_ not in got
            continue
        r = got[id_]
        want = _fit([p[1:4] for p in others])
        assert (r.my, r.b_age, r.b_km, r.sigma) == pytest.approx(want, abs=1e-9)
        assert (r.n, r.sellers, r.min_year, r.max_year, r.max_km) == (len(others), len({p[4] for p in others}), min(p[5] for p in others), max(p[5] for p in others), max(p[6] for p in others))
    assert "x-3" not in got and got["x-1"].n == len([i for i, p in points.items() if p[0] == "m2" and i in used])


def test_no_model_is_dealt_by_id(spark):
    """What is shuffled by id holds the row's own part, and not the sums of its model."""
    from advertlake.operators import curves as C
    from advertlake.settings import ANALOGUE
    from advertlake.sources.listings import listings

    plan = C.curves_without(listings(spark, "/root/testdata/sf0.001"), ANALOGUE)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("Join LeftOuter")
