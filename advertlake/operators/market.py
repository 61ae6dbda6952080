"""Comparable markets: for each target advert, robust statistics over the adverts that can be compared with it.

Targets and pool meet in cells (cells.py): the seller cap, the trim and all statistics are worked out where they meet, and one row per target leaves
the cell. Where a kind of targets has many candidates, no pair is formed (ladders.py): work, shuffle and memory grow with the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from advertlake.functions.numbers import quartile_weight
from advertlake.functions.rules import effective_km
from advertlake.operators import cells, ladders
from advertlake.operators.cells import Cell, in_cells, quantile, sorted_quantile
from advertlake.settings import Settings

_POOL = ["id", "brand_norm", "model_norm", "year", "km", "price_gbp", "currency", "seller", "is_active", "is_sold", "steering", "transmission", "engine_l", "first_seen_at"]


def usable_pool(pool: DataFrame, s: Settings) -> DataFrame:
    """The row part of the comparable rule: plausible price, active or sold, seen within the window (active adverts within a shorter one)."""
    age = F.datediff(F.lit(s.as_of), F.col("first_seen_at"))
    recent = F.col("first_seen_at").isNull() | ((age <= s.window_days) & (~F.col("is_active") | (age <= s.active_max_age_days)))
    rows = pool.select(_POOL).filter(F.col("price_gbp").between(s.min_price, s.max_price) & (F.col("is_active") | F.col("is_sold")) & recent)
    return rows.filter(F.col("year").isNotNull()).withColumn("km", effective_km(F.col("km"), F.col("year"), s.as_of))


def market_median(targets: DataFrame, pool: DataFrame, s: Settings) -> DataFrame:
    """Per target with enough comparables one year around it: their number, sellers, median and lower quartile of the prices."""
    schema = f"t_id {_type_of(targets, 'id')}, n long, sellers_n long, median double, p25 double"
    return in_cells(targets, usable_pool(pool, s), s, 1, _cell_medians, schema)


def _cell_medians(cell: Cell) -> pa.Table:
    out = []
    for like in cell.alike():
        cols = cell.candidates(like[0], 1)
        out += _answers(cell, like, cols, lambda own, cols=cols: _medians(cell, own, cols), _ladder_medians, False)
    own, n, sellers, median, p25 = _joined(out, 5)
    return pa.table({"t_id": cell.targets["t_id"].take(pa.array(own.astype(np.int64))), "n": _whole(n), "sellers_n": _whole(sellers), "median": median, "p25": p25})


def _medians(cell: Cell, own: np.ndarray, cols: np.ndarray) -> list:
    kept = cell.capped(own, cols)
    n = kept.sum(1)
    own, kept, n = own[n >= cell.s.min_comparables], kept[n >= cell.s.min_comparables], n[n >= cell.s.min_comparables]
    q = [quantile(kept, cell.price[cols], n, x) for x in (0.5, 0.25)]
    return [own, n, cell.sellers(kept, cols), *q]


def _ladder_medians(asked: ladders.Asked) -> list:
    """As _medians."""
    who, end = np.arange(len(asked.targets)), len(asked.l.rows)
    n = asked.count(who, np.full(len(who), end))
    who, n = who[n >= asked.l.cell.s.min_comparables], n[n >= asked.l.cell.s.min_comparables]
    span = np.zeros((4, len(who)), np.int64)
    span[3] = end
    return [asked.targets[who], n, asked.sellers(who, span, asked.inside(who, span)), *asked.quantiles(who, 0, n, 0.5, 0.25)[0]]


def _answers(cell: Cell, like: np.ndarray, cols: np.ndarray, matrix: Callable, ladder: Callable, moving: bool) -> Iterator[list]:
    """The columns that matrix() and ladder() give for targets of one kind, the first of which are the targets. Targets that ask the same are answered
    once; ladder() serves many targets with many candidates. moving: prices are moved to the target's mileage."""
    if not len(like) or not len(cols):
        return
    some, place, back = cell.asked(like, cols)
    moved = ~np.isnan(cell.t_km[some]) & moving
    odd = cell.twice[some] | (cell.s.max_per_seller != ladders.MOST)
    for at in (np.flatnonzero(odd), np.flatnonzero(~odd & moved), np.flatnonzero(~odd & ~moved)):
        if not len(at):
            continue
        if len(at) * len(cols) < cells.LADDER or odd[at[0]]:
            got = [matrix(own) for own in cell.chunks(some[at], cols)]
        else:
            steps = ladders.Ladder(cell, cols, bool(moved[at[0]]))
            size = max(1, cells.AT_ONCE // (len(steps.many) + 64))
            got = [ladder(steps.ask(some[x], np.where(place[x] < 0, -1, steps.place[place[x]]))) for x in (at[i : i + size] for i in range(0, len(at), size))]
        own, *columns = _joined(got, len(got[0]))
        order = np.argsort(some)
        row = np.full(len(some), -1)
        row[order[np.searchsorted(some, own, sorter=order)]] = np.arange(len(own))
        take = row[back]
        yield [like[take >= 0], *(c[take[take >= 0]] for c in columns)]


_STEP = ["step", "n", "sellers_n", "low", "high", "archived_share", "near_n", "median_year", "median", "p25", "median_km", "sigma"]
_WHOLE = ["step", "n", "sellers_n", "near_n", "median_km"]


def market_steps(targets: DataFrame, pool: DataFrame, s: Settings, ids: bool = False) -> DataFrame:
    """Targets with a valid market, and their valid markets (steps) in order: 1 one year without TRY, 2 one year, 3 two years without TRY, 4 two years.
    ids: also the ids of the comparables of each.

    Steps without TRY exist for targets that are not in TRY themselves and whose key has TRY adverts in the pool. A step is only taken for targets that
    no step before made rich: with a rich one, later steps decide nothing.
    """
    keys = ["brand_norm", "model_norm"]
    has_try = pool.groupBy(*keys).agg(F.bool_or(F.col("currency") == "TRY").alias("t_has_try"))
    has_try = has_try.select(*[F.col(k).alias(f"h_{k}") for k in keys], "t_has_try").filter("t_has_try")
    t = targets.join(has_try, F.col("brand_norm").eqNullSafe(F.col("h_brand_norm")) & F.col("model_norm").eqNullSafe(F.col("h_model_norm")), "left")
    gbp_first = F.coalesce(F.col("currency") != "TRY", F.lit(True)) & F.col("t_has_try").isNotNull()
    id_type = _type_of(targets, "id")
    fields = ", ".join(f"{c}: {'int' if c in _WHOLE else 'double'}" for c in _STEP) + (f", ids: array<{_type_of(pool, 'id')}>" if ids else "")
    schema = f"t_id {id_type}, t_year int, t_km int, t_price_gbp double, t_currency {_type_of(targets, 'currency')}, t_model {_type_of(targets, 'model_norm')}, steps array<struct<{fields}>>"
    return in_cells(t, usable_pool(pool, s), s, 2, lambda cell: _cell_steps(cell, ids), schema, gbp_first, {"currency": "t_currency", "model_norm": "t_model"})


def _cell_steps(cell: Cell, ids: bool) -> pa.Table:
    """The valid steps of each target of a cell that has any."""
    out = []
    for like in cell.alike():
        for step in range(1, 5) if cell.t_gbp[like[0]] else (2, 4):
            if not len(like):
                break
            cols = cell.candidates(like[0], (step + 1) // 2)
            cols = cols[cell.gbp[cols]] if step % 2 else cols
            if ids:
                got = [_statistics(cell, own, cols, step, True) for own in cell.chunks(like, cols)]
            else:
                got = list(_answers(cell, like, cols, lambda own, cols=cols, step=step: _statistics(cell, own, cols, step, False)[:-1], lambda asked, step=step: _ladder_statistics(asked, step), True))
            out += got
            like = np.setdiff1d(like, np.concatenate([x[0][x[2] >= cell.s.rich_comparables] for x in got])) if got else like
    own, *columns = _joined([x[: len(_STEP) + 1] for x in out], len(_STEP) + 1)
    order = np.lexsort((columns[0], own))
    who, first = np.unique(own[order], return_index=True)
    values = [pa.array(c[order], pa.int32() if name in _WHOLE else pa.float64(), from_pandas=True, safe=False) for name, c in zip(_STEP, columns, strict=True)]
    names = list(_STEP)
    if ids:
        of = [x for part in out for x in part[-1]]
        values.append(pa.array([cell.rows["id"].take(pa.array(np.sort(of[k]))).sort().to_pylist() for k in order], pa.list_(cell.rows["id"].type)))
        names.append("ids")
    steps = pa.ListArray.from_arrays(pa.array(np.r_[first, len(own)], pa.int32()), pa.StructArray.from_arrays(values, names))
    at = pa.array(who.astype(np.int64))
    return pa.table({c: cell.targets[c].take(at) for c in ("t_id", "t_year", "t_km", "t_price_gbp", "t_currency", "t_model") if c in cell.targets.column_names} | {"steps": steps})


def _statistics(cell: Cell, own: np.ndarray, cols: np.ndarray, step: int, ids: bool) -> list:
    """The targets for which the step is valid, and the values of _STEP for each. Prices are moved to the target's mileage. Kept are those within a
    band around the median (fewer than 8), else within 1.5 quartile distances of the exclusive quartiles."""
    s, k = cell.s, np.arange
    kept = cell.capped(own, cols)
    n0 = kept.sum(1)
    own, kept, n0 = own[n0 >= s.min_comparables], kept[n0 >= s.min_comparables], n0[n0 >= s.min_comparables]
    km, t_km, price = cell.km[cols], cell.t_km[own][:, None], cell.price[cols]
    adj = price * np.exp(-s.km_adjust_per_10k * (t_km - km) / 10000)
    adj = np.where(kept, np.where(np.isnan(adj), price, adj), np.inf)
    xs = np.sort(adj, axis=1)
    few, none = n0 < s.rich_comparables, np.zeros(len(own), int)
    m0 = sorted_quantile(xs, none, n0, 0.5)

    def exclusive(i: int) -> np.ndarray:
        j = np.maximum(1, np.minimum(i * (n0 + 1) // 4, n0 - 1))
        d = i * (n0 + 1) - 4 * j
        return (xs[k(len(own)), j - 1] * (4 - d) + xs[k(len(own)), j] * d) / 4

    q1, q3 = exclusive(1), exclusive(3)
    lo = np.where(few, s.small_pool_band * m0, q1 - 1.5 * (q3 - q1))
    hi = np.where(few, m0 / s.small_pool_band, q3 + 1.5 * (q3 - q1))
    start = (xs < lo[:, None]).sum(1)
    kept = (adj >= lo[:, None]) & (adj <= hi[:, None])
    n, sellers = kept.sum(1), cell.sellers(kept, cols)
    ok = (n >= (s.min_comparables if step % 2 == 0 else max(s.min_comparables, s.rich_comparables))) & (sellers >= s.min_sellers)
    own, kept, n, sellers, xs, start, t_km = own[ok], kept[ok], n[ok], sellers[ok], xs[ok], start[ok], t_km[ok]
    row = k(len(own))
    known = kept & (km > 0)
    km_n = known.sum(1)
    km_m = quantile(known, km, km_n, 0.5)
    near = (kept & (np.isnan(km) | (np.abs(km - t_km) <= s.km_near_limit))).sum(1)
    at = k(xs.shape[1])
    logs = np.log(np.where((at >= start[:, None]) & (at < (start + n)[:, None]), xs, np.nan))
    off = np.sort(np.abs(logs - sorted_quantile(logs, start, n, 0.5)[:, None]), axis=1)
    sigma = np.maximum(1.4826 * sorted_quantile(off, np.zeros(len(own), int), n, 0.5), 0.03)
    return [
        own, np.full(len(own), step), n, sellers, xs[row, start], xs[row, start + n - 1], (kept & ~cell.active[cols]).sum(1) / n,
        np.where(np.isnan(t_km[:, 0]), np.nan, near), quantile(kept, cell.year[cols], n, 0.5), sorted_quantile(xs, start, n, 0.5), sorted_quantile(xs, start, n, 0.25),
        np.where(km_n >= s.min_comparables, np.trunc(km_m), np.nan), np.where(n >= 5, sigma, np.nan), [cols[x] for x in kept] if ids else [],
    ]


def _ladder_statistics(asked: ladders.Asked, step: int) -> list:
    """As _statistics, without ids."""
    lad, cell, s = asked.l, asked.l.cell, asked.l.cell.s
    who = np.arange(len(asked.targets))
    n0 = asked.count(who, np.full(len(who), len(lad.rows)))
    who, n0 = who[n0 >= s.min_comparables], n0[n0 >= s.min_comparables]
    few = n0 < s.rich_comparables
    (m0,), _ = asked.quantiles(who, 0, n0, 0.5)

    def exclusive(i: int) -> np.ndarray:
        j = np.maximum(1, np.minimum(i * (n0 + 1) // 4, n0 - 1))
        d = i * (n0 + 1) - 4 * j
        a, b = asked.at(np.tile(who, 2), np.r_[j - 1, j]).reshape(2, -1)
        return (a * (4 - d) + b * d) / 4

    q1, q3 = exclusive(1), exclusive(3)
    span = asked.spans(who, np.where(few, s.small_pool_band * m0, q1 - 1.5 * (q3 - q1)), np.where(few, m0 / s.small_pool_band, q3 + 1.5 * (q3 - q1)))
    before = [asked.count(who, x) for x in span]
    start, n = before[0] + before[2] - asked.count(who, np.full(len(who), lad.mid)), before[1] - before[0] + before[3] - before[2]
    inside = asked.inside(who, span)
    sellers = asked.sellers(who, span, inside)
    ok = (n >= (s.min_comparables if step % 2 == 0 else max(s.min_comparables, s.rich_comparables))) & (sellers >= s.min_sellers)
    who, span, inside, n, sellers, start, unknown = who[ok], span[:, ok], inside[ok], n[ok], sellers[ok], start[ok], (before[3] - before[2])[ok]
    (median, p25), (low_mid, high_mid) = asked.quantiles(who, start, n, 0.5, 0.25)
    low, high = asked.at(np.tile(who, 2), np.r_[start, start + n - 1]).reshape(2, -1)
    at = (n - 1) * 0.5
    mid = np.where(low_mid == high_mid, np.log(low_mid), (np.ceil(at) - at) * np.log(low_mid) + (at - np.floor(at)) * np.log(high_mid))
    sigma = np.maximum(1.4826 * asked.spread(who, span, mid, np.maximum(mid - np.log(low), np.log(high) - mid), n), 0.03)
    km_n, km_m, near = asked.mileages(who, span, inside)
    t_km = asked.t_km[who]
    return [
        asked.targets[who], np.full(len(who), step), n, sellers, low, high, asked.total(who, span, inside, lad.idle, lambda p: ~cell.active[lad.rows[p]]) / n,
        np.where(np.isnan(t_km), np.nan, near + unknown), asked.years(who, span, inside, n), median, p25,
        np.where(km_n >= s.min_comparables, np.trunc(km_m), np.nan), np.where(n >= 5, sigma, np.nan),
    ]


def _joined(parts: list[list], width: int) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0)] * width


def _whole(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int64))


def _type_of(d: DataFrame, column: str) -> str:
    return d.schema[column].dataType.simpleString()


def trimmed(rows: DataFrame, s: Settings) -> DataFrame:
    """Keeps prices within a band around the median (fewer than 8), else within 1.5 quartile distances of the exclusive quartiles."""
    w = Window.partitionBy("t_id", "step")
    rows = rows.withColumns({"n0": F.count("*").over(w), "m0": F.median("adj").over(w), "rn": F.row_number().over(w.orderBy("adj", "id"))})
    rows = rows.filter(F.col("n0") >= s.min_comparables)
    q1, q3 = (F.sum(F.col("adj") * quartile_weight(F.col("rn"), F.col("n0"), i)).over(w) / 4 for i in (1, 3))
    rows = rows.withColumns({"q1": q1, "q3": q3})
    few, reach = F.col("n0") < s.rich_comparables, 1.5 * (F.col("q3") - F.col("q1"))
    lo = F.when(few, s.small_pool_band * F.col("m0")).otherwise(F.col("q1") - reach)
    hi = F.when(few, F.col("m0") / s.small_pool_band).otherwise(F.col("q3") + reach)
    return rows.filter(F.col("adj").between(lo, hi))


def find_market(targets: DataFrame, pool: DataFrame, s: Settings, ids: bool = False) -> DataFrame:
    """The market of each target: the first step with enough rows, made cautious by an earlier thin step (the lower of both medians, quartiles and
    mileages); without such a step the first valid one. Targets without any valid step have no row. ids: also the ids of its comparables."""
    g = market_steps(targets, pool, s, ids)
    g = g.withColumn("first", F.get("steps", F.lit(0))).withColumn("rich", F.get(F.filter("steps", lambda x: x["n"] >= s.rich_comparables), F.lit(0)))
    got = F.coalesce("rich", "first")
    merged = F.col("rich").isNotNull() & (F.col("first.step") < F.col("rich.step"))
    both = lambda c: F.when(merged, F.least(F.col(f"first.{c}"), got[c])).otherwise(got[c]).alias(c)
    keep = [got[c].alias(c) for c in ("step", "n", "sellers_n", "low", "high", "archived_share", "near_n", "median_year", "sigma", *(["ids"] if ids else []))]
    out = g.select("t_id", "t_year", "t_km", "t_price_gbp", "t_currency", "t_model", *keep, both("median"), both("p25"), both("median_km"), merged.alias("merged"))
    return out.withColumn("z", F.ln(F.col("t_price_gbp") / F.col("median")) / F.col("sigma")).drop("sigma")


def nearest_comparables(targets: DataFrame, pool: DataFrame, s: Settings, k: int = 5) -> DataFrame:
    """The k comparables within two years that are nearest in years, mileage and price (0.1 times the relative price distance), ties by id."""
    schema = f"t_id {_type_of(targets, 'id')}, rank int, id {_type_of(pool, 'id')}, distance double"
    return in_cells(targets, usable_pool(pool, s), s, 2, lambda cell: _cell_nearest(cell, k), schema).withColumn("distance", F.nanvl("distance", F.lit(None)))


def _cell_nearest(cell: Cell, k: int) -> pa.Table:
    out = []
    rank = pc.rank(cell.rows["id"], tiebreaker="first").to_numpy() if len(cell.rows) else None
    by_id = np.argsort(rank) if len(cell.rows) else None
    for like in cell.alike():
        fits = np.zeros(len(cell.rows), bool)
        fits[cell.candidates(like[0], 2)] = True
        cols = by_id[fits[by_id]]
        priced = (cell.t_price[like] > 0) & np.isfinite(cell.t_price[like])
        if len(like) * len(cols) >= cells.LADDER and len(cols) > k and priced.any():
            out.append(ladders.nearest(cell, like[priced], cols, rank, k))
            like = like[~priced]
        for own in cell.chunks(like, cols):
            price = cell.t_price[own][:, None]
            d = cell.closeness(own, cols) + 0.1 * np.abs(cell.price[cols] - price) / price
            d = np.where(cell.others(own, cols), np.where(np.isnan(d), -1.0, d), np.inf)
            most = np.partition(d, k - 1, axis=1)[:, k - 1] if len(cols) > k else np.full(len(own), np.inf)
            row, col = np.nonzero((d <= most[:, None]) & (d < np.inf))
            order = np.lexsort((d[row, col], row))
            row, col = row[order], col[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            row, col, place = row[place < k], col[place < k], place[place < k]
            out.append([own[row], place + 1, cols[col], d[row, col]])
    own, rank, other, d = _joined(out, 4)
    ids = [c.take(pa.array(at.astype(np.int64))) for c, at in ((cell.targets["t_id"], own), (cell.rows["id"], other))]
    return pa.table({"t_id": ids[0], "rank": pa.array(rank.astype(np.int32)), "id": ids[1], "distance": np.where(d < 0, np.nan, d)})
