"""Comparables without pairs on disk: targets and pool meet in cells of (brand, model, steering, five years), and what is wanted of a target's
comparables is worked out inside its cell.

A pool row is sent to the one or two cells that its span of years reaches, once per BLOCK targets of the cell; a target is in one cell. So what is
shuffled grows with the rows and not with the pairs. In a cell, the targets of one year, transmission and engine share their candidate rows. Those that
ask the same are answered once; what is left is taken as matrices (targets by candidates) of at most AT_ONCE entries, or, from LADDER entries on, from
sorted lists (ladders.py).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advertlake.functions.rules import effective_km
from advertlake.settings import Settings

YEARS, BLOCK, AT_ONCE, LADDER = 5, 500_000, 1 << 20, 1 << 17
_CELL = ["c_brand", "c_model", "c_side", "c_years", "c_block"]


def in_cells(targets: DataFrame, rows: DataFrame, s: Settings, span: int, body: Callable[[Cell], pa.Table], schema: str, gbp_first: Column | None = None, more: dict[str, str] | None = None) -> DataFrame:
    """body over every cell of targets and usable pool rows. Keys compare as null = null; unknown steering is RHD. gbp_first: a mark of targets. more: further
    columns of targets, and their names in the cell."""
    side = F.coalesce("steering", F.lit("RHD")).alias("c_side")
    place = [F.col("brand_norm").alias("c_brand"), F.col("model_norm").alias("c_model"), side]
    t = targets.filter("id is not null and year is not null").select(
        *place, F.floor(F.col("year") / YEARS).alias("c_years"), F.col("id").alias("t_id"), F.col("year").cast("int").alias("t_year"),
        effective_km(F.col("km"), F.col("year"), s.as_of).cast("int").alias("t_km"), F.col("price_gbp").cast("double").alias("t_price_gbp"), F.col("transmission").alias("t_transmission"),
        F.col("engine_l").cast("double").alias("t_engine_l"), (F.lit(False) if gbp_first is None else gbp_first).alias("t_gbp_first"),
        *[F.col(c).alias(name) for c, name in (more or {}).items()],
    )
    keys = _CELL[:4]
    sizes = t.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sizes = sizes.select(*[F.col(k).alias(f"s_{k}") for k in keys], "blocks")

    def sized(d: DataFrame) -> DataFrame:
        same = [d[k].eqNullSafe(F.col(f"s_{k}")) for k in keys]
        return d.join(sizes, same[0] & same[1] & same[2] & same[3]).drop(*[f"s_{k}" for k in keys])

    t = sized(t).withColumn("c_block", F.pmod(F.xxhash64("t_id"), F.col("blocks")).cast("int")).drop("blocks")
    reach = F.sequence(F.floor((F.col("year") - span) / YEARS), F.floor((F.col("year") + span) / YEARS))
    p = rows.filter("id is not null").select(
        *place, F.explode(reach).alias("c_years"), "id", F.col("year").cast("int").alias("year"), F.col("km").cast("int").alias("km"), F.col("price_gbp").cast("double").alias("price_gbp"),
        F.coalesce(F.col("currency") != "TRY", F.lit(True)).alias("gbp"), "seller", F.coalesce("is_active", F.lit(False)).alias("is_active"), "transmission", F.col("engine_l").cast("double").alias("engine_l"),
    )
    p = sized(p).withColumn("c_block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return body(Cell(left, right, s))

    return t.groupBy(*_CELL).cogroup(p.groupBy(*_CELL)).applyInArrow(run, schema)


class Cell:
    """The targets and candidates of a cell as arrays. Candidates are in the order of seller and id; an unknown number is NaN."""

    def __init__(self, targets: pa.Table, rows: pa.Table, s: Settings):
        self.s = s
        self.targets = targets.combine_chunks()
        self.rows = rows.take(pc.sort_indices(rows, [("seller", "ascending"), ("id", "ascending")])).combine_chunks()
        t, r, n = self.targets, self.rows, len(targets)
        self.t_key, self.key = np.split(_codes(t["t_id"], r["id"]), [n])
        gear = _codes(t["t_transmission"], r["transmission"])
        self.t_gear, self.gear = gear[:n], gear[n:]
        self.t_year, self.year = _floats(t["t_year"]), _floats(r["year"])
        self.t_km, self.km = _floats(t["t_km"]), _floats(r["km"])
        self.t_price, self.price = _floats(t["t_price_gbp"]), _floats(r["price_gbp"])
        self.t_engine, self.engine = _floats(t["t_engine_l"]), _floats(r["engine_l"])
        self.t_gbp, self.gbp = (c.to_numpy(zero_copy_only=False).astype(bool) for c in (_one(t["t_gbp_first"]), _one(r["gbp"])))
        self.active = _one(r["is_active"]).to_numpy(zero_copy_only=False).astype(bool)
        self.seller = _codes(r["seller"])
        first, times = np.full(n + len(r), -1), np.bincount(self.key, minlength=n + len(r))
        first[self.key[::-1]] = np.arange(len(r))[::-1]
        self.own, self.twice = first[self.t_key], times[self.t_key] > 1
        self._looks = None

    def alike(self) -> Iterator[np.ndarray]:
        """The targets, by year, transmission, engine and mark."""
        if not len(self.targets) or not len(self.rows):
            return
        known = np.nan_to_num(self.t_engine, nan=-1.0)
        kinds = np.unique(np.stack([self.t_year, self.t_gear, known, self.t_gbp]), axis=1, return_inverse=True)[1].reshape(-1)
        order = np.argsort(kinds, kind="stable")
        yield from np.split(order, np.flatnonzero(np.diff(kinds[order])) + 1)

    def candidates(self, of: int, span: int) -> np.ndarray:
        """The rows that targets like this one can be compared with; unknown transmission or engine fits all."""
        off = np.floor(np.abs(self.engine - self.t_engine[of]) * 10 + 0.5) / 10
        gear = (self.gear < 0) | (self.t_gear[of] < 0) | (self.gear == self.t_gear[of])
        return np.flatnonzero((np.abs(self.year - self.t_year[of]) <= span) & gear & (np.isnan(off) | (off <= self.s.engine_tolerance)))

    def asked(self, like: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One of each set of targets that have equal comparables, its own place among the candidates (-1: none), and for all targets which set is theirs.

        Without its own row, a target has the candidates of all targets of its mileage. Leaving out one of two equal rows of single sellers gives equal
        comparables, and so does one of two equal pairs of rows of a seller."""
        if self._looks is None:
            self._looks = np.unique(self.t_km, return_inverse=True)[1].reshape(-1), np.unique(np.stack([self.price, np.nan_to_num(self.km, nan=-1.0), self.year, self.active]), axis=1, return_inverse=True)[1].reshape(-1)
        km, look = self._looks
        own = self.own[like]
        place = np.minimum(np.searchsorted(cols, own), len(cols) - 1)
        place = np.where((own >= 0) & (cols[place] == own), place, -1)
        start, size = _runs(self.seller[cols])
        run = np.searchsorted(start, place, "right") - 1
        mate = np.where((size[run] == 2) & (place >= 0), 2 * start[run] + 1 - place, 0)
        few = (size[run] <= 2) & (self.seller[cols[place]] >= 0)
        equal = look[own] * (len(look) + 1) + np.where(size[run] == 2, look[cols[mate]] + 1, 0)
        kind = np.where(place < 0, -1, np.where(few, equal, -2 - np.arange(len(like))))
        kind = np.where(self.twice[like], -2 - np.arange(len(like)), kind)
        codes = np.unique(kind, return_inverse=True)[1].reshape(-1) * len(self.t_km) + km[like]
        at, back = np.unique(codes, return_index=True, return_inverse=True)[1:]
        return like[at], place[at], back.reshape(-1)

    def chunks(self, like: np.ndarray, cols: np.ndarray) -> Iterator[np.ndarray]:
        size = max(1, AT_ONCE // max(1, len(cols)))
        yield from (like[a : a + size] for a in range(0, len(like), size))

    def others(self, own: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Targets by candidates: all but the target itself."""
        return self.key[cols] != self.t_key[own][:, None]

    def closeness(self, own: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Distance in years, plus mileage in units of 30,000 (1 where either is unknown or 0)."""
        km, t_km = self.km[cols], self.t_km[own][:, None]
        apart = np.abs(km - t_km) / 30000
        apart[np.isnan(apart) | (km == 0) | (t_km == 0)] = 1.0
        return np.abs(self.year[cols] - self.t_year[own][:, None]) + apart

    def capped(self, own: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Targets by candidates: at most max_per_seller rows of a seller, the closest first, ties by id. Only sellers with more rows are ordered."""
        ok, most = self.others(own, cols), self.s.max_per_seller
        start, size = _runs(self.seller[cols])
        many = np.flatnonzero(np.repeat(size > most, size))
        if len(many):
            seller = np.repeat(np.arange(len(start)), size)[many]
            first = np.searchsorted(seller, seller)
            near = np.where(ok[:, many], self.closeness(own, cols[many]), np.inf)
            order = np.lexsort((near, np.broadcast_to(seller, near.shape)), axis=-1)
            kept = np.zeros(near.shape, bool)
            np.put_along_axis(kept, order, np.broadcast_to(np.arange(len(many)) - first < most, near.shape), 1)
            ok[:, many] &= kept
        return ok

    def sellers(self, kept: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Per target the number of known sellers among the kept rows."""
        seller = self.seller[cols]
        start, size = _runs(seller)
        many = np.repeat(size > 1, size)
        n = kept.sum(1)
        if many.any():
            some = kept[:, many]
            runs = size[size > 1]
            n += np.logical_or.reduceat(some, np.cumsum(runs) - runs, axis=1).sum(1) - some.sum(1)
        return n - kept[:, seller < 0].any(1)


def _one(c: pa.ChunkedArray | pa.Array) -> pa.Array:
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def _floats(c: pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(pc.cast(_one(c), pa.float64()), float("nan")).to_numpy(zero_copy_only=False)


def _codes(*cols: pa.ChunkedArray) -> np.ndarray:
    """A number for each value over all columns; -1 for null."""
    both = pa.concat_arrays([_one(c) for c in cols])
    return pc.fill_null(both.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)


def _runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal codes."""
    start = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
    return start, np.diff(np.r_[start, len(codes)])


def at_rank(kept: np.ndarray, values: np.ndarray, *ranks: np.ndarray) -> list[np.ndarray]:
    """Per row the values of these 0-based ranks among the kept ones, NaN where there are fewer; unknown values come last."""
    order = np.argsort(values, kind="stable")
    running = np.cumsum(kept[:, order], axis=1, dtype=np.int32)
    ends = np.r_[values[order], np.nan]
    return [ends[(running <= r[:, None]).sum(1)] for r in ranks]


def quantile(kept: np.ndarray, values: np.ndarray, n: np.ndarray, share: float) -> np.ndarray:
    """Per row the quantile of the kept values, ends included; n: how many there are."""
    at = (n - 1) * share
    low, high = np.floor(at), np.ceil(at)
    a, b = at_rank(kept, values, low, high)
    return np.where(low == high, a, (high - at) * a + (at - low) * b)


def sorted_quantile(xs: np.ndarray, start: np.ndarray, n: np.ndarray, share: float) -> np.ndarray:
    """Per row the quantile of n sorted values from a place on, ends included."""
    at, row = (n - 1) * share, np.arange(len(xs))
    low, high = np.floor(at), np.ceil(at)
    a, b = xs[row, start + low.astype(int)], xs[row, start + high.astype(int)]
    return np.where(low == high, a, (high - at) * a + (at - low) * b)
