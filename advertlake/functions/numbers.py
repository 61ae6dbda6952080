"""Order statistics over sorted arrays, as columns: medians, inclusive and exclusive quartiles, robust spread."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(v) with v bound to the value, so that what v is used for often is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _at(xs: Column, i: Column) -> Column:
    return F.get(xs, i.cast("int"))


def median_of(xs: Column) -> Column:
    """Median of a sorted array; null for an empty one."""
    n = F.size(xs)
    mid = F.floor(n / 2)
    return F.when(n % 2 == 1, _at(xs, mid)).otherwise((_at(xs, mid - 1) + _at(xs, mid)) / 2)


def quartile_inclusive(xs: Column, i: int) -> Column:
    """i-th quartile of a sorted array, ends included (what percentile() gives); a single value is every quartile."""
    m = F.size(xs) - 1
    j = F.floor(i * m / 4)
    d = i * m - j * 4
    return F.when(F.size(xs) == 1, _at(xs, F.lit(0))).otherwise((_at(xs, j) * (4 - d) + F.coalesce(_at(xs, j + 1), F.lit(0.0)) * d) / 4)


def quartile_exclusive(xs: Column, i: int) -> Column:
    """i-th quartile of a sorted array of at least two values, ends excluded: rank i (n + 1) / 4, kept within the array."""
    n = F.size(xs)
    j = F.greatest(F.lit(1), F.least(F.floor(i * (n + 1) / 4), n - 1))
    d = i * (n + 1) - j * 4
    return (_at(xs, j - 1) * (4 - d) + _at(xs, j) * d) / 4


def quartile_weight(rank: Column, n: Column, i: int) -> Column:
    """The weight, in quarters, of the value of this 1-based rank in the exclusive i-th quartile of n values: their weighted sum is the quartile."""
    j = F.greatest(F.lit(1), F.least(F.floor(i * (n + 1) / 4), n - 1))
    d = i * (n + 1) - j * 4
    return F.when(rank == j, 4 - d).when(rank == j + 1, d).otherwise(0)


def ratio_close(a: Column, b: Column, share: float, floor: float = 0.0) -> Column:
    """|a - b| within a share of the larger of the two, or within floor."""
    return F.abs(a - b) <= F.greatest(F.lit(floor), share * F.greatest(a, b))


def running_sum(xs: Column, block: int = 128) -> Column:
    """Sums of an array up to each place. Built in blocks, so that no long array is copied for each of its entries."""

    def sums(ys: Column, start: Column) -> Column:
        grown = F.aggregate(ys, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        return F.slice(grown, 2, F.greatest(F.size(ys), F.lit(0)))

    zero = F.lit(0).cast("long")

    def blocks_of(ys: Column) -> Column:
        n = F.ceil(F.size(ys) / block).cast("int")
        cut = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.transform(F.slice(ys, k * block + 1, F.lit(block)), lambda x: x.cast("long")))
        return F.when(n > 0, cut).otherwise(F.array().cast("array<array<bigint>>"))

    def joined(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda acc, x: acc + x))
        return let(sums(totals, zero), lambda ends: F.flatten(F.transform(blocks, lambda b, k: sums(b, F.when(k > 0, F.get(ends, k - 1)).otherwise(zero)))))

    return let(let(xs, blocks_of), joined)
