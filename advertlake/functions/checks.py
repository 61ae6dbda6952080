"""Small rules of reads, sources and adverts as columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from advertlake.functions.rules import effective_km

# fixed values: shares and least numbers from which a read, a wave of removals or a site map is suspect
READ_FAIL_LEAST, READ_FAIL_SHARE = 5, 0.5
REMOVED_LEAST, REMOVED_SHARE = 5, 0.5
MAP_SHRINK_SHARE = 0.7


def read_failed(fetched: Column, failed: Column) -> Column:
    """So many pages of a round could not be read that the site's template has probably changed."""
    return (fetched >= READ_FAIL_LEAST) & (failed >= READ_FAIL_SHARE * fetched)


def removal_suspect(checked: Column, removed: Column) -> Column:
    return (checked >= REMOVED_LEAST) & (removed >= REMOVED_SHARE * checked)


def map_shrunk(last: Column, size: Column) -> Column:
    """A site map lost more than it can between two reads; an unknown or empty last size is no measure."""
    return F.coalesce((last > 0) & (size < last * MAP_SHRINK_SHARE), F.lit(False))


def km_unknown(km: Column, year: Column, as_of: dt.date) -> Column:
    return F.coalesce(effective_km(km, year, as_of) == 0, F.lit(True))


def thousands_left_out(km: Column, year: Column, median_km: Column, as_of: dt.date, ratio: float = 1.3, margin: float = 10_000) -> Column:
    """A mileage of 1 to 999 that cannot be believed, and that as thousands would lie clearly above the market's median."""
    small = km.between(1, 999) & effective_km(km, year, as_of).isNull()
    return F.coalesce(small & (km * 1000 > median_km * ratio) & (km * 1000 - median_km >= margin), F.lit(False))


def newest_model_year(today: Column) -> Column:
    return F.year(today) + 1


def local_time(moment: Column) -> Column:
    return F.from_utc_timestamp(moment, "Asia/Famagusta")


def reference_date(posted: Column, data_as_of: Column, first_seen: Column) -> Column:
    """The instant that an advert's age counts from."""
    return F.coalesce(posted, data_as_of, first_seen)


def discovery_priority(members: Column, posts_per_day: Column, kind: Column) -> Column:
    """When to read a group that was found: large and lively ones first, trade and student groups a step later, 5 at the latest."""
    m, p = F.greatest(F.coalesce(members, F.lit(0)), F.lit(0)), F.greatest(F.coalesce(posts_per_day, F.lit(0.0)), F.lit(0.0))
    size = F.when((m >= 10_000) | ((m >= 2_000) & (p >= 5)), 2).when((m >= 2_000) | (p >= 5), 3).otherwise(4)
    later = F.coalesce(kind.isin("alim_satim", "ogrenci"), F.lit(False)).cast("int")
    return F.least(F.lit(5), size + later)


def packed_years(years: Column) -> Column:
    """A map of years to numbers as text 'year:n,...' in the order of the years."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(years)), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",")


def unpacked_years(text: Column) -> Column:
    return F.map_from_entries(F.transform(F.filter(F.split(text, ","), lambda p: p != ""), lambda p: F.struct(F.split_part(p, F.lit(":"), F.lit(1)).cast("int").alias("key"), F.split_part(p, F.lit(":"), F.lit(2)).cast("long").alias("value"))))
