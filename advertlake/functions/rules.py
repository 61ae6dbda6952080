"""Row rules of adverts as columns: usable mileage, seller keys, confidence, profit tiers, freshness."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from advertlake.settings import Settings

# fixed values: mileages that people type as placeholders
PLACEHOLDER_KM = [123456, 1234567, 654321, 12345678]
STRONG, NEGOTIABLE, ESTIMATED, NONE = "guclu", "pazarlik", "tahmini", "yok"
HIGH, MEDIUM, LOW = "yuksek", "orta", "dusuk"


def effective_km(km: Column, year: Column, as_of: dt.date) -> Column:
    """Mileage that can be believed, else null: no placeholder, no single digit repeated 6 or 7 times, not too low for the age."""
    age = F.lit(as_of.year) - year
    odd = km.isin(PLACEHOLDER_KM) | km.cast("string").rlike(r"^([1-9])\1{5,6}$")
    low = F.coalesce(((km < 1000) & (age >= 2)) | ((km < 15000) & (age >= 10)), F.lit(False))
    return F.when(~odd & ~low, km)


def seller_key(handle: Column, phone: Column, id_: Column, prefix: str) -> Column:
    """Phone, else a handle that carries the prefix of a site's own accounts, else the advert itself."""
    own = handle.startswith(prefix) & (F.length(handle) > len(prefix))
    return F.when(F.length(phone) > 0, phone).when(own, handle).otherwise(F.concat(F.lit("id:"), id_.cast("string")))


def km_adjusted(price: Column, km_to: Column, km_from: Column, per_10k: float) -> Column:
    return F.when(km_to.isNotNull() & km_from.isNotNull(), price * F.exp(-per_10k * (km_to - km_from) / 10000)).otherwise(price)


def confidence(n: Column) -> Column:
    return F.when(n >= 20, HIGH).when(n >= 8, MEDIUM).when(n >= 3, LOW).otherwise(NONE)


def profit(price: Column, median: Column, s: Settings) -> Column:
    return s.quick_sale_factor * median - price - s.fixed_cost


def tier(price: Column, median: Column, n: Column, s: Settings) -> Column:
    """Tier after five demotions, in order: too few comparables, thin market, thin strong, small profit, absurd price."""
    gain = profit(price, median, s)
    pct = gain / price
    thin = n < s.rich_comparables
    first = F.when(n < s.min_comparables, NONE).when(pct >= s.strong_threshold, STRONG).when(pct >= s.negotiable_threshold, NEGOTIABLE).otherwise(NONE)
    second = F.when(thin & (pct < s.thin_min_profit), NONE).when(thin & (first == STRONG), NEGOTIABLE).otherwise(first)
    third = F.when((second == STRONG) & (gain < s.min_strong_profit), NEGOTIABLE).otherwise(second)
    absurd = price < s.absurd_price_ratio * median
    return F.when(absurd & thin, NONE).when(absurd & (third == STRONG), NEGOTIABLE).otherwise(third)


def buy_ceiling(median: Column, s: Settings) -> Column:
    """Highest price that still makes both the strong share and the least strong profit."""
    exit_ = s.quick_sale_factor * median
    return F.least((exit_ - s.fixed_cost) / (1 + s.strong_threshold), exit_ - s.fixed_cost - s.min_strong_profit)


def inactive_reason(signals: Column) -> Column:
    return F.when(F.array_contains(signals, "satildi"), "satildi").when(F.array_contains(signals, "kaldirildi"), "kaldirildi").otherwise("belirsiz")


def placeholder_amount(amount: Column) -> Column:
    """Whole amounts of one repeated digit (5 or more), or the first digits of 1234567890 (4 or more) or 9876543210 (5 or more)."""
    t = amount.cast("long").cast("string")
    whole = amount == F.floor(amount)
    up, down = F.lit("1234567890").startswith(t) & (F.length(t) >= 4), F.lit("9876543210").startswith(t) & (F.length(t) >= 5)
    return whole & (t.rlike(r"^(\d)\1{4,}$") | up | down)


def is_fresh(first_seen: Column, posted: Column, now: Column, hours: int = 36, post_days: int = 4) -> Column:
    seen = F.timestamp_seconds(F.unix_timestamp(now) - hours * 3600)
    return (first_seen >= seen) & (posted.isNull() | (posted >= F.timestamp_seconds(F.unix_timestamp(now) - post_days * 86400)))
