"""Copies of adverts by other evidence than mileage: the same post text, the same car on two sites, and the lock of the urgent alert. All candidates
come from joins by equality; no group is gathered."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advertlake.functions.numbers import ratio_close
from advertlake.functions.rules import effective_km
from advertlake.sources.shared import persisted

_CAR = ["brand_norm", "model_norm", "year"]
SLACK = 0.005


def _differ(a: Column, b: Column) -> Column:
    return F.coalesce((a != b) & (a != "") & (b != ""), F.lit(False))


def same_posts(rows: DataFrame, as_of: dt.date) -> DataFrame:
    """(id, canonical): each row with the earliest row before it that is the same post: model known, equal fingerprint (text_fp), both without a price
    or with the same amount and currency, believable mileages not apart, phones not different; an active row only follows an active one.

    A group of reposts is cut down to its distinct (phone, mileage, active) with the first row of each, so a text that is posted very often meets
    few rows."""
    key = [*_CAR, "text_fp", "amount_key"]
    amount = F.when(F.col("price_amount").isNull(), "none").when(F.length("currency") > 0, F.concat_ws(" ", F.col("price_amount").cast("string"), "currency"))
    t = rows.dropna(subset=[*_CAR, "text_fp"]).withColumn("amount_key", amount).filter("amount_key is not null")
    t = t.select("id", *key, F.nullif(F.coalesce("seller_phone", F.lit("")), F.lit("")).alias("phone"), effective_km(F.col("km"), F.col("year"), as_of).alias("km"), "is_active", "first_seen_at")
    order = F.struct("first_seen_at", "id")
    heads = t.groupBy(*key, F.col("phone").alias("h_phone"), F.col("km").alias("h_km"), F.col("is_active").alias("h_active")).agg(F.min(order).alias("head"))
    apart = F.coalesce((F.col("km") > 0) & (F.col("h_km") > 0) & ~ratio_close(F.col("km"), F.col("h_km"), 0.02, 500), F.lit(False))
    met = t.join(heads, key).filter(~apart & ~_differ(F.col("phone"), F.col("h_phone")) & (F.col("h_active") | ~F.col("is_active")) & (F.col("head") < order))
    return met.groupBy("id").agg(F.min("head").alias("head")).select("id", F.col("head.id").alias("canonical"))


def site_twins(lean: DataFrame, rich: DataFrame, window_hours: int) -> DataFrame:
    """(id, canonical): adverts of a site that names neither mileage nor phone with the advert of another site that is the same car: same keys with
    the model known, same amount and currency, first seen within the window, district, gear and fuel not in conflict; only pairs that are each
    other's only match. Columns: id, keys, price_amount, currency, first_seen_at, district, transmission, fuel."""
    key = [*_CAR, "price_amount", "currency"]
    wide = window_hours * 3_600_000_000
    at = F.unix_micros("first_seen_at")
    traits = ["district", "transmission", "fuel"]
    a = lean.dropna(subset=key).select("id", *key, *traits, at.alias("at"), F.floor(at / wide).alias("bucket"))
    b = rich.dropna(subset=key).select(F.col("id").alias("r_id"), *key, *[F.col(c).alias(f"r_{c}") for c in traits], at.alias("r_at"), F.floor(at / wide).alias("home"))
    b = b.withColumn("bucket", F.explode(F.array(F.col("home") - 1, F.col("home"), F.col("home") + 1)))
    clash = _differ(F.col("district"), F.col("r_district")) | _differ(F.col("transmission"), F.col("r_transmission")) | _differ(F.col("fuel"), F.col("r_fuel"))
    pairs = a.join(b, [*key, "bucket"]).filter((F.abs(F.col("at") - F.col("r_at")) <= wide) & ~clash).select("id", "r_id")
    one = pairs.groupBy("id").agg(F.count("*").alias("n"), F.min("r_id").alias("r_id")).filter("n = 1")
    other = pairs.groupBy("r_id").agg(F.count("*").alias("m")).filter("m = 1")
    return one.join(other, "r_id").select("id", F.col("r_id").alias("canonical"))


def locked(rows: DataFrame, sent: DataFrame, share: float = 0.05) -> DataFrame:
    """(id, reason): adverts that an urgent alert already went out for: 'telefon' for the same phone (7 digits or more), 'arac' for the same car within
    a share of the price then. sent: id, keys, seller_phone, price_gbp of the alerts within the lock's days.

    No pairs: of a phone the smallest and the largest id tell whether another advert has it. A car's prices lie in cells by the logarithm of price + SLACK /
    share, so narrow that prices of one cell are always close and so wide that close ones are at most `reach` cells apart. Of a cell below a row's own only
    the highest price matters, of one above the lowest, each with the one behind it of another id; a row meets one short list of these."""
    digits = F.regexp_replace(F.coalesce("seller_phone", F.lit("")), "[^0-9]", "")
    phone = F.when(F.length(digits) >= 7, digits)
    width = 0.99 * math.log(1 + share)
    reach = math.ceil(-math.log(1 - share) / width)
    price = F.when(F.col("price_gbp") > 0, F.col("price_gbp"))
    cell = F.floor(F.ln(price + SLACK / share) / width)
    known = [F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in _CAR]
    a = rows.select("id", *known, phone.alias("phone"), price.alias("price"), cell.alias("cell"))
    s = persisted(sent.select(F.col("id").alias("s_id"), *known, phone.alias("phone"), price.alias("before"), cell.alias("home")))

    phones = s.dropna(subset=["phone"]).groupBy("phone").agg(F.min("s_id").alias("least"), F.max("s_id").alias("most"))
    by_phone = a.dropna(subset=["phone"]).join(phones, "phone").filter((F.col("least") != F.col("id")) | (F.col("most") != F.col("id"))).select("id", F.lit("telefon").alias("reason"))

    one, key = F.struct("before", "s_id"), [*_CAR, "home"]
    priced = s.dropna(subset=["before"])
    ends = priced.groupBy(*key).agg(F.max(one).alias("top"), F.min(one).alias("low"))
    next_top, next_low = F.max(F.when(F.col("s_id") != F.col("top.s_id"), one)), F.min(F.when(F.col("s_id") != F.col("low.s_id"), one))
    cells = priced.join(ends, key).groupBy(*key).agg(F.first("top").alias("top"), F.first("low").alias("low"), next_top.alias("top2"), next_low.alias("low2"))
    near = cells.select(*_CAR, F.explode(F.sequence(F.col("home") - reach, F.col("home") + reach)).alias("cell"), F.array_distinct(F.array_compact(F.array("top", "low", "top2", "low2"))).alias("ends"))
    near = near.groupBy(*_CAR, "cell").agg(F.flatten(F.collect_list("ends")).alias("ends"))
    close = lambda e: (e["s_id"] != F.col("id")) & (F.abs(F.col("price") - e["before"]) <= share * e["before"] + SLACK)
    by_car = a.dropna(subset=["price"]).join(near, [*_CAR, "cell"]).filter(F.exists("ends", close)).select("id", F.lit("arac").alias("reason"))
    return by_phone.unionByName(by_car).groupBy("id").agg(F.max("reason").alias("reason"))
