"""Queries of copies of adverts by post text, across sites, and of the urgent lock, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from advertlake.operators import reads as R
from advertlake.operators import twins as T
from advertlake.sources.records import NOW, records, records_sql


def _posts(r):
    """Adverts of few texts, so that many are posted again."""
    amount = F.when(F.col("id") % 4 != 0, F.floor(F.col("id") / 8) % 3 * 1000)
    return r.listings.select(
        "id", "brand_norm", "model_norm", F.lit(1995).alias("year"), F.when(F.col("id") % 11 != 0, F.md5((F.col("id") % 7).cast("string").cast("binary"))).alias("text_fp"),
        amount.cast("double").alias("price_amount"), "currency", F.when(F.col("id") % 3 == 0, F.col("id") % 5 * 40000).cast("int").alias("km"),
        F.when(F.col("id") % 2 == 0, (F.col("id") % 4).cast("string")).alias("seller_phone"), "is_active", "first_seen_at",
    )


def _sided(r, source: int):
    rows = r.listings.filter(F.col("source_id") == source)
    district = F.when(F.col("id") % 3 != 0, F.concat(F.lit("d"), (F.col("id") % 4).cast("string")))
    return rows.select("id", "brand_norm", "model_norm", "year", F.round(F.col("price_amount") / 100000).alias("price_amount"), F.lit("GBP").alias("currency"), "first_seen_at", district.alias("district"), "transmission", F.lit(None).cast("string").alias("fuel"))


def same_posts(spark, d):
    return T.same_posts(_posts(records(spark, d)), NOW.date())


def site_twins(spark, d):
    r = records(spark, d)
    return T.site_twins(_sided(r, 1), _sided(r, 2), 24 * 200)


def locked(spark, d):
    r = records(spark, d)
    sent = R.urgent_sent(r, r.listings.filter("id % 5 = 0").select("id"), 2500)
    return T.locked(r.listings.filter("id % 5 <> 0"), sent)


QUERIES = {"DM28_same_posts": same_posts, "DM29_DM31_site_twins": site_twins, "DM32_DM33_urgent_lock": locked}
_WITH = f"WITH {records_sql()}"
_KM = "CASE WHEN regexp_matches(km::VARCHAR, '^(1{6,7}|2{6,7}|3{6,7}|4{6,7}|5{6,7}|6{6,7}|7{6,7}|8{6,7}|9{6,7})$') OR (km < 1000) THEN NULL ELSE km END"
_SIDE = "(SELECT *, CASE WHEN id % 3 <> 0 THEN 'd' || (id % 4) END AS district, round(price_amount / 100000) AS amount FROM listings WHERE source_id = {0} AND model_norm IS NOT NULL AND brand_norm IS NOT NULL AND year IS NOT NULL)"
ORACLE_SQL = {
    "DM28_same_posts": f"""{_WITH},
p AS (SELECT id, brand_norm, model_norm, id % 7 AS fp, CASE WHEN id % 4 <> 0 THEN id // 8 % 3 * 1000 END AS amount, currency, CASE WHEN id % 3 = 0 THEN id % 5 * 40000 END AS km0, CASE WHEN id % 2 = 0 THEN (id % 4)::VARCHAR END AS phone, is_active, first_seen_at
  FROM listings WHERE id % 11 <> 0 AND model_norm IS NOT NULL),
q AS (SELECT *, CASE WHEN km0 >= 15000 THEN km0 END AS km FROM p)
SELECT a.id, arg_min(b.id, (b.first_seen_at, b.id)) AS canonical FROM q a JOIN q b ON b.brand_norm = a.brand_norm AND b.model_norm = a.model_norm AND b.fp = a.fp AND (b.amount IS NULL) = (a.amount IS NULL)
  AND (a.amount IS NULL OR (a.amount = b.amount AND a.currency = b.currency)) AND (a.km IS NULL OR b.km IS NULL OR abs(a.km - b.km) <= greatest(500, 0.02 * greatest(a.km, b.km)))
  AND (a.phone IS NULL OR b.phone IS NULL OR a.phone = b.phone) AND (b.is_active OR NOT a.is_active) AND (b.first_seen_at, b.id) < (a.first_seen_at, a.id) GROUP BY a.id""",
    "DM29_DM31_site_twins": f"""{_WITH},
m AS (SELECT a.id, b.id AS canonical FROM {_SIDE.format(1)} a JOIN {_SIDE.format(2)} b ON a.brand_norm = b.brand_norm AND a.model_norm = b.model_norm AND a.year = b.year AND a.amount = b.amount
  AND b.first_seen_at BETWEEN a.first_seen_at - INTERVAL 200 DAY AND a.first_seen_at + INTERVAL 200 DAY AND NOT coalesce(a.district <> b.district, false) AND NOT coalesce(a.transmission <> b.transmission, false))
SELECT id, canonical FROM m QUALIFY count(*) OVER (PARTITION BY id) = 1 AND count(*) OVER (PARTITION BY canonical) = 1""",
    "DM32_DM33_urgent_lock": f"""{_WITH},
s AS (SELECT l.*, coalesce(a.price_sent, l.price_gbp) AS before FROM listings l LEFT JOIN (SELECT * FROM alerts WHERE tier = 'acil' QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY sent_at, evaluation_id) = 1) a ON a.listing_id = l.id
  WHERE l.id % 5 = 0 AND coalesce(a.sent_at, l.first_seen_at) > TIMESTAMP '{NOW}' - INTERVAL 2500 DAY)
SELECT l.id, max(CASE WHEN s.seller_phone = l.seller_phone THEN 'telefon' ELSE 'arac' END) AS reason FROM listings l JOIN s ON s.id <> l.id AND (s.seller_phone = l.seller_phone OR (s.brand_norm IS NOT DISTINCT FROM l.brand_norm
  AND s.model_norm IS NOT DISTINCT FROM l.model_norm AND s.year IS NOT DISTINCT FROM l.year AND s.before > 0 AND l.price_gbp > 0 AND abs(l.price_gbp - s.before) <= 0.05::DOUBLE * s.before + 0.005::DOUBLE)) WHERE l.id % 5 <> 0 GROUP BY l.id""",
}
