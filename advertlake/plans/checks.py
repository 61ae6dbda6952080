"""Queries of the small rules of reads, sources and adverts, and of brand curves, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from advertlake.functions import checks as C
from advertlake.functions.text import domain_matches, link_host
from advertlake.operators import curves
from advertlake.plans.curves import _CURVES, _r
from advertlake.session import table
from advertlake.settings import ANALOGUE as S
from advertlake.sources.listings import listings
from advertlake.sources.records import NOW, instants, records, records_sql


def source_checks(spark, d):
    s = records(spark, d).sources
    k = F.col("id")
    host = link_host(F.col("url"))
    return s.select(
        "id", C.read_failed(k % 9, k % 5).alias("read_failed"), C.removal_suspect(k % 11, k % 6).alias("removal_suspect"), C.map_shrunk(k % 50 * 2, k % 70).alias("shrunk"),
        domain_matches(host, "site3.example").alias("ours"), C.discovery_priority(k * 900, (k % 8).cast("double"), F.when(k % 3 == 0, "ogrenci").otherwise("arac")).alias("priority"),
    )


def advert_checks(spark, d):
    rows = records(spark, d).listings
    km = F.when(F.col("id") % 3 == 0, F.col("id") % 1200).otherwise(F.col("km")).cast("int")
    as_of = NOW.date()
    return rows.select(
        "id", C.km_unknown(km, F.col("year"), as_of).alias("km_unknown"), C.thousands_left_out(km, F.col("year"), F.lit(120000), as_of).alias("left_out"),
        C.newest_model_year(F.col("first_seen_at")).alias("newest"), F.unix_micros(C.local_time(F.col("first_seen_at"))).alias("local_us"),
        F.unix_micros(C.reference_date(F.col("posted_at"), F.when(F.col("id") % 2 == 0, F.col("last_seen_at")), F.col("first_seen_at"))).alias("ref_us"),
    )


def year_maps(spark, d):
    """The rows of each (brand, model) by year as a map, as its text, and back."""
    rows = records(spark, d).listings.dropna(subset=["brand_norm", "model_norm", "year"]).groupBy("brand_norm", "model_norm", "year").count()
    packed = rows.groupBy("brand_norm", "model_norm").agg(F.map_from_entries(F.collect_list(F.struct("year", "count"))).alias("m")).select("brand_norm", "model_norm", C.packed_years(F.col("m")).alias("packed"))
    return packed.select("brand_norm", "model_norm", "packed", F.aggregate(F.map_values(C.unpacked_years(F.col("packed"))), F.lit(0).cast("long"), lambda a, x: a + x).alias("rows"))


def brand_curves(spark, d):
    """Curves over all models of a brand, for models that have neither comparables nor a curve."""
    x = listings(spark, d).withColumn("model_norm", F.lit("*"))
    return curves.robust_curves(x, S).select("brand_norm", *_r("my", "b_age", "b_km", "sigma"), "n", "sellers")


def event_props(spark, d):
    """A row as JSON, a field of it as text with a default, and rows with a list that is not empty."""
    e = instants(table(spark, d, "events"))
    row = F.to_json(F.struct("event_id", "event_type", "user_id"))
    return e.select(
        "event_id", F.coalesce(F.get_json_object(row, "$.method"), F.lit("A")).alias("method"), F.get_json_object(row, "$.event_type").alias("kind"),
        F.concat_ws("|", "event_type", F.coalesce(F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string")), F.lit(""))).alias("key"),
        F.get_json_object("props", "$.k").rlike("(?i)^[0-9]{2}$").alias("two_digits"),
    )


QUERIES = {
    "PR29_PR31_PR32_PR33_DM48_source_checks": source_checks, "PR10_PR11_SF11_SF12_SF14_advert_checks": advert_checks, "SF31_SF32_SF33_year_maps": year_maps,
    "DM18_brand_curves": brand_curves, "SF21_SF23_SF26_SF30_event_props": event_props,
}
_HOST = "regexp_replace(lower(split_part(split_part(url, '://', 2), '/', 1)), '^(www|m|web|mobile)\\.', '')"
_EFF = "CASE WHEN k IN (123456, 1234567, 654321, 12345678) OR regexp_matches(k::VARCHAR, '^(1{6,7}|2{6,7}|3{6,7}|4{6,7}|5{6,7}|6{6,7}|7{6,7}|8{6,7}|9{6,7})$') OR coalesce((k < 1000 AND 2001 - year >= 2) OR (k < 15000 AND 2001 - year >= 10), false) THEN NULL ELSE k END"
ORACLE_SQL = {
    "PR29_PR31_PR32_PR33_DM48_source_checks": f"""WITH {records_sql("sources")} SELECT id, id % 9 >= 5 AND id % 5 >= 0.5 * (id % 9) AS read_failed, id % 11 >= 5 AND id % 6 >= 0.5 * (id % 11) AS removal_suspect,
  id % 50 > 0 AND id % 70 < id % 50 * 2 * 0.7::DOUBLE AS shrunk, {_HOST} = 'site3.example' OR {_HOST} LIKE '%.site3.example' AS ours,
  least(5, CASE WHEN id * 900 >= 10000 OR (id * 900 >= 2000 AND id % 8 >= 5) THEN 2 WHEN id * 900 >= 2000 OR id % 8 >= 5 THEN 3 ELSE 4 END + CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END)::INTEGER AS priority FROM sources""",
    "PR10_PR11_SF11_SF12_SF14_advert_checks": f"""WITH {records_sql("listings")}, x AS (SELECT *, CASE WHEN id % 3 = 0 THEN id % 1200 ELSE km END AS k FROM listings), y AS (SELECT *, {_EFF} AS e FROM x)
SELECT id, coalesce(e = 0, true) AS km_unknown, coalesce(k BETWEEN 1 AND 999 AND e IS NULL AND k * 1000 > 120000 * 1.3::DOUBLE AND k * 1000 - 120000 >= 10000, false) AS left_out, year(first_seen_at) + 1 AS newest,
  epoch_us(timezone('Asia/Famagusta', timezone('UTC', first_seen_at))) AS local_us, epoch_us(coalesce(posted_at, CASE WHEN id % 2 = 0 THEN last_seen_at END, first_seen_at)) AS ref_us FROM y""",
    "SF31_SF32_SF33_year_maps": f"""WITH {records_sql("listings")}, g AS (SELECT brand_norm, model_norm, year, count(*) AS n FROM listings WHERE brand_norm IS NOT NULL AND model_norm IS NOT NULL AND year IS NOT NULL GROUP BY ALL)
SELECT brand_norm, model_norm, string_agg(year || ':' || n, ',' ORDER BY year) AS packed, sum(n)::BIGINT AS rows FROM g GROUP BY ALL""",
    "DM18_brand_curves": f"""WITH {_CURVES.replace("p_type AS model_norm", "'*' AS model_norm")} SELECT brand_norm, round(my, 5) AS my, round(b_age, 5) AS b_age, round(b_km, 5) AS b_km, round(sigma, 5) AS sigma, n, sellers FROM curve""",
    "SF21_SF23_SF26_SF30_event_props": """SELECT event_id, 'A' AS method, event_type AS kind, event_type || '|' || CASE WHEN event_id % 2 = 0 THEN user_id::VARCHAR ELSE '' END AS key,
  regexp_matches(json_extract_string(props, '$.k'), '^[0-9]{2}$') AS two_digits FROM events""",
}
