"""Queries of the site maps: orders as adverts of four sites, whose maps are written as XML with lists, other languages and broken times among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from advertlake.session import table
from advertlake.sources import sitemaps as M

KINDS = list(M.ADDRESSES)
_NOW = "1998-08-01 00:00:00"


def made_maps(spark: SparkSession, d: str) -> DataFrame:
    """site, kind, part, xml: a fifth of the orders is on no map."""
    o = table(spark, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    k, kind = F.col("o_orderkey"), F.element_at(F.array(*[F.lit(x) for x in KINDS]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    base, key = F.concat(F.lit("https://s"), (k % 4).cast("string"), F.lit(".example")), k.cast("string")
    path = F.when(kind == "slug", F.concat(F.lit("/listing/a-"), key)).when(kind == "number", F.concat(F.lit("/ilan/"), key, F.lit("-x"))).when(kind == "advert", F.concat(F.lit("/araba-ilani/a-"), key, F.lit("/"))).otherwise(
        F.concat(F.lit("/vehicle/a-"), key))
    mod = F.when(k % 11 == 0, "").when(k % 13 == 0, "<lastmod>soon</lastmod>").otherwise(F.concat(F.lit("<lastmod>"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ssXXX"), F.lit("</lastmod>")))
    block = F.concat(F.lit("<url>\n<loc>"), base, path, F.lit("</loc>"), mod, F.lit("</url>"))
    more = F.when(kind == "slug", F.concat(F.lit("<url><loc>"), base, F.lit("/en"), path, F.lit("</loc></url><url><loc>"), base, path, F.lit("</loc></url>"))).otherwise(F.concat(F.lit("<url><loc>"), base, F.lit("/vehicles/</loc></url>")))
    rows = o.filter(k % 5 != 4).select((k % 4).alias("site"), kind.alias("kind"), F.floor(k / 1000).alias("part"), F.struct(k.alias("k"), F.concat(block, more).alias("x")).alias("x"))
    xml = F.concat(F.lit("<urlset>"), F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["x"]), "\n"), F.lit("</urlset>"))
    return rows.groupBy("site", "kind", "part").agg(xml.alias("xml"))


def _listings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    id_ = F.when(k % 4 == 1, k.cast("string")).otherwise(F.concat(F.lit("a-"), k.cast("string")))
    return table(spark, d, "orders").filter("o_custkey % 3 = 0").select((k % 4).alias("site"), id_.alias("item_id"), (F.col("o_orderstatus") != "F").alias("is_active"), F.when(F.col("o_custkey") % 2 == 0, "belirsiz").otherwise("satildi").alias("reason"))


def map_entries(spark: SparkSession, d: str) -> DataFrame:
    return M.entries(made_maps(spark, d)).select("site", "item_id", "url", F.unix_seconds("lastmod").alias("lastmod_s"))


def reading_list(spark: SparkSession, d: str) -> DataFrame:
    return M.to_read(M.entries(made_maps(spark, d)), _listings(spark, d), F.lit(_NOW).cast("timestamp"), 25)


def map_changes(spark: SparkSession, d: str) -> DataFrame:
    """The map of one site had been larger by far, so that nothing is closed there."""
    n = table(spark, d, "orders").count()
    last = spark.createDataFrame([(0, n // 5), (1, n), (2, None)], "site long, size long")
    return M.gone_and_back(M.entries(made_maps(spark, d)), _listings(spark, d), last)


QUERIES = {"SC23_SC24_SC25_SC26_map_entries": map_entries, "SL06_SM38_JN29_reading_list": reading_list, "SM38_JN30_map_changes": map_changes}
_E = """WITH e AS (SELECT o_orderkey AS k, o_orderkey % 4 AS site, CASE WHEN o_orderkey % 4 = 1 THEN '' ELSE 'a-' END || o_orderkey AS item_id,
  'https://s' || (o_orderkey % 4) || '.example' || CASE o_orderkey % 4 WHEN 0 THEN '/listing/a-' || o_orderkey WHEN 1 THEN '/ilan/' || o_orderkey || '-x' WHEN 2 THEN '/araba-ilani/a-' || o_orderkey || '/' ELSE '/vehicle/a-' || o_orderkey END AS url,
  CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 THEN date_trunc('second', o_orderdate::TIMESTAMP) END AS lastmod FROM orders WHERE o_orderkey % 5 <> 4),
l AS (SELECT o_orderkey % 4 AS site, CASE WHEN o_orderkey % 4 = 1 THEN '' ELSE 'a-' END || o_orderkey AS item_id, o_orderstatus <> 'F' AS is_active, o_custkey % 2 = 0 AS vague FROM orders WHERE o_custkey % 3 = 0)"""
ORACLE_SQL = {
    "SC23_SC24_SC25_SC26_map_entries": f"{_E} SELECT site, item_id, url, epoch(lastmod)::BIGINT AS lastmod_s FROM e",
    "SL06_SM38_JN29_reading_list": f"""{_E} SELECT site, row_number() OVER (PARTITION BY site ORDER BY coalesce(lastmod, TIMESTAMP '{_NOW}') DESC, k)::INTEGER AS rank, item_id, url FROM e
WHERE (site, item_id) NOT IN (SELECT (site, item_id) FROM l) AND (lastmod IS NULL OR TIMESTAMP '{_NOW}' - lastmod <= INTERVAL 60 DAY) QUALIFY rank <= 25""",
    "SM38_JN30_map_changes": f"""{_E} SELECT l.site, l.item_id, CASE WHEN is_active THEN 'gone' ELSE 'back' END AS change FROM l LEFT JOIN e USING (site, item_id)
WHERE l.site <> 1 AND ((is_active AND e.k IS NULL) OR (NOT is_active AND e.k IS NOT NULL AND vague))""",
}
