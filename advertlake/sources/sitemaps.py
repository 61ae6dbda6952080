"""Site maps as tables: the adverts that they name, what of them is to be read next, and what has gone from them or come back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from advertlake.functions.checks import map_shrunk

# fixed values: for each kind of site the address of an advert, its number or name as the group; translations of a page have a language before the path
ADDRESSES = {
    "slug": r"^https?://[^/]+/listing/([^/]+)$", "number": r"/ilan/(\d+)-", "advert": r"^https?://[^/]+/araba-ilani/([^/]+)/?$", "vehicle": r"^https?://[^/]+/vehicle/([^/]+)/?$",
}
MAX_NEW, MAX_AGE_DAYS, LEAST_MAP = 10, 60, 50


def children(xml: Column, base: Column) -> Column:
    """The maps of adverts that an index of maps names: addresses of the site whose last part says listing. Null for a map that is no index."""
    locs = F.transform(F.regexp_extract_all(xml, F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), lambda u: F.trim(u))
    return F.when(xml.contains("<sitemapindex"), F.filter(locs, lambda u: u.startswith(F.concat(base, F.lit("/"))) & F.regexp_extract(u, "([^/]*)$", 1).contains("listing")))


def entries(maps: DataFrame) -> DataFrame:
    """(site, item_id, url, lastmod, place) of maps (site, kind, part, xml): each advert once, by the first of its addresses; part orders the maps of a site. Pages in
    other languages, lists and addresses of other kinds are left out; a time that can't be read is null."""
    blocks = maps.select("site", "kind", "part", F.posexplode(F.regexp_extract_all("xml", F.lit("(?s)<url>(.*?)</url>"), F.lit(1))).alias("pos", "block"))
    loc = F.regexp_extract("block", r"(?s)<loc>(.*?)</loc>", 1)
    id_ = F.coalesce(*[F.when(F.col("kind") == k, F.regexp_extract(F.col("url"), p, 1)) for k, p in ADDRESSES.items()])
    rows = blocks.withColumn("url", loc).withColumn("item_id", id_).filter("item_id <> ''")
    lastmod = F.regexp_extract("block", r"(?s)<lastmod>(.*?)</lastmod>", 1).try_cast("timestamp")
    rows = rows.select("site", "item_id", F.struct("part", "pos").alias("place"), F.struct("url", lastmod.alias("lastmod")).alias("e"))
    first = rows.groupBy("site", "item_id").agg(F.min("place").alias("place"), F.min_by("e", "place").alias("e"))
    return first.select("site", "item_id", "e.url", "e.lastmod", "place")


def to_read(found: DataFrame, known: DataFrame, now: Column, max_new: int = MAX_NEW, max_age_days: int | None = MAX_AGE_DAYS) -> DataFrame:
    """(site, rank, item_id, url): of each site the adverts that are not known (site, item_id) and not too old, the newest first, an unknown time as now, at most
    max_new; ties in the order of the map. The ranking limits each site's rows before they meet."""
    new = found.join(known.select("site", "item_id"), ["site", "item_id"], "left_anti")
    if max_age_days is not None:
        new = new.filter(F.col("lastmod").isNull() | (F.unix_micros(now) - F.unix_micros("lastmod") <= max_age_days * 86_400_000_000))
    order = Window.partitionBy("site").orderBy(F.coalesce("lastmod", now).desc(), "place")
    return new.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max_new).select("site", "rank", "item_id", "url")


def gone_and_back(found: DataFrame, listings: DataFrame, last_sizes: DataFrame) -> DataFrame:
    """(site, item_id, change) of listings (site, item_id, is_active, reason): gone for active ones that the map lacks, back for closed ones of unknown reason
    (belirsiz) that it has. Nothing changes for a site whose map is small or shrank since its last size (site, size)."""
    sizes = found.groupBy("site").agg(F.count("*").alias("n")).join(last_sizes, "site", "left")
    sound = sizes.filter((F.col("n") > LEAST_MAP) & ~map_shrunk(F.col("size"), F.col("n"))).select("site")
    rows = listings.join(F.broadcast(sound), "site", "left_semi").join(found.select("site", "item_id", F.lit(True).alias("present")), ["site", "item_id"], "left")
    change = F.when(F.col("is_active") & F.col("present").isNull(), "gone").when(~F.col("is_active") & F.col("present") & (F.col("reason") == "belirsiz"), "back")
    return rows.select("site", "item_id", change.alias("change")).filter("change is not null")
