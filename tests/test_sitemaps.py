"""Site maps: indexes, translations, repeated adverts, broken blocks, and sites whose maps can't be trusted."""

from pyspark.sql import functions as F

from advertlake.sources import sitemaps as M


def _map(*urls):
    return "<urlset>" + "".join(f"<url><loc>{u}</loc><lastmod>{m}</lastmod></url>" if m else f"<url>\n<loc>{u}</loc></url>" for u, m in urls) + "</urlset>"


def test_entries_and_children(spark):
    rows = [
        (1, "slug", 0, _map(("https://a.x/listing/one", "2026-01-02T03:04:05+02:00"), ("https://a.x/en/listing/one", None), ("https://a.x/listing/two", "soon"), ("https://a.x/listing/", None))),
        (1, "slug", 1, _map(("http://a.x/listing/one", "2020-01-01"))), (2, "number", 0, _map(("https://b.x/ilan/12-y", None), ("https://b.x/list", None))),
        (3, "advert", 0, "no map"), (4, "vehicle", 0, None), (5, "unknown", 0, _map(("https://a.x/listing/one", None))),
    ]
    got = M.entries(spark.createDataFrame(rows, "site int, kind string, part int, xml string")).select("site", "item_id", "url", F.unix_seconds("lastmod").alias("s")).collect()
    assert sorted(map(tuple, got), key=str) == [(1, "one", "https://a.x/listing/one", 1767315845), (1, "two", "https://a.x/listing/two", None), (2, "12", "https://b.x/ilan/12-y", None)]
    index = "<sitemapindex><sitemap><loc> https://a.x/maps/listings.xml </loc></sitemap><sitemap><loc>https://a.x/maps/hubs.xml</loc></sitemap><sitemap><loc>https://evil.y/listings.xml</loc></sitemap></sitemapindex>"
    both = spark.createDataFrame([(index,), ("<urlset/>",)], "xml string").select(M.children(F.col("xml"), F.lit("https://a.x")).alias("c")).collect()
    assert [r.c for r in both] == [["https://a.x/maps/listings.xml"], None]


def test_reading_list_and_changes(spark):
    now = F.lit("2026-03-01").cast("timestamp")
    urls = [(f"https://a.x/listing/{i:03}", f"2026-02-{1 + i % 27:02}T00:00:00Z" if i % 10 else None) for i in range(60)] + [("https://a.x/listing/old", "2025-01-01T00:00:00Z")]
    maps = spark.createDataFrame([(s, "slug", 0, _map(*urls[:n])) for s, n in ((1, 61), (2, 61), (3, 20))], "site int, kind string, part int, xml string")
    found, known = M.entries(maps), spark.createDataFrame([(1, "000"), (1, "010")], "site int, item_id string")
    todo = sorted((r.site, r.rank, r.item_id) for r in M.to_read(found, known, now, 5).collect())
    assert [t[2] for t in todo if t[0] == 1] == ["020", "030", "040", "050", "026"] and [t[2] for t in todo if t[0] == 2] == ["000", "010", "020", "030", "040"] and len(todo) == 15
    assert M.to_read(found, known, now, 100, None).filter("item_id = 'old'").count() == 2
    listings = spark.createDataFrame([(s, i, a, r) for s in (1, 2, 3) for i, a, r in (("zzz", True, None), ("001", False, "belirsiz"), ("002", False, "satildi"), ("003", True, None))], "site int, item_id string, is_active boolean, reason string")
    got = M.gone_and_back(found, listings, spark.createDataFrame([(2, 200)], "site int, size int")).collect()
    assert sorted(map(tuple, got)) == [(1, "001", "back"), (1, "zzz", "gone")]
