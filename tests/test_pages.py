"""Page readers on pages written by hand: markup that trips patterns, layouts that must not be read, odd and long pages."""

import time

import pytest
from pyspark.sql import functions as F

from advertlake.functions import html as H
from advertlake.functions import pages as P
from advertlake.functions.numbers import let, running_sum

def today():
    return F.lit("2026-11-16").cast("date")


MARKUP = """<!DOCTYPE html><html><head><title> A &amp; B </title><style>x{}</style></head><body class="a>b"><div class="x main"><h1>One <b>two</b></h1><br><p>para<p>next<ul><li>u<li>v</ul>
<div class='y'>in &#8364;&#x20ac; &lt;3 &unknown;</div></div><!-- no <b> -->BMW<!-- -->118i<script>var a="<p>";</script>tail < 5 > 4</body></html>"""


def test_lines_elements_and_entities(spark):
    d = spark.createDataFrame([(1, MARKUP), (2, ""), (3, None), (4, "plain text"), (5, "<div class='main'>never closed")], "i int, h string")
    got = {r.i: r for r in d.select("i", H.title(F.col("h")).alias("t"), H.lines(F.col("h")).alias("l"), let(H.tokens(F.col("h")), lambda ts: F.struct(H.first_element(ts, "main").alias("m"), H.first_text(ts, "y").alias("y"), H.first_tag(ts, "h1").alias("h1"), H.first_tag(ts, "p").alias("p"))).alias("e")).collect()}
    assert got[1].t == "A & B" and got[1].l == ["One", "two", "para", "next", "u", "v", "in €€ <3 &unknown;", "BMW", "118i", "tail < 5 > 4"]
    assert got[1].e.m.text.split("\n")[-1] == "in €€ <3 &unknown;" and got[1].e.y == "in €€ <3 &unknown;" and (got[1].e.h1, got[1].e.p) == ("One two", "para")
    assert got[2].l == [] and got[2].e.m is None and got[4].l == ["plain text"] and got[5].e.m.text == "never closed"


def test_embedded_data(spark):
    data = '<script type="application/ld+json">{}</script>'
    pages = [
        (1, data.format('{"@graph":[{"@type":["Car","X"],"brand":{"name":"BMW"},"offers":{"price":"12.5"}}]}'), ("BMW", 12.5)), (2, data.format("no json") + data.format('{"@type":"Car","brand":"Audi"}'), (None, None)),
        (3, data.format('[{"@type":"Y"},{"@type":"Car","offers":{"price":3}}]'), (None, 3.0)), (4, data.format('{"@type":"Cars"}'), None),
    ]
    d = spark.createDataFrame([p[:2] for p in pages], "i int, h string").withColumn("n", H.first_of_type(F.col("h"), "Car"))
    for r in d.select("i", F.col("n").isNotNull().alias("found"), H.field(F.col("n"), "brand.name").alias("b"), H.field(F.col("n"), "offers.price", "double").alias("p")).collect():
        assert ((r.b, r.p) if r.found else None) == pages[r.i - 1][2]


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000])
def test_running_sum(spark, n):
    got = spark.range(1).select(running_sum(F.transform(F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>"), lambda x: x % 7 - 3)).alias("s")).first().s
    want, s = [], 0
    for x in range(1, n + 1):
        s += x % 7 - 3
        want.append(s)
    assert got == want


SOLD = "<title>BMW — Satıldı | x</title><body><p>a</p><p>2021 <!-- -->/<!-- --> BMW</p><b>BMW</b><b>118i</b><p>Bu araç satıldı.</p>{}</body>"
PAIRS = "<h3>Arşivdeki araç bilgileri</h3><p>Yıl</p><p>2021</p><p>Kilometre</p><p>25.000 km</p>"
VEHICLE = '<title>x</title><script type="application/ld+json">{"@type":"Vehicle","brand":"Kia","modelDate":"2013",%s}</script><body>%s</body>'
# (site, page) -> (layout, brand, year, km, amount, signals)
PAGES = [
    ("a", SOLD.format(PAIRS + "<p>Son ilan fiyatı</p><p>£19.000</p>"), ("satildi_block", "BMW", 2021, 25000, 19000.0, ["satildi"])),
    ("a", SOLD.format(PAIRS), ("satildi_block", "BMW", 2021, 25000, None, ["satildi", "fiyatsiz"])),
    ("a", SOLD.format("<p>nothing</p>"), ("satildi_block", None, None, None, None, None)),
    ("a", "<title>404</title><body>x</body>", (None, None, None, None, None, None)),
    ("a", VEHICLE % ('"offers":{"availability":"SoldOut","price":5}', ""), (None, None, None, None, None, None)),
    ("a", VEHICLE % ('"offers":{"availability":"InStock","price":6000,"priceCurrency":"GBP"}', ""), ("data", "Kia", 2013, None, 6000.0, None)),
    ("a", VEHICLE % ('"mileageFromOdometer":{"value":5,"unitCode":"SMI"}', "Fiyat Sorunuz"), ("data", "Kia", 2013, None, None, ["fiyatsiz"])),
    ("a", VEHICLE % ('"x":1', "<p>Açıklama</p><p>Fiyat Sorunuz</p>"), (None, None, None, None, None, None)),
    ("b", '<script type="application/ld+json">{"@type":"Car","offers":{"availability":"x/OutOfStock"}}</script><body>x</body>', ("b", None, None, None, None, ["satildi"])),
    ("b", '<script type="application/ld+json">{"@type":"Car","brand":{"name":"Nissan"},"vehicleModelDate":"2022"}</script><body><h1>2013 Model Juke</h1><p>Kilometre:</p><p>1.000 KM</p></body>', ("b", "Nissan", 2013, 1000, None, ["fiyatsiz"])),
    ("f", "<body><h1>Auris</h1><div class='vehica-car-attributes__name'>Marka:</div><div>Toyota</div><div class='vehica-car-price'>iletişime geç</div></body>", ("f", None, None, None, None, None)),
    ("d", "<body><p>İlan No:</p><p>777</p><p>Yıl:</p><p>2010</p></body>", (None, None, None, None, None, None)),
    ("z", "<body>x</body>", (None, None, None, None, None, None)), (None, None, (None, None, None, None, None, None)),
]


def test_layouts(spark):
    rows = [(i, s, h, ("1", "u", "t", "5.000 GBP", "l"), "clash") for i, (s, h, _) in enumerate(PAGES)]
    d = spark.createDataFrame(rows, "i int, site string, html string, card struct<item_id:string,url:string,title:string,price:string,label:string>, advert_ string")
    got = P.read_pages(d, today(), F.lit(2027), card="card").collect()
    assert len(got) == len(PAGES)
    for r in got:
        a = r.advert
        assert (r.layout, *((a.brand, a.year, a.km, a.price_amount, a.signals) if a else (None,) * 5)) == PAGES[r.i][2], PAGES[r.i]


DAYS = [("x · 1 Ağustos eklendi", "2026-08-01"), ("3 gün önce eklendi", "2026-11-13"), ("Dün eklendi", "2026-11-15"), ("Bugün eklendi", "2026-11-16"), ("20 Kasım eklendi", "2025-11-20"), ("31 Şubat eklendi", None), ("geçen yıl eklendi", None), ("x", None)]


def test_posted_phrases_and_archive_times(spark):
    d = spark.createDataFrame([(i, [t]) for i, (t, _) in enumerate(DAYS)], "i int, l array<string>")
    assert {r.i: r.d for r in d.select("i", P.posted_phrase(F.col("l"), today()).cast("string").alias("d")).collect()} == {i: w for i, (_, w) in enumerate(DAYS)}
    page = '<p>Arşive alınma tarihi</p><time dateTime="{}">x</time>'
    times = [("2026-10-01T01:49:17Z", True), ("2026-09-22T19:08:16Z", False), ("soon", False)]
    d = spark.createDataFrame([(i, page.format(t)) for i, (t, _) in enumerate(times)], "i int, h string")
    assert {r.i: r.x for r in d.select("i", P.archived_at(F.col("h")).isNotNull().alias("x")).collect()} == {i: w for i, (_, w) in enumerate(times)}


def test_cards_and_pages_are_merged(spark):
    a = P.advert(brand=F.lit("Kia"), model=F.lit("Rio"), year=F.lit(2013), fuel=F.lit("dizel"), location=F.lit("other"), price_amount=F.lit(5.0))
    b = P.advert(brand=F.lit("Kia"), model=F.lit("Ceed"), year=F.lit(2014), km=F.lit(7), fuel=F.lit("dizel"), location=F.lit("Girne / Lapta"), price_amount=F.lit(9.0), steering=F.lit("LHD"))
    r = spark.range(1).select(P.merged(a, b).alias("m")).first().m
    assert (r.advert.year, r.advert.km, r.advert.location, r.advert.price_amount, r.advert.steering) == (2013, 7, "Girne / Lapta", 5.0, "LHD") and r.conflicts == ["year", "model"]


def test_list_pages_of_json(spark):
    page = '<div data-page="{&quot;props&quot;:{&quot;listings&quot;:{&quot;total&quot;:2,&quot;data&quot;:[{&quot;uuid&quot;:&quot;u1&quot;,&quot;price&quot;:&quot;19000&quot;,&quot;currency&quot;:&quot;£&quot;,&quot;title&quot;:&quot; BMW &quot;,&quot;status&quot;:&quot;approved&quot;,&quot;contact_info&quot;:{&quot;mobile&quot;:&quot;0533 111 22 33&quot;}},{&quot;uuid&quot;:&quot;u2&quot;,&quot;price&quot;:&quot;&quot;,&quot;status&quot;:&quot;draft&quot;}]}}}">'
    d = spark.createDataFrame([(page,), ("<p>x</p>",)], "h string").select(P.site_g(F.col("h")).alias("x")).collect()
    one, two = d[0].x
    assert (one.item_id, one.active, one.advert.price_amount, one.advert.currency, one.advert.seller_phone, one.advert.raw_text) == ("u1", True, 19000.0, "GBP", "905331112233", "BMW")
    assert (two.item_id, two.active, two.advert.price_amount) == ("u2", False, None) and d[1].x is None


def test_time_grows_with_the_page(spark):
    def took(n):
        page = "<body>" + "<div class='field-title'>a</div><div class='content-value'><p>b</div>" * n + "<h1>x</h1></body>"
        d = spark.createDataFrame([(page,)], "h string").repartition(1)
        began = time.time()
        assert d.select(let(H.tokens(F.col("h")), lambda ts: H.first_tag(ts, "h1")).alias("x"), F.size(H.lines(F.col("h"))).alias("n")).first() == ("x", 2 * n + 1)
        return time.time() - began

    took(10)
    assert took(20_000) < 16 * max(0.5, took(5_000))
