"""Queries of the page readers. Each row of pages becomes a page of one of the sites' layouts with its own make, year, mileage, price and day; the SQL knows the
numbers and the layout, and never sees the markup. The visible lines are those of the table's own pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from advertlake.functions import html as H
from advertlake.functions import pages as P
from advertlake.functions.price import parse_price
from advertlake.session import table

CARS = [("BMW", "X5"), ("Toyota", "Vitz"), ("Mercedes-Benz", "C 180"), ("Land Rover", "Freelander 2.0")]
TODAY, NEWEST = "2026-11-16", 2027
_DATA = '<script type="application/ld+json">{}</script>'
_PAIRS = "<dl><dt>Yıl</dt><dd>{year}</dd><dt>Kilometre</dt><dd>{km.} km</dd><dt>%s</dt><dd>Dizel</dd><dt>Vites</dt><dd>Otomatik</dd>%s</dl>"
# layout -> (site, page, [fuel, gear, engine, steering, place, currency, posted in month, negotiable, seller type, signals, has: km, price, make])
LAYOUTS = {
    "labels": ("a", "<html><head><title>{make} {model} {year} - {price.}£ - Site</title><style>p{}</style></head><body data-x=\"a>b\"><h2>Araç Detayları</h2><ul><li><i>Marka</i><b>{make}</b><li><i>Model</i>"
        "<b>{model}</b></ul>" + _PAIRS % ("Yakıt Tipi", "<dt>Motor Hacmi</dt><dd>2.0 L</dd><dt>Konum</dt><dd>Girne</dd>") + "<a href=\"/seller/59974999-2294\">x</a><h3>Açıklama</h3><p>sağ direksiyon, pazarlık olur</p>"
        "<h3>Keşfet</h3><span>{day}.09.2026</span></body></html>", ["dizel", "otomatik", 2.0, "RHD", "Girne", "GBP", 9, True, None, None]),
    "satildi_block": ("a", "<title>{make} — Satıldı | Site</title><body><p>x</p><b>{make}</b><b>{model}</b><p>Bu araç satıldı.</p><p>Son ilan fiyatı</p><p>£{price.}</p><h3>Arşivdeki araç bilgileri</h3>"
        + _PAIRS % ("Yakıt Tipi", "") + "</body>", ["dizel", "otomatik", None, None, None, "GBP", None, None, None, "satildi"]),
    "arsiv_features": ("a", "<title>{make} - İlan arşivi | Site</title><body><b>{make}</b><b>{model}</b><p>Son ilan fiyatı</p><p>{price.} STG</p><p>Bu ilan artık aktif değil.</p><h3>Özellikler</h3>"
        + _PAIRS % ("Yakıt", "<dt>Yer</dt><dd>Lefke</dd>") + "<p>No 5885 · x</p></body>", ["dizel", "otomatik", None, None, "Lefke", "GBP", None, None, None, "arsiv"]),
    "data": ("a", "<title>{make} {model} {year} - Site</title>" + _DATA.replace("{}", '{"@context":"x"}') + _DATA.replace("{}", '{"@type":"Vehicle","brand":{"name":"{make}"},"model":"{model}","vehicleModelDate":"{year}",'
        '"mileageFromOdometer":{"value":{km},"unitCode":"KMT"},"fuelType":"https://schema.org/Gasoline","vehicleTransmission":"https://schema.org/ManualTransmission","description":"temiz, sol direksiyon",'
        '"datePosted":"2026-10-{day}T10:00:00Z","offers":[{"price":"{price}","priceCurrency":"GBP","availability":"https://schema.org/InStock","areaServed":{"name":"Lapta"}}]}') + "<body>Araç Bulunamadı</body>",
        ["benzin", "manuel", None, "LHD", "Lapta", "GBP", 10, False, None, None]),
    "slides": ("a", "<title>{make} satılık</title><body><i>1 / 5</i><p>{year}</p><p>{make}</p><p>{model}</p><p>Fiyatı satıcıya sor</p><h3>Özellikler</h3>" + _PAIRS % ("Yakıt", "<dt>Motor hacmi</dt><dd>1,8 L</dd>")
        + "<p>Keşfet</p><p>Bireysel satıcı · Girne · {day1} Ağustos eklendi</p></body>", ["dizel", "otomatik", 1.8, None, None, None, 8, None, None, "fiyatsiz"]),
    "b": ("b", _DATA.replace("{}", '{"@graph":[{"@type":["Product","Car"],"brand":{"name":"{make}"},"model":"{model}","vehicleModelDate":"{year}","name":"x","description":"{year} {make} {model} – Güzelyurt. KKTC satılık",'
        '"mileageFromOdometer":{"value":"{km}"},"offers":{"price":"{price}.00","priceCurrency":"GBP","seller":{"name":"Ali"}}}]}') + "<body><h1>{make}</h1><p>İlan Tarihi:</p><p>{day1} Eylül 2026</p><p>Direksiyon Tipi:</p>"
        "<p>Sağ</p><p>Vites Tipi:</p><p>Düz</p><p>Yakıt Türü:</p><p>Benzin</p><p>Motor Hacmi (cc):</p><p>1498</p><p>Bireysel satıcı</p><h3>Konum Bilgisi</h3><p>güzel</p><p>2015 Model Otomatik</p></body>",
        ["benzin", "manuel", 1.5, "RHD", "Güzelyurt", "GBP", 9, False, "bireysel", None]),
    "c": ("c", _DATA.replace("{}", '{"@graph":[{"@type":"BreadcrumbList","itemListElement":[{"item":"x/","name":"Ana"},{"item":"x/marka/y","name":"{make}"}]}]}') + "<body><h1>{year} {make} {model} Otomatik</h1>"
        "<div class=\"listing-detail-price\"><del>1</del><span class='main-price big'>£ {price.}</span></div><div class=\"listing-detail-detail\"><ul><li><div class=\"field-title\">Yıl</div><div class=\"content-value\">"
        "<b>{year}</b></div><li><div class=\"field-title\">Kilometre</div><div class=\"content-value\">{km.}</div><li><div class=\"field-title\">Vites</div><div class=\"content-value\">Otomatik</div></ul></div><p>{day}/09/2026</p>"
        "<div class=\"listing-detail-description\"><div>ilk</div>pazarlık var</div><p>son</p></body>", [None, "otomatik", None, None, None, "GBP", 9, True, "bilinmiyor", None]),
    "d": ("d", "<body><p>2. El Araçlar</p><p>Otomobil</p><p>{make}</p><p>{model}</p><p>Girne</p><p>/</p><p>Lapta</p><p>İlan No:</p><p>{id}</p><p>Yıl:</p><p>{year}</p><p>Kilometre:</p><p>{km.}</p><p>Vites Tipi:</p><p>Otomatik</p>"
        "<p>Direksiyon Tipi:</p><p>Sol</p><p>İlan Tarihi:</p><p>{day1} Eylül 2026</p><p>Güvenlik</p><p>ACME OTO</p><p>Girne / Lapta</p></body>", [None, "otomatik", None, "LHD", "Girne / Lapta", "GBP", 9, None, "galeri", ""]),
    "e": ("e", _DATA.replace("{}", '[{"@type":"Product","name":"{year} Kia Ceed","offers":{"price":{price},"priceCurrency":"GBP","validFrom":"2026-09-{day} 15:57:14","availableAtOrFrom":{"address":{"addressLocality":"Girne"}}}}]')
        + "<body><h2>İlan Açıklaması</h2><p>{km} km, otomatik benzin</p><p>£{price}</p><p>5 km ötede</p></body>", ["benzin", "otomatik", None, None, "Girne", "GBP", 9, False, "bilinmiyor", None]),
    "f": ("f", _DATA.replace("{}", '{"@graph":[{"@type":"WebPage","datePublished":"2026-09-{day}T08:00:00+03:00"}]}') + "<body><h1>{make} satılık</h1><div><div class=\"vehica-car-attributes__name\">Marka:</div>\n<div>{make}</div></div><div>"
        "<div class=\"vehica-car-attributes__name\">Model:</div><div>{model}</div></div><div><div class=\"vehica-car-attributes__name\">Yılı:</div><div>{year}</div></div><div class=\"vehica-car-description__inner\">Honda {year} {km} km"
        "<br>fiyat {price} STG dümen: sağ</div></body>", [None, None, None, "RHD", None, "GBP", 9, False, "bilinmiyor", None]),
    "": ("b", "<body><h1>404</h1></body>", [None] * 10),
}


def _numbers(pages: DataFrame) -> DataFrame:
    i = F.col("page_id")
    return pages.select(
        "page_id", (2000 + i % 24).cast("int").alias("year"), (20_000 + 100 * (i * 37 % 1500)).cast("int").alias("km"), (3_000 + 50 * (i * 13 % 400)).cast("int").alias("price"), (1 + i % 28).cast("int").alias("day")
    )


def made_pages(spark: SparkSession, d: str) -> DataFrame:
    """page_id, site, html, card: each row of pages as a page of a layout."""
    rows, i = _numbers(table(spark, d, "pages")), F.col("page_id")
    car = F.floor(i / len(LAYOUTS)) % len(CARS)

    def dotted(c: str) -> Column:
        return F.replace(F.format_number(c, 0), F.lit(","), F.lit("."))

    values = {
        "make": F.get(F.array(*[F.lit(c[0]) for c in CARS]), car.cast("int")), "model": F.get(F.array(*[F.lit(c[1]) for c in CARS]), car.cast("int")), "year": F.col("year").cast("string"), "km": F.col("km").cast("string"),
        "km.": dotted("km"), "price": F.col("price").cast("string"), "price.": dotted("price"), "day": F.lpad(F.col("day").cast("string"), 2, "0"), "day1": F.col("day").cast("string"), "id": (100_000 + i).cast("string"),
    }

    def filled(text: str) -> Column:
        for k in values:
            text = text.replace("{" + k + "}", f"\0{k}\0")
        parts = text.split("\0")
        return F.concat(*[values[p] if k % 2 else F.lit(p) for k, p in enumerate(parts)])

    which = (i % len(LAYOUTS)).cast("int")
    html = F.get(F.array(*[filled(x[1]) for x in LAYOUTS.values()]), which)
    site = F.get(F.array(*[F.lit(x[0]) for x in LAYOUTS.values()]), which)
    card = F.struct(values["id"].alias("item_id"), F.lit("u").alias("url"), F.lit("t").alias("title"), F.concat(values["price."], F.lit(" GBP")).alias("price"), F.lit("l").alias("label"))
    return rows.select("page_id", site.alias("site"), html.alias("html"), card.alias("card"))


_COLUMNS = ["brand", "model", "year", "km", "fuel", "transmission", "engine_l", "steering", "location", "price_amount", "currency", "negotiable", "seller_type"]


def page_adverts(spark: SparkSession, d: str) -> DataFrame:
    got = P.read_pages(made_pages(spark, d), F.lit(TODAY).cast("date"), F.lit(NEWEST), card="card")
    return got.select("page_id", F.coalesce("layout", F.lit("")).alias("layout"), *[f"advert.{c}" for c in _COLUMNS], F.col("advert.posted").cast("string").alias("posted"), F.array_join("advert.signals", ",").alias("signals"))


def list_cards(spark: SparkSession, d: str) -> DataFrame:
    """Pages with lists of cards: five rows of pages make one, whose cards are read as adverts of their own."""
    rows = _numbers(table(spark, d, "pages"))
    i = F.col("page_id")
    card = F.concat(
        F.lit("<a class='ilan x' href='/"), (100_000 + i).cast("string"), F.lit("-kia-rio-girne-dizel-otomatik'><div class=resim><div class=\"resim\"><img src=\"/uploads/1.jpg\"/><span>Kia Rio</span></div></div><h3>"),
        F.col("year").cast("string"), F.lit(" Model Otomatik Kia Rio</h3><b class=\"fiyat\">"), F.when(i % 4 > 0, F.concat(F.col("price").cast("string"), F.lit(" GBP"))).otherwise(""), F.lit("</b></a>"),
    )
    pages = rows.groupBy(F.floor(i / 5).alias("list_id")).agg(F.concat_ws("", F.lit("<body><a class=\"ilan\" href=\"/hakkinda\">x</a>"), F.array_join(F.sort_array(F.collect_list(card)), "\n"), F.lit("</body>")).alias("html"))
    cards = pages.select("list_id", F.explode(P.cards(F.col("html"))).alias("card")).withColumn("p", parse_price(F.col("card.price")))
    got = cards.select("list_id", F.col("card.item_id").alias("item_id"), P.card_advert(F.col("card"), F.col("p")).alias("a"), F.col("card.photo").alias("photo"))
    return got.select("list_id", "item_id", "photo", *[f"a.{c}" for c in ("brand", "model", "year", "fuel", "transmission", "location", "price_amount", "currency")], F.array_join("a.signals", ",").alias("signals"))


def visible_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select("page_id", H.title(F.col("html")).alias("title"), H.lines(F.col("html")).alias("lines"))
    return rows.select("page_id", "title", F.coalesce(F.size("lines"), F.lit(0)).alias("n"), F.md5(F.array_join("lines", "\n").cast("binary")).alias("text"))


QUERIES = {"SC30_SC31_SC32_SC33_SC34_SC35_SC36_SC37_SC40_SC42_TX72_TX73_TX74_page_adverts": page_adverts, "SC28_SC38_list_cards": list_cards, "SC27_visible_lines": visible_lines}


def _sql(v: object) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else repr(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


_LAYOUTS_SQL = ", ".join(f"({i}, {_sql(n)}, {', '.join(map(_sql, x[2]))})" for i, (n, x) in enumerate(LAYOUTS.items()))
_CARS_SQL = ", ".join(f"({i}, {_sql(a)}, {_sql(b)})" for i, (a, b) in enumerate(CARS))
_FACTS = f"""WITH n AS (
  SELECT page_id, page_id % {len(LAYOUTS)} AS which, (page_id // {len(LAYOUTS)}) % {len(CARS)} AS car, 2000 + page_id % 24 AS year, 20000 + 100 * (page_id * 37 % 1500) AS km,
    3000 + 50 * (page_id * 13 % 400) AS price, 1 + page_id % 28 AS day FROM pages)"""
ORACLE_SQL = {
    "SC30_SC31_SC32_SC33_SC34_SC35_SC36_SC37_SC40_SC42_TX72_TX73_TX74_page_adverts": f"""{_FACTS}
SELECT page_id, layout, CASE WHEN layout = 'e' THEN 'Kia' WHEN layout <> '' THEN make END AS brand, CASE WHEN layout = 'e' THEN 'Ceed' WHEN layout <> '' THEN model END AS model,
  CASE WHEN layout <> '' THEN year END::INTEGER AS year, CASE WHEN layout <> '' THEN km END::INTEGER AS km, fuel, gear AS transmission, engine::DOUBLE AS engine_l, steering, place AS location,
  CASE WHEN currency IS NOT NULL THEN price END::DOUBLE AS price_amount, currency, negotiable::BOOLEAN AS negotiable, seller AS seller_type,
  CASE WHEN month IS NOT NULL THEN strftime(make_date(2026, month, day), '%Y-%m-%d') END AS posted, signals
FROM n JOIN (VALUES {_LAYOUTS_SQL}) l(i, layout, fuel, gear, engine, steering, place, currency, month, negotiable, seller, signals) ON l.i = n.which JOIN (VALUES {_CARS_SQL}) c(j, make, model) ON c.j = n.car""",
    "SC28_SC38_list_cards": f"""{_FACTS}
SELECT page_id // 5 AS list_id, (100000 + page_id)::VARCHAR AS item_id, '/uploads/1.jpg' AS photo, 'Kia' AS brand, 'Rio' AS model, year::INTEGER AS year, 'dizel' AS fuel, 'otomatik' AS transmission, 'girne' AS location,
  CASE WHEN page_id % 4 > 0 THEN price END::DOUBLE AS price_amount, CASE WHEN page_id % 4 > 0 THEN 'GBP' END AS currency, CASE WHEN page_id % 4 > 0 THEN '' ELSE 'fiyatsiz' END AS signals FROM n""",
    "SC27_visible_lines": r"""
WITH b AS (
  SELECT page_id, trim(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1), '&quot;', '"'), '&amp;', '&')) AS title,
    regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<svg\b.*?</svg\s*>', chr(10), 'g'), '(?is)^.*?<body\b[^>]*>', ''), '<[A-Za-z/!?][^>]*>', chr(10), 'g') AS t
  FROM pages),
u AS (SELECT page_id, title, list_filter(list_transform(string_split(replace(replace(replace(replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(160))), lambda x: x <> '') AS l FROM b)
SELECT page_id, title, len(l)::INTEGER AS n, md5(array_to_string(l, chr(10))) AS text FROM u""",
}
