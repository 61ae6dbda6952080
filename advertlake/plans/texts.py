"""Queries of the key, price and caption rules. Each order carries one of the rules' written cases, and the SQL holds the values worked out by hand;
folding and the posts' normalised start run over the texts of the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from advertlake.functions import advert_text as A
from advertlake.functions import keys as K
from advertlake.functions import links as L
from advertlake.functions import price as P
from advertlake.functions import text as X
from advertlake.session import table

# (brand, model, address) -> (brand_norm, model_norm, body, is a car)
NAMES = [
    (("Mercedes - Benz", "GLE Coupe 350", "https://a.b/listing/x?coupe"), ("Mercedes-Benz", "gle coupe", "coupe", True)),
    (("mercedes", "Benz C200", "https://a.b/listing/2009-c200-cabrio-x1"), ("Mercedes-Benz", "c", "cabrio", True)),
    (("BMW", "320i Cabrio", None), ("BMW", "3", "cabrio", True)),
    (("BMW", "F30 320d", "http://coupe.example/listing/2013"), ("BMW", "3", None, True)),
    (("bmw", "f10 m5", None), ("BMW", "f10", None, True)),
    (("BMW", "M Serisi M4", None), ("BMW", "m4", None, True)),
    (("BMW", "M 1000 RR", None), ("Motosiklet", "m", None, False)),
    (("BMW", "5 serisi", None), ("BMW", "5", None, True)),
    (("vw", "T-Roc 1.5", None), ("Volkswagen", "t-roc", None, True)),
    (("Land", "Rover Range Rover Evoque", None), ("Land Rover", "evoque", None, True)),
    (("Land Rover", "Discovery  Sport", None), ("Land Rover", "discovery sport", None, True)),
    (("range", "Rover Sport", None), ("Land Rover", "range rover sport", None, True)),
    (("Toyota", "RAV 4 hybrid", None), ("Toyota", "rav4", None, True)),
    (("Toyota", "Yaris Cross", None), ("Toyota", "yaris cross", None, True)),
    (("Honda", "CBR 1000 RR", None), ("Motosiklet", "cbr", None, False)),
    (("Honda", "Fit Aria", None), ("Honda", "fit aria", None, True)),
    (("Suzuki", "swfit", None), ("Suzuki", "swift", None, True)),
    (("kia", "Ceed", None), ("KIA", "ceed", None, True)),
    (("Citroën", "C3 ", None), ("Citroen", "c3", None, True)),
    (("Mini", "Cooper Clubman S", None), ("Mini", "cooper clubman", None, True)),
    (("alfa romeo", "Giulietta", None), ("Alfa Romeo", "giulietta", None, True)),
    (("Mazda", "CX-5 2.0", None), ("Mazda", "cx-5", None, True)),
    (("Tesla", "Model 3", None), ("Tesla", "model 3", None, True)),
    (("Peugeot", "206 Cabrio", None), ("Peugeot", "206 cc", "cabrio", True)),
    (("Isuzu", "NPR 75", None), ("Kamyon & Kamyonet", "npr", None, False)),
    (("Vauxhall", "Astra Kupe", None), ("Opel", "astra", "coupe", True)),
    (("ford", "", None), ("Ford", None, None, True)),
    ((None, "x", None), (None, "x", None, False)),
    (("Vespa", "Primavera", None), ("Vespa", "primavera", None, False)),
]
# text -> (text with joined thousands, amount, currency, is a guess, is no car's price)
PRICES = [
    ("Fiyat: 6.900 STG", ("Fiyat: 6.900 STG", 6900.0, "GBP", False, False)),
    ("600.000 TL", ("600.000 TL", 600000.0, "TRY", False, False)),
    ("£6,900", ("£6,900", 6900.0, "GBP", False, False)),
    ("15 bin STG", ("15 bin STG", 15000.0, "GBP", False, False)),
    ("1. el 8.500 STG", ("1. el 8.500 STG", 8500.0, "GBP", False, False)),
    ("6 500 STG", ("6.500 STG", 6500.0, "GBP", False, False)),
    ("12/800 £", ("12.800 £", 12800.0, "GBP", False, False)),
    ("2014 £6500", ("2014 £6500", 6500.0, "GBP", False, False)),
    ("9500 STG 2016", ("9500 STG 2016", 9500.0, "GBP", False, False)),
    ("2014 model, fiyat 6500", ("2014 model, fiyat 6500", 6500.0, "GBP", True, False)),
    ("1 650 000 TL", ("1.650.000 TL", 1650000.0, "TRY", False, False)),
    ("Peugeot 308 120 000 km", ("Peugeot 308 120.000 km", 308.0, "GBP", True, False)),
    ("5 bin 500 stg", ("5.500 stg", 5500.0, "GBP", False, False)),
    ("8500 stgdir", ("8500 stgdir", 8500.0, "GBP", False, False)),
    ("6.500 (STG)", ("6.500 (STG)", 6500.0, "GBP", False, False)),
    ("8.500.-stg", ("8.500.-stg", 8500.0, "GBP", False, False)),
    ("65000", ("65000", 65000.0, "TRY", True, False)),
    ("7.5k £", ("7.5k £", 7500.0, "GBP", False, False)),
    ("stge kadar 5000", ("stge kadar 5000", 5000.0, "GBP", True, False)),
    ("tamamdır.250.000 tl", ("tamamdır.250.000 tl", 250000.0, "TRY", False, False)),
    ("€ 7,900", ("€ 7,900", 7900.0, "EUR", False, False)),
    ("kapora 15.000 TL", ("kapora 15.000 TL", 15000.0, "TRY", False, True)),
    ("1.234.567 tl", ("1.234.567 tl", 1234567.0, "TRY", False, True)),
    ("$ 12345", ("$ 12345", 12345.0, "USD", False, True)),
    ("yok", ("yok", None, None, None, False)),
]
# caption -> (brand, model, year, km, fuel, gear, steering, phone, amount, currency, negotiable, swap, year unsure, sold)
CAPTIONS = [
    ("- Marka: toyota Vitz 1.3\nModel Yılı : 2014 (2015)\nKilometre: 85.000 KM\nYakıt: Benzin\nVites: Otomatik\nDümen: Sağ\nTelefon: 0533 123 45 67 / Ali\nFiyat: 6.900 STG\nTakas: Yok\nPazarlık payı var",
     ("Toyota", "Vitz 1.3", 2014, 85000, "benzin", "otomatik", "RHD", "905331234567", 6900.0, "GBP", True, False, True, False)),
    ("Marka: BMW 320i\nYıl: 2011\nKilometre: 174.*** KM\nDireksiyon: Sol\nİletişim: 5331234567\nFiyat: 450 000 TL\nTakas: Evet olur",
     ("Bmw", "320i", 2011, None, None, None, "LHD", "905331234567", 450000.0, "TRY", False, True, False, False)),
    ("Marka: Kia\nYıl: yeni\nFiyat: sorunuz\nSATILDI", ("Kia", None, None, None, None, None, None, None, None, None, False, None, False, True)),
    ("Marka: Kia Rio\nYıl: 2012", (None,) * 10 + (None, None, None, False)),
]
# text -> (phones, masked text, is a sign)
PHONES = [
    ("0533 123 45 67 a@b.com 0533-123-45-67", ("905331234567", "[tel] [eposta] [tel]", True)),
    ("SATILIK 2010 Vitz tel: (0548) 111 22 33", ("905481112233", "SATILIK 2010 Vitz tel: (0548) 111 22 33", True)),
    ("+90 392 815 11 22 / 0090 533 1234567", ("903928151122,905331234567", "[tel] / [tel]", True)),
    ("km 120000, fiyat 6500, ilan 12345678", ("", "km 120000, fiyat 6500, ilan 12345678", True)),
    ("arac cok temizdir masrafsizdir boyasizdir hatasizdir 05331112233 sahibinden arayin", ("905331112233", "arac cok temizdir masrafsizdir boyasizdir hatasizdir [tel] sahibinden arayin", False)),
    (None, ("", None, True)),
]
# text -> a cost of unknown size
COSTS = [("ufak masrafı var masrafı var", False), ("aracın masrafları vardır", True), ("boya masrafı var", False), ("masrafsız", False), (None, False), ("temiz araç, motorunda masraf var. ufak masrafı var", True)]
# (platform, link) -> (kind, handle, key)
LINKS = [
    (("instagram", "https://www.instagram.com/Oto.Galeri/"), ("instagram", "oto.galeri", "ig:oto.galeri")),
    (("instagram", "https://instagram.com/p/abc123/"), ("ig_post", "", None)),
    (("facebook", "http://m.facebook.com/groups/12345/?ref=x"), ("facebook", "12345", "fb:12345")),
    (("facebook", "https://facebook.com/groups/12345/posts/9"), ("fb_post", "", None)),
    (("facebook", "https://www.facebook.com/SomePage/"), ("fb_post", "", "fbp:somepage")),
    (("facebook", "https://facebook.com/marketplace"), ("fb_post", "", None)),
    (("facebook", "https://facebook.com/share/g/xyz"), ("fb_share", "", None)),
    (("web", "https://user:pw@WWW.Cars.example.co.uk:8080/a?b#c"), ("web", "cars.example.co.uk", "web:cars.example.co.uk")),
    (("instagram", "https://cars.example.com/"), ("web", "cars.example.com", None)),
    (("web", "see https://cars.example.com/"), (None, None, None)),
    (("web", "https://localhost/x"), (None, None, None)),
    (("web", None), (None, None, None)),
]
# (text, phone) -> (names the region, an advert of the region)
REGIONS = [
    (("KKTC ARABAM", None), (True, True)), (("SAHIBINDEN AL SAT (KIBRIS)", None), (True, True)), (("GİRNE 2.EL PAZARI", None), (True, True)),
    (("Bristol Uni Students - buy, sell", None), (False, False)), (("TÜRKİYE İskele Kiralama", None), (False, True)), (("temiz araç 0533 123 45 67", None), (False, True)),
    (("temiz araç", "905481112233"), (False, True)), (("temiz araç", "905311112233"), (False, False)), ((None, None), (False, False)),
]
# (brand, model, engine) -> variant
VARIANTS = [(("BMW", "320i Cabrio", "2.0"), "320"), (("Mercedes-Benz", "C Serisi C 180", None), "180"), (("BMW", "M4", "3.0"), ""), (("Toyota", "Vitz", "1.33"), "1.4"), (("Toyota", "Vitz", "1.0"), "1.0"), (("Kia", "x", "9.5"), ""), (("Kia", None, None), "")]
PLACES = [("Lefkoşa, merkez", "lefkosa"), ("girne alsancak", "girne"), ("Alsancak", "girne"), ("Benz C Serisi", None), (None, None), ("GAZİMAĞUSA", "magusa"), ("yeni iskele", "iskele")]


def _case(values: list, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (at % len(values) + 1).cast("int"))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey")


def names(spark, d):
    k = F.col("o_orderkey")
    rows = _orders(spark, d).select("o_orderkey", *[_case([n[0][i] for n in NAMES], k).alias(c) for i, c in enumerate(("brand", "model", "url"))])
    rows = rows.select("o_orderkey", K.keys(F.col("brand"), F.col("model")).alias("k"), K.body_type(F.col("model"), F.col("url")).alias("body"))
    return rows.select("o_orderkey", "k.brand_norm", "k.model_norm", "body", K.is_car(F.col("k.brand_norm")).alias("car"))


def prices(spark, d):
    rows = _orders(spark, d).select("o_orderkey", _case([p[0] for p in PRICES], F.col("o_orderkey")).alias("t"))
    rows = rows.select("o_orderkey", P.joined_thousands(F.col("t")).alias("joined"), P.parse_price(F.col("t")).alias("p"))
    return rows.select("o_orderkey", "joined", "p.amount", "p.currency", "p.guess", P.implausible(F.col("p.amount"), F.col("p.currency")).alias("implausible"))


_CAPTION = ["brand", "model", "year", "km", "fuel", "transmission", "steering", "phone", "price_amount", "currency", "negotiable", "swap", "year_unsure"]


def captions(spark, d):
    rows = _orders(spark, d).select("o_orderkey", _case([c[0] for c in CAPTIONS], F.col("o_orderkey")).alias("t"))
    rows = rows.select("o_orderkey", P.parse_caption(F.col("t")).alias("c"), P.is_sold_post(F.col("t")).alias("sold"))
    return rows.select("o_orderkey", *[f"c.{c}" for c in _CAPTION], "sold")


def places(spark, d):
    return _orders(spark, d).select("o_orderkey", K.district(_case([p[0] for p in PLACES], F.col("o_orderkey"))).alias("district"))


def phone_rules(spark, d):
    rows = _orders(spark, d).select("o_orderkey", _case([p[0] for p in PHONES], F.col("o_orderkey")).alias("t"))
    return rows.select("o_orderkey", F.array_join(X.phones(F.col("t")), ",").alias("phones"), X.mask_pii(F.col("t")).alias("masked"), X.is_sign(K.fold(X.without_phones(F.col("t")))).alias("sign"))


def costs(spark, d):
    return _orders(spark, d).select("o_orderkey", A.cost_unknown(_case([c[0] for c in COSTS], F.col("o_orderkey"))).alias("open"))


def source_links(spark, d):
    k = F.col("o_orderkey")
    rows = _orders(spark, d).select("o_orderkey", _case([x[0][0] for x in LINKS], k).alias("p"), _case([x[0][1] for x in LINKS], k).alias("u"))
    return rows.select("o_orderkey", L.source_link(F.col("u")).alias("l"), L.source_key(F.col("p"), F.col("u")).alias("key")).select("o_orderkey", "l.kind", "l.handle", "key")


def regions(spark, d):
    k = F.col("o_orderkey")
    rows = _orders(spark, d).select("o_orderkey", _case([x[0][0] for x in REGIONS], k).alias("t"), _case([x[0][1] for x in REGIONS], k).alias("phone"))
    rows = rows.withColumn("f", K.fold(F.coalesce("t", F.lit(""))))
    return rows.select("o_orderkey", L.names_region(F.col("f")).alias("named"), L.text_of_region(F.col("f"), F.col("t"), F.col("phone")).alias("local"))


def region_groups(spark, d):
    """Groups of orders judged by the share of their adverts that are of the region."""
    rows = regions(spark, d).withColumn("g", F.col("o_orderkey") % 50)
    return rows.groupBy("g").agg(F.count("*").alias("n"), F.count_if("local").alias("hits")).select("g", "n", "hits", L.region_share(F.col("hits"), F.col("n")).alias("local"))


def variants(spark, d):
    k = F.col("o_orderkey")
    rows = _orders(spark, d).select("o_orderkey", *[_case([v[0][i] for v in VARIANTS], k).alias(c) for i, c in enumerate("bme")])
    return rows.select("o_orderkey", L.variant(F.col("b"), F.col("m"), F.col("e").cast("double")).alias("variant"))


def folded(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(K.fold(F.col("text")).cast("binary")).alias("folded"))


def post_starts(spark, d):
    year = F.lit(1995)
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("1995 "), F.col("text"))).otherwise(F.col("text"))
    platform = F.when(F.col("doc_id") % 5 == 0, "web").otherwise("facebook")
    return table(spark, d, "documents").select("doc_id", K.post_text(text).alias("start"), K.post_fingerprint(text, year, platform).alias("fingerprint"))


QUERIES = {
    "TX04_TX05_TX06_TX07_TX08_TX09_TX10_PR05_keys": names,
    "TX16_TX17_TX18_TX19_TX20_TX21_PR07_prices": prices,
    "TX22_TX24_TX25_TX26_TX27_captions": captions,
    "TX61_TX62_TX69_TX70_phones": phone_rules,
    "TX46_cost_unknown": costs,
    "TX53_TX54_TX55_source_links": source_links,
    "TX50_TX51_regions": regions,
    "AG41_region_groups": region_groups,
    "TX56_variant": variants,
    "TX15_district": places,
    "TX01_fold": folded,
    "TX12_TX13_TX14_SF27_post_fingerprint": post_starts,
}


def _value(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def _cases_sql(columns: list[str], values: list[tuple], kinds: dict[str, str]) -> str:
    rows = ", ".join(f"({i}, {', '.join(map(_value, v))})" for i, v in enumerate(values))
    cols = ", ".join(f"c.{c}::{kinds.get(c, 'VARCHAR')} AS {c}" for c in columns)
    return f"SELECT o_orderkey, {cols} FROM orders JOIN (VALUES {rows}) c(i, {', '.join(columns)}) ON c.i = o_orderkey % {len(values)}"


_START = """substr(trim(regexp_replace(lower(translate(substr(t, 1, 1000), 'ÇĞİIÖŞÜÂÎÛçğıöşüâîû', 'cgiiosuaiucgiosuaiu')), '[^a-z0-9]+', ' ', 'g')), 1, 300)"""
ORACLE_SQL = {
    "TX04_TX05_TX06_TX07_TX08_TX09_TX10_PR05_keys": _cases_sql(["brand_norm", "model_norm", "body", "car"], [n[1] for n in NAMES], {"car": "BOOLEAN"}),
    "TX16_TX17_TX18_TX19_TX20_TX21_PR07_prices": _cases_sql(["joined", "amount", "currency", "guess", "implausible"], [p[1] for p in PRICES], {"amount": "DOUBLE", "guess": "BOOLEAN", "implausible": "BOOLEAN"}),
    "TX22_TX24_TX25_TX26_TX27_captions": _cases_sql([*_CAPTION, "sold"], [c[1] for c in CAPTIONS], {"year": "INTEGER", "km": "INTEGER", "price_amount": "DOUBLE", **{c: "BOOLEAN" for c in ("negotiable", "swap", "year_unsure", "sold")}}),
    "TX61_TX62_TX69_TX70_phones": _cases_sql(["phones", "masked", "sign"], [p[1] for p in PHONES], {"sign": "BOOLEAN"}),
    "TX53_TX54_TX55_source_links": _cases_sql(["kind", "handle", "key"], [x[1] for x in LINKS], {}),
    "TX50_TX51_regions": _cases_sql(["named", "local"], [x[1] for x in REGIONS], {"named": "BOOLEAN", "local": "BOOLEAN"}),
    "AG41_region_groups": f"""WITH r AS ({_cases_sql(["local"], [(x[1][1],) for x in REGIONS], {"local": "BOOLEAN"})})
SELECT o_orderkey % 50 AS g, count(*) AS n, count(*) FILTER (local) AS hits, count(*) >= 3 AND count(*) FILTER (local) * 3 >= count(*) * 2 AS local FROM r GROUP BY 1""",
    "TX56_variant": _cases_sql(["variant"], [(v[1],) for v in VARIANTS], {}),
    "TX46_cost_unknown": _cases_sql(["open"], [(c[1],) for c in COSTS], {"open": "BOOLEAN"}),
    "TX15_district": _cases_sql(["district"], [(p[1],) for p in PLACES], {}),
    "TX01_fold": r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(strip_accents(translate(text, 'ıİ', 'ii'))), '[^\x00-\x7F]', '', 'g'), '\s+', ' ', 'g'))) AS folded FROM documents",
    "TX12_TX13_TX14_SF27_post_fingerprint": f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '1995 ' || text ELSE text END AS t FROM documents), s AS (SELECT doc_id, coalesce({_START}, '') AS start FROM d)
SELECT doc_id, start, CASE WHEN doc_id % 5 <> 0 AND length(start) >= 60 AND contains(' ' || start || ' ', ' 1995 ') THEN md5(start) END AS fingerprint FROM s""",
}
