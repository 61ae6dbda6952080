"""The free-text rules on posts worked out by hand, and on long and odd texts."""

import time

import pytest
from pyspark.sql import functions as F

from advertlake.functions import freetext as T
from advertlake.functions import price as P
from advertlake.functions.text import mentions

# text -> (reason, make, model, year, km, least, amount, currency, guess)
POSTS = [
    ("2018 Honda Jazz 40.000 mil 6.500 STG", ("ok", "Honda", "Jazz", 2018, None, False, 6500.0, "GBP", False)),
    ("2015 Kia Ceed 5000", ("fiyat_yok",)),
    ("BMW F30 320i 2014 £12,500 174.***km", ("ok", "BMW", "320i", 2014, 174000, True, 12500.0, "GBP", False)),
    ("Mazda3 2016 8500 stg km: 120.000", ("ok", "Mazda", "3", 2016, 120000, False, 8500.0, "GBP", False)),
    ("Mercedes - Benz Vito 2012 Eski Fiyat: 21.000 £ yeni 18.000 £", ("ok", "Mercedes", "Vito", 2012, None, False, 18000.0, "GBP", False)),
    ("Fiyat 2000 STG, 2008 model Nissan Note", ("ok", "Nissan", "Note", 2008, None, False, 2000.0, "GBP", False)),
    ("NİSSAN NOTE 2019 ÇIKIŞLI JANTLAR 9.900 STG 85xxx km", ("ok", "Nissan", "NOTE", 2019, 85000, True, 9900.0, "GBP", False)),
    ("JANT takımı toyota 2015 300 stg", ("arac_degil",)),
    ("kiralık araç toyota 2015 300 stg", ("arac_degil",)),
    ("Honda Fit 2012 4000 stg kiralık geçmişi yok, takas alınır", ("ok", "Honda", "Fit", 2012, None, False, 4000.0, "GBP", False)),
    ("Range Rover Evoque 2015 24.500£ fiyat\nTRY24,500", ("ok", "Land Rover", "Range Rover Evoque", 2015, None, False, 24500.0, "GBP", False)),
    ("Toyota Yaris Cross 2022 TRY9,500", ("ok", "Toyota", "Yaris Cross", 2022, None, False, 9500.0, "GBP", True)),
    ("Toyota Aqua 2014 TRY111", ("fiyat_yok",)),
    ("2014 Renault Clio 145 bin km, bakımları 5 bin km önce yapıldı. nakit 7.500 STG taksitli 9.000 STG", ("ok", "Renault", "Clio", 2014, 145000, False, 7500.0, "GBP", False)),
    ("Ford Focus 2011 €111,111 1500stg ye yakın extralıdır", ("fiyat_yok",)),
    ("Opel Corsa 30.000₺ 2012 €30,000", ("fiyat_yok",)),
    ("Hyundai İ 30 2012 5500 stg 0542 111 22 33", ("ok", "Hyundai", "i30", 2012, None, False, 5500.0, "GBP", False)),
    ("Honda S2000 2005 4500£", ("ok", "Honda", "S2000", 2005, None, False, 4500.0, "GBP", False)),
    ("Toyota CH R 2019 15.000 stg\ntakaslı fiyatı 17.000 stg nakit fiyatı 15.000 stg", ("fiyat_yok",)),
    ("Kia Rio 2013 FİYAT 5.500 STERLİN\nTAKASLI FİYATI: 6.500 stg", ("ok", "Kia", "Rio", 2013, None, False, 5500.0, "GBP", False)),
    ("fort focus 2010 4000 pound", ("ok", "Ford", "focus", 2010, None, False, 4000.0, "GBP", False)),
    ("Smart stop swift 2010 4000 stg", ("marka_yok",)),
    ("smart fortwo 2010 4000 stg", ("ok", "Smart", "fortwo", 2010, None, False, 4000.0, "GBP", False)),
    ("Volvo 1998 cc 4000 stg", ("yil_yok",)),
    ("Volvo V40 2015 her 10 bin km bakımlı, 135 000 km 11 900 stg", ("ok", "Volvo", "V40", 2015, 135000, False, 11900.0, "GBP", False)),
    ("2014 km 85.000 Toyota Vitz 5.000 stg", ("ok", "Toyota", "Vitz", 2014, 85000, False, 5000.0, "GBP", False)),
    ("KKTC 0548 111 22 33 Renault Clio 2013 5500 stg", ("ok", "Renault", "Clio", 2013, None, False, 5500.0, "GBP", False)),
    ("C180 Mercedes 2012\n€15,500", ("ok", "Mercedes", None, 2012, None, False, 15500.0, "EUR", False)),
    ("2012 Honda Fit 192** km 4000 stg", ("ok", "Honda", "Fit", 2012, None, False, 4000.0, "GBP", False)),
    ("Toyota Vitz 2039 4000 stg", ("yil_yok",)),
    ("", ("arac_degil",)),
    (None, ("arac_degil",)),
]


def test_posts(spark):
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(POSTS)], "i int, t string")
    for r in d.select("i", T.parse_freetext(F.col("t"), F.lit(2027)).alias("p"), T.diagnose(F.col("t"), F.lit(2027)).alias("reason")).collect():
        text, want = POSTS[r.i]
        p = r.p
        got = (r.reason,) + ((p.brand, p.model, p.year, p.km, p.km_least, p.price_amount, p.currency, p.currency_guess) if p else ())
        assert got == want, text


def test_known_price_and_posts_without_price(spark):
    d = spark.createDataFrame([("2015 Kia Ceed otomatik, elektrikli cam, benzin, sağ direksiyon Girne pazarlık olur takasa uygun", 4000.0, "GBP"), ("2015 Kia Ceed 2010", None, None)], "t string, a double, c string")
    known = F.when(F.col("a").isNotNull(), F.struct(F.col("a").alias("amount"), F.col("c").alias("currency")))
    both = d.select(T.parse_freetext(F.col("t"), F.lit(2027), F.lit("LHD"), known).alias("p"), T.parse_freetext(F.col("t"), F.lit(2027), F.lit("LHD"), allow_no_price=True).alias("q")).collect()
    p, q = both[0]
    assert (p.price_amount, p.currency, p.price_raw, p.fuel, p.transmission, p.steering, p.location, p.negotiable, p.swap) == (4000.0, "GBP", "4000 GBP", "benzin", "otomatik", "RHD", "Girne", True, True)
    assert q.price_amount is None and q.year == 2015 and both[1].p is None and both[1].q.steering == "LHD"


BODIES = [("Honda 2012 5200£ sıfır ayarında, ilk sahibinden satılıktır", (5200.0, False)), ("Honda 2012 TRY5,200", (None, False)), ("Honda 2012 temiz 12.500 STG", (12500.0, True)), ("x" * 40 + " 8 bin stg", (8000.0, True)), (None, (None, False))]


def test_body_price_and_cut_tails(spark):
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(BODIES)], "i int, t string")
    for r in d.select("i", T.body_price(F.col("t")).alias("p"), T.price_in_cut_tail(F.col("t")).alias("cut")).collect():
        assert (r.p.amount if r.p else None, r.cut) == BODIES[r.i][1], BODIES[r.i][0]


# text -> (amount, currency, tight, box) of its numbers
TOKENS = [
    ("2014 £6500", [(2014.0, None, False, False), (6500.0, "GBP", True, False)]), ("9500 STG 2016", [(9500.0, "GBP", False, False), (2016.0, None, False, False)]),
    ("7.500 stg 8.000", [(7500.0, "GBP", False, False), (8000.0, "GBP", False, False)]), ("TRY5,200 4000 TRY 6", [(5200.0, "TRY", True, True), (4000.0, "TRY", False, False), (6.0, "TRY", False, False)]),
    ("1. el 5000 tl", [(5000.0, "TRY", False, False)]), ("1500 bin stg", [(1500.0, None, False, False)]), ("0 £500", [(500.0, "GBP", True, False)]),
]


def test_currencies_of_neighbouring_numbers(spark):
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TOKENS)], "i int, t string")
    for r in d.select("i", P.price_tokens(F.col("t")).alias("x")).collect():
        assert [(x.amount, x.currency, x.tight, x.box) for x in r.x] == TOKENS[r.i][1], TOKENS[r.i][0]


def test_mentions_have_the_characters_around_them(spark):
    text = "ab12cd3efghij" + "k" * 50 + "4l5"
    got = spark.createDataFrame([(text,)], "t string").select(mentions(F.col("t"), r"\d+", 4).alias("m")).first().m
    places = [(text.index(x.hit), x) for x in got]
    assert [x.hit for x in got] == ["12", "3", "4", "5"]
    for at, x in places:
        assert x.before == text[max(0, at - 4) : at] and x.after == text[at + len(x.hit) : at + len(x.hit) + 4]


@pytest.mark.parametrize("n", [20_000])
def test_time_grows_with_the_length(spark, n):
    def took(k):
        text = "Toyota Auris 2013 " + " ".join(f"{1000 + i % 8000} km {i} x" for i in range(k)) + " 5000 stg"
        d = spark.createDataFrame([(text,)], "t string").repartition(1)
        began = time.time()
        r = d.select(T.parse_freetext(F.col("t"), F.lit(2027)).alias("p")).first()
        assert r.p.price_amount == 5000
        return time.time() - began

    took(10)
    assert took(n) < 12 * max(0.5, took(n // 4))


def test_what_a_price_and_its_reason_share_is_planned_once(spark):
    """The regular expressions of a post's prices stand in the plan as often as there are texts to judge (twice each, in two branches)."""
    from advertlake.functions import freetext as T
    from advertlake.plans import freetext as P

    for query, most in ((P.free_posts, 2), (P.post_prices, 4)):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(T._ADVANCE) == most, plan.count(T._ADVANCE)
