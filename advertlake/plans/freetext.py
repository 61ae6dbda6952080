"""Queries of the free-text rules. Each order is written as a post in one of sixteen manners, with its own make, year, mileage and price among numbers that
are none; the SQL knows the numbers and the manner, and never sees the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from advertlake.functions import freetext as T
from advertlake.functions.numbers import let
from advertlake.session import table
from advertlake.sources.shared import spread

NEWEST = 2027
# make as written, model as written, make, model
CARS = [
    ("Toyota", "Auris", "Toyota", "Auris"), ("NİSSAN", "NOTE", "Nissan", "NOTE"), ("Mercedes - Benz", "Vito", "Mercedes", "Vito"), ("BMW", "F30 320i", "BMW", "320i"),
    ("Toyota", "CH R", "Toyota", "C-HR"), ("wolkswagen", "Polo", "Volkswagen", "Polo"), ("range rover", "Evoque", "Land Rover", "Range Rover Evoque"), ("Mazda", "CX 5", "Mazda", "CX-5"),
    ("Suzuki", "grand vitara", "Suzuki", "Grand Vitara"), ("Hyundai", "İ 30", "Hyundai", "i30"), ("fort", "Focus", "Ford", "Focus"),
]
# post -> (reason, price as in amount or fixed, currency, guess, km: read / least / none, phone, swap, in the last characters, price without box)
MANNERS = [
    ("{year} {make} {model} {km.} km {price.} STG", ("ok", True, "GBP", False, "km", False, None, True, True)),
    ("Satılık {make} {model}\nModel: {year}\nKM: {km.}\nEski Fiyat: £{old,}\nFiyat: £{price,}\nTel: {phone}\n{tail}", ("ok", True, "GBP", False, "km", True, None, False, True)),
    ("{make} {model} {year} £{price,} temiz, {km_} km, taksit 250 stg, kapora 500 stg", ("ok", True, "GBP", False, "km", False, None, False, True)),
    ("{make} {model} {year} {thousand}***KM nakit {price_} stg takas olur {tail}", ("ok", True, "GBP", False, "least", False, True, False, True)),
    ("{make} {model} {year} bakımları 5 bin km önce yapıldı, {km_} km {price}£ {tail}", ("ok", True, "GBP", False, "km", False, None, False, True)),
    ("{make} {model} {year} {price.} stg {old.} stg", ("fiyat_yok", False, None, False, None, False, None, False, False)),
    ("temiz araba {year} {km.} km {price.} stg", ("marka_yok", False, None, False, None, False, None, True, True)),
    ("{make} {model} 2039 {price.} stg {tail}", ("yil_yok", False, None, False, None, False, None, False, True)),
    ("kiralık {make} {model} {year} {price.} stg", ("arac_degil", False, None, False, None, False, None, True, True)),
    ("{make} {model} {year} {km.} km\nTRY{price,}", ("ok", True, "GBP", True, "km", False, None, False, False)),
    ("{make} {model} {year} {price.} £, {km} km {tail}\n€{price,}", ("ok", True, "GBP", False, "km", False, None, False, True)),
    ("{make} {model} {year} Fiyat: 40.000 TL\n€39,999", ("fiyat_yok", False, None, False, None, False, None, False, False)),
    ("{make} {model} {year} FİYAT {price.} STERLİN\nTAKASLI FİYATI: {old.} stg\nKilometre: {km.} mil {tail}", ("ok", True, "GBP", False, None, False, None, False, True)),
    ("{make} {model} {year} {km.} mil {price.} stg", ("ok", True, "GBP", False, None, False, None, True, True)),
    ("{make} {model} {year}\n{tail}\nKM:\n{km.}\n€{price,}", ("ok", True, "EUR", False, "km", False, None, True, True)),
    ("{year} {make} {model} içine araç alınır 2000 cc motor €111,111 {tail}", ("fiyat_yok", False, None, False, None, False, None, False, False)),
]
TAIL = "ilgilenenler mesaj atsın yardımcı olalım lütfen"


def _numbers(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    return orders.select(
        "o_orderkey", (1996 + F.pmod("o_custkey", F.lit(29))).cast("int").alias("year"), (20_500 + 100 * (k * 37 % 2000)).cast("int").alias("km"), (3_000 + 50 * (F.col("o_custkey") * 13 % 500)).cast("int").alias("price"),
        F.concat(F.lit("533"), F.lpad((k % 10_000_000).cast("string"), 7, "0")).alias("mobile"),
    )


def _grouped(n: Column, sign: str) -> Column:
    return F.replace(F.format_number(n, 0), F.lit(","), F.lit(sign))


def posts(spark: SparkSession, d: str) -> DataFrame:
    """o_orderkey and text: each order as a post."""
    rows = _numbers(table(spark, d, "orders"))
    car = (F.col("o_orderkey") % len(CARS)).cast("int")
    mobile = F.concat_ws(" ", F.concat(F.lit("0"), F.substring("mobile", 1, 3)), F.substring("mobile", 4, 3), F.substring("mobile", 7, 2), F.substring("mobile", 9, 2))
    values = {
        "make": F.get(F.array(*[F.lit(c[0]) for c in CARS]), car), "model": F.get(F.array(*[F.lit(c[1]) for c in CARS]), car), "year": F.col("year").cast("string"), "phone": mobile, "tail": F.lit(TAIL),
        "thousand": F.floor(F.col("km") / 1000).cast("string"), "km": F.col("km").cast("string"), "price": F.col("price").cast("string"), "old": (F.col("price") + 700).cast("string"),
    }
    for name, n in (("km", F.col("km")), ("price", F.col("price")), ("old", F.col("price") + 700)):
        values |= {f"{name}{mark}": _grouped(n, " " if mark == "_" else mark) for mark in ".,_"}

    def written(manner: str) -> Column:
        pieces = manner.replace("{", "\0{").replace("}", "}\0").split("\0")
        return F.concat(*[values[p[1:-1]] if p.startswith("{") else F.lit(p) for p in pieces if p])

    text = F.get(F.array(*[written(m) for m, _ in MANNERS]), (F.floor(F.col("o_orderkey") / len(CARS)) % len(MANNERS)).cast("int"))
    return rows.select("o_orderkey", text.alias("text"))


_COLUMNS = ["brand", "model", "year", "km", "km_least", "phone", "price_amount", "currency", "currency_guess", "swap"]


def free_posts(spark: SparkSession, d: str) -> DataFrame:
    text, newest = F.col("text"), F.lit(NEWEST)
    rows = spread(posts(spark, d)).select("o_orderkey", T.advert_and_reason(text, newest).alias("p"))
    return rows.select("o_orderkey", "p.reason", *[f"p.advert.{c}" for c in _COLUMNS])


def post_prices(spark: SparkSession, d: str) -> DataFrame:
    """The price of the text itself, and whether it hangs on the last characters of a text that may be cut."""
    text = F.col("text")
    rows = spread(posts(spark, d)).select("o_orderkey", let(T.body_price(text), lambda w: F.struct(w["amount"].alias("amount"), w["currency"].alias("currency"), T.price_in_cut_tail(text, whole=w).alias("at_end"))).alias("p"))
    return rows.select("o_orderkey", "p.amount", "p.currency", "p.at_end")


QUERIES = {"TX29_TX30_TX31_TX32_TX33_TX36_TX37_TX38_TX39_TX40_free_posts": free_posts, "TX34_TX35_post_prices": post_prices}


def _sql(v: object) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"


_MANNERS_SQL = ", ".join(f"({i}, {', '.join(map(_sql, m[1]))})" for i, m in enumerate(MANNERS))
_CARS_SQL = ", ".join(f"({i}, {_sql(c[2])}, {_sql(c[3])})" for i, c in enumerate(CARS))
_FACTS = f"""WITH n AS (
  SELECT o_orderkey AS k, 1996 + o_custkey % 29 AS year, 20500 + 100 * (o_orderkey * 37 % 2000) AS km, 3000 + 50 * (o_custkey * 13 % 500) AS price,
    '90533' || lpad((o_orderkey % 10000000)::VARCHAR, 7, '0') AS mobile FROM orders),
facts AS (
  SELECT n.*, m.*, c.* FROM n JOIN (VALUES {_MANNERS_SQL}) m(i, reason, priced, currency, guess, kind, called, swap, at_end, body) ON m.i = (n.k // {len(CARS)}) % {len(MANNERS)}
  JOIN (VALUES {_CARS_SQL}) c(j, make, model) ON c.j = n.k % {len(CARS)})"""
ORACLE_SQL = {
    "TX29_TX30_TX31_TX32_TX33_TX36_TX37_TX38_TX39_TX40_free_posts": f"""{_FACTS}
SELECT k AS o_orderkey, reason, CASE WHEN reason = 'ok' THEN make END AS brand, CASE WHEN reason = 'ok' THEN model END AS model,
  CASE WHEN reason = 'ok' THEN year END::INTEGER AS year, CASE kind WHEN 'km' THEN km WHEN 'least' THEN km // 1000 * 1000 END::INTEGER AS km,
  CASE WHEN reason = 'ok' THEN coalesce(kind = 'least', false) END AS km_least, CASE WHEN called THEN mobile END AS phone, CASE WHEN priced THEN price END::DOUBLE AS price_amount,
  currency, CASE WHEN reason = 'ok' THEN guess END AS currency_guess, swap::BOOLEAN AS swap FROM facts""",
    "TX34_TX35_post_prices": f"""{_FACTS}
SELECT k AS o_orderkey, CASE WHEN body THEN price END::DOUBLE AS amount, CASE WHEN body THEN CASE WHEN i = 14 THEN 'EUR' ELSE 'GBP' END END AS currency, at_end FROM facts""",
}
