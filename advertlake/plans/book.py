"""Queries of the price book and of the text rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from advertlake.functions import text as X
from advertlake.functions.rules import placeholder_amount
from advertlake.operators import book
from advertlake.session import table
from advertlake.settings import ANALOGUE as S
from advertlake.sources.listings import LISTINGS_SQL, listings

# fixed values: rule tables of name and pattern


def curves(spark, d):
    got = book.ridge_curves(listings(spark, d), S)
    return got.select("brand_norm", "model_norm", "n", *[F.round(c, 6).alias(c) for c in ("b_age", "b_km", "intercept")], "km_fixed")


def status(spark, d):
    x = listings(spark, d)
    def side(rows):
        return rows.groupBy("brand_norm", "model_norm").agg(F.median("price_gbp").alias("value"), F.count("*").alias("n"), F.count_distinct("seller").alias("sellers"))
    new = side(x.filter("is_sold"))
    near = new.select("brand_norm", "model_norm", (F.col("value") * 1.05).alias("candidate"), F.when(F.col("n") % 3 == 0, 1).otherwise(0).alias("nights"))
    prev = side(x.filter("is_active")).select("brand_norm", "model_norm", "value").join(near.filter(F.col("brand_norm").endswith("1")), ["brand_norm", "model_norm"], "left")
    got = book.next_status(prev, new, ["brand_norm", "model_norm"], S.but(book_change_limit=0.03))
    return got.select("brand_norm", "model_norm", F.round("value", 4).alias("value"), "nights", "status")


def quarantine(spark, d):
    return book.quarantine(listings(spark, d), S).withColumn("mid", F.round("mid", 4))


def duplicates(spark, d):
    return book.greedy_duplicates(listings(spark, d).dropDuplicates(["id"]), S)


def mentioned_handles(spark, d):
    h = table(spark, d, "documents").select("doc_id", F.explode(X.handles(F.col("text"))).alias("handle"))
    g = h.groupBy("handle").agg(F.count_distinct("doc_id").alias("docs")).filter("docs >= 2")
    return g.orderBy(F.desc("docs"), "handle").limit(40)


def links(spark, d):
    return table(spark, d, "pages").select("page_id", X.pasted_link(F.concat(F.col("url"), F.when(F.col("page_id") % 3 == 0, ").").otherwise(""))).alias("canon"))


def titles(spark, d):
    h = F.col("html")
    items = F.regexp_extract_all(h, F.lit('<li><a href="([^"]*)"'), 1)
    return table(spark, d, "pages").select("page_id", F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"), F.size(items).cast("long").alias("entries"))


def amounts(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.floor(F.col("o_orderkey")).cast("double").alias("x"))
    return o.filter(placeholder_amount(F.col("x"))).select("o_orderkey")


QUERIES = {
    "AG28_AG30_ridge_curves": curves, "DM19_book_status": status, "AG34_quarantine": quarantine, "DM30_greedy_duplicates": duplicates,
    "JN07_AG19_mentioned_handles": mentioned_handles, "TX63_SF24_pasted_link": links,
    "SC27_list_entries": titles, "PR06_placeholder_amount": amounts,
}
# the sequential rule: step i takes the i-th advert of every group, with the heads of the group so far as a list
_GREEDY = f"""WITH RECURSIVE {LISTINGS_SQL},
e AS (SELECT DISTINCT ON (id) id, brand_norm, model_norm, year, price_gbp, seller, is_active, first_seen_at, coalesce(CASE WHEN km IN (123456, 1234567, 654321, 12345678)
    OR regexp_matches(km::VARCHAR, '^(1{{6,7}}|2{{6,7}}|3{{6,7}}|4{{6,7}}|5{{6,7}}|6{{6,7}}|7{{6,7}}|8{{6,7}}|9{{6,7}})$') OR (km < 1000 AND {S.as_of.year} - year >= 2) OR (km < 15000 AND {S.as_of.year} - year >= 10) THEN NULL ELSE km END, 0)::DOUBLE AS km FROM listings),
o AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY brand_norm, model_norm, year) AS g, row_number() OVER (PARTITION BY brand_norm, model_norm, year ORDER BY first_seen_at NULLS LAST, id) AS i FROM e),
edge AS MATERIALIZED (
  SELECT a.g, a.i, list(b.i) AS m FROM o a JOIN o b ON a.g = b.g AND b.i < a.i AND (NOT a.is_active OR b.is_active)
    AND CASE WHEN a.km <> 0 AND b.km <> 0 THEN abs(a.km - b.km) <= greatest(500, 0.02::DOUBLE * greatest(a.km, b.km)) AND (a.seller = b.seller OR abs(a.price_gbp - b.price_gbp)
        <= CASE WHEN a.km % 1000 = 0 AND b.km % 1000 = 0 THEN 0.03::DOUBLE ELSE 0.15::DOUBLE END * greatest(a.price_gbp, b.price_gbp))
      ELSE a.seller = b.seller AND abs(a.price_gbp - b.price_gbp) <= 0.15::DOUBLE * greatest(a.price_gbp, b.price_gbp) END GROUP BY a.g, a.i),
row_ AS MATERIALIZED (SELECT o.g, o.i, o.id, coalesce(edge.m, []) AS m FROM o LEFT JOIN edge USING (g, i)),
walk(g, i, heads, head) AS (
  SELECT DISTINCT g, 0::BIGINT, []::BIGINT[], NULL::BIGINT FROM o
  UNION ALL
  SELECT g, i, CASE WHEN head IS NULL THEN list_append(heads, i) ELSE heads END, head FROM (
    SELECT w.g, r.i, w.heads, list_min(list_intersect(r.m, w.heads)) AS head FROM walk w JOIN row_ r ON r.g = w.g AND r.i = w.i + 1))
SELECT r.id, c.id AS canonical FROM walk w JOIN row_ r USING (g, i) JOIN row_ c ON c.g = w.g AND c.i = coalesce(w.head, w.i)"""
ORACLE_SQL = {
    "DM30_greedy_duplicates": _GREEDY,
    "AG28_AG30_ridge_curves": f"""WITH {LISTINGS_SQL},
x AS (SELECT brand_norm, model_norm, year, ln(price_gbp) AS y, (1998 - year)::DOUBLE AS a, km / 10000.0::DOUBLE AS k, least(1.0::DOUBLE, 2.0::DOUBLE / count(*) OVER (PARTITION BY brand_norm, model_norm, seller)) AS w
  FROM listings WHERE price_gbp > 0 AND km IS NOT NULL),
m AS (SELECT *, sum(w * a) OVER g / sum(w) OVER g AS ma, sum(w * k) OVER g / sum(w) OVER g AS mk, sum(w * y) OVER g / sum(w) OVER g AS my FROM x WINDOW g AS (PARTITION BY brand_norm, model_norm)),
v AS (SELECT brand_norm, model_norm, count(*) AS n, any_value(ma) AS ma, any_value(mk) AS mk, any_value(my) AS my, sum(w * (a - ma) * (a - ma)) + 0.5 AS vaa, sum(w * (k - mk) * (k - mk)) + 0.5 AS vkk,
  sum(w * (a - ma) * (k - mk)) AS vak, sum(w * (a - ma) * (y - my)) AS vay, sum(w * (k - mk) * (y - my)) AS vky FROM m GROUP BY 1, 2 HAVING count(*) >= 8 AND count(DISTINCT year) >= 3),
f AS (SELECT *, (vky * vaa - vay * vak) / (vaa * vkk - vak * vak) > -0.010 AS km_fixed, (vay * vkk - vky * vak) / (vaa * vkk - vak * vak) AS fa, (vky * vaa - vay * vak) / (vaa * vkk - vak * vak) AS fk FROM v),
b AS (SELECT *, CASE WHEN km_fixed THEN (vay + 0.012::DOUBLE * vak) / vaa ELSE fa END AS b_age, CASE WHEN km_fixed THEN -0.012::DOUBLE ELSE fk END AS b_km FROM f)
SELECT brand_norm, model_norm, n, round(b_age, 6) AS b_age, round(b_km, 6) AS b_km, round(my - b_age * ma - b_km * mk, 6) AS intercept, km_fixed FROM b""",
    "DM19_book_status": f"""WITH {LISTINGS_SQL},
o AS (SELECT brand_norm, model_norm, median(price_gbp) AS old FROM listings WHERE is_active GROUP BY 1, 2),
n AS (SELECT brand_norm, model_norm, median(price_gbp) AS value, count(*) AS n, count(DISTINCT seller) AS sellers FROM listings WHERE is_sold GROUP BY 1, 2),
j AS (SELECT n.*, o.old, coalesce(abs(value - old) > 0.03::DOUBLE * old, false) AS jump, n.brand_norm LIKE '%1' AS again, CASE WHEN n.brand_norm LIKE '%1' AND n.n % 3 = 0 THEN 2 ELSE 1 END AS night FROM n LEFT JOIN o USING (brand_norm, model_norm)),
h AS (SELECT *, jump AND NOT (again AND night >= 2) AS held FROM j)
SELECT brand_norm, model_norm, round(CASE WHEN held THEN old ELSE value END, 4) AS value, CASE WHEN held THEN night ELSE 0 END AS nights,
CASE WHEN held THEN 'supheli' WHEN n < 5 OR sellers < 3 THEN 'ince' ELSE 'oturmus' END AS status FROM h""",
    "AG34_quarantine": f"""WITH {LISTINGS_SQL}, r AS (SELECT *, CASE WHEN price_gbp <= 10 THEN 'fiyat_yer_tutucu' WHEN year NOT BETWEEN 1970 AND 1999 THEN 'yil_supheli'
WHEN km > 600000 OR (greatest(1, 1998 - year) >= 2 AND km / greatest(1, 1998 - year) > 80000) THEN 'km_supheli' END AS reason FROM listings),
p AS (SELECT a.id, any_value(a.price_gbp) AS price, count(*) AS peers, median(b.price_gbp) AS mid FROM r a JOIN r b ON a.brand_norm = b.brand_norm AND a.model_norm = b.model_norm
AND abs(a.year - b.year) <= 2 AND a.id <> b.id AND a.reason IS NULL AND b.reason IS NULL GROUP BY a.id HAVING count(*) >= 8)
SELECT id, reason, NULL::BIGINT AS peers, NULL::DOUBLE AS mid FROM r WHERE reason IS NOT NULL
UNION ALL SELECT id, CASE WHEN price < mid * 0.40::DOUBLE THEN 'fiyat_ucuz_supheli' ELSE 'fiyat_pahali_supheli' END, peers, round(mid, 4) FROM p WHERE price < mid * 0.40::DOUBLE OR price > mid * 2.50::DOUBLE""",
    "JN07_AG19_mentioned_handles": """SELECT handle, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(text, '@([A-Za-z0-9._-]+)', 1)) AS handle FROM documents)
GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2 ORDER BY docs DESC, handle LIMIT 40""",
    "TX63_SF24_pasted_link": r"""WITH u AS (SELECT page_id, rtrim(url || CASE WHEN page_id % 3 = 0 THEN ').' ELSE '' END, ').,;!?') AS url FROM pages),
x AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^(www|m|web|mobile)\.', '') AS host,
  rtrim(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/') AS path FROM u) SELECT page_id, CASE WHEN host <> '' AND path <> '' THEN host || path END AS canon FROM x""",
    "SC27_list_entries": """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<li><a href="([^"]*)"', 1)) AS entries FROM pages""",
    "PR06_placeholder_amount": """SELECT o_orderkey FROM orders WHERE regexp_matches(o_orderkey::VARCHAR, '^(0{5,}|1{5,}|2{5,}|3{5,}|4{5,}|5{5,}|6{5,}|7{5,}|8{5,}|9{5,})$')
OR (starts_with('1234567890', o_orderkey::VARCHAR) AND length(o_orderkey::VARCHAR) >= 4) OR (starts_with('9876543210', o_orderkey::VARCHAR) AND length(o_orderkey::VARCHAR) >= 5)""",
}
