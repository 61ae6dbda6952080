"""Queries of the robust curves, estimates and curve rows of the price book. The analogue's prices depend on quantity, so curves are looser than those of cars."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from advertlake.operators import curves as C
from advertlake.settings import ANALOGUE as S
from advertlake.sources.listings import LISTINGS_SQL, listings


_THIN = ["ECONOMY", "PROMO"]


def _r(*cols):
    return [F.round(c, 5).alias(c) for c in cols]


def robust(spark, d):
    return C.robust_curves(listings(spark, d), S).select("brand_norm", "model_norm", *_r("my", "b_age", "b_km", "sigma", "km_per_year"), "n", "sellers", "min_year", "max_year", F.col("max_km").cast("long").alias("max_km"))


def estimates(spark, d):
    x = listings(spark, d)
    got = C.estimates(x, C.robust_curves(x, S), C.dense_years(x, S), S)
    return got.select("id", F.round(F.ln("value"), 5).alias("ln_value"), F.round(F.ln("lower"), 5).alias("ln_lower"), "n", "sellers")


def curve_rows(spark, d):
    x = listings(spark, d)
    got = C.curve_rows(C.robust_curves(x, S), C.dense_years(x, S), S)
    return got.select("brand_norm", "model_norm", "year", F.col("ref_km").cast("long").alias("ref_km"), F.round(F.ln("value"), 5).alias("ln_value"), F.round(F.ln("high"), 5).alias("ln_high"), "n")


def comparable_rows(spark, d):
    x = listings(spark, d)
    got = C.comparable_rows(x, C.robust_curves(x, S), S)
    return got.select("brand_norm", "model_norm", "year", F.col("ref_km").cast("long").alias("ref_km"), *[F.round(F.ln(c), 5).alias(f"ln_{c}") for c in ("value", "low", "high")], "n", "sellers")


def whole_book(spark, d):
    """Half of the models are too thin for rows of their own, so that all three methods give some."""
    x = listings(spark, d)
    thin = F.when(F.col("model_norm").isin(_THIN), F.col("year") == 1999).otherwise(True)
    got = C.build_book(x.filter(thin & ~(F.col("model_norm").isin(_THIN) & (F.col("seller") % 10 > 1))), x.filter("is_sold and km is null"), S.but(brand_max_sigma=1.0))
    return got.select("brand_norm", "model_norm", "year", "method", "status", F.round(F.ln("value"), 5).alias("ln_value"), "n", "sellers", "sales_n")


def sales(spark, d):
    x = listings(spark, d)
    book = x.select("brand_norm", "model_norm", "year").distinct()
    return C.sales_info(book, x.filter("is_sold and km is null")).select("brand_norm", "model_norm", "year", "sales_n", F.round("sales_median", 4).alias("sales_median"))


def self_check(spark, d):
    x = listings(spark, d)
    got = C.self_check(x.filter(F.col("first_seen_at") > F.lit("1998-01-01").cast("timestamp")), C.robust_curves(x, S), S, 0.9)
    return got.select("brand_norm", "model_norm", "judged", *_r("error"), "unreliable")


def without(spark, d):
    x = listings(spark, d)
    got = C.curves_without(x, S)
    return got.select("id", *[(c + 0.0).alias(n) for n, c in zip(("my", "b_age", "b_km", "sigma"), _r("my", "b_age", "b_km", "sigma"))], "n", "sellers", "min_year", "max_year", F.col("max_km").cast("long").alias("max_km"))


def dry_run(spark, d):
    """Estimates of recent adverts, each by the curve of the others, and how far the price lies below them."""
    x = listings(spark, d)
    got = C.estimates_without(x.filter(F.col("first_seen_at") > F.lit("1998-01-01").cast("timestamp")), x, S)
    return got.select("id", F.round(F.ln("value"), 5).alias("ln_value"), F.round(F.ln("lower"), 5).alias("ln_lower"), (F.round(F.ln("price_gbp") - F.ln("value"), 5) + 0.0).alias("below"), "n", "sellers")


QUERIES = {"DM25_curves_without": without, "DM26_dry_run": dry_run, "AG31_robust_curves": robust, "DM22_estimates": estimates, "DM18_curve_rows": curve_rows, "AG25_AG27_WN13_DM21_DM24_comparable_rows": comparable_rows, "AG26_sales_info": sales, "DM18_DM20_SM36_whole_book": whole_book, "AG33_self_check": self_check}
_Y = S.as_of.year


def _fit_sql(src: str, out: str) -> str:
    """Weighted centred ridge by explicit deviations, in two steps."""
    return f"""{out}_m AS (SELECT *, sum(w * a) OVER g / sum(w) OVER g AS ma, sum(w * k) OVER g / sum(w) OVER g AS mk, sum(w * y) OVER g / sum(w) OVER g AS my FROM {src} WINDOW g AS (PARTITION BY brand_norm, model_norm)),
{out}_v AS (SELECT brand_norm, model_norm, any_value(ma) AS ma, any_value(mk) AS mk, any_value(my) AS my, sum(w * (a - ma) * (a - ma)) + 0.5::DOUBLE AS vaa, sum(w * (k - mk) * (k - mk)) + 0.5::DOUBLE AS vkk,
  sum(w * (a - ma) * (k - mk)) AS vak, sum(w * (a - ma) * (y - my)) AS vay, sum(w * (k - mk) * (y - my)) AS vky FROM {out}_m GROUP BY 1, 2 HAVING count(*) >= 8 AND count(DISTINCT year) >= 3),
{out}_f AS (SELECT *, (vay * vkk - vky * vak) / (vaa * vkk - vak * vak) AS fa, (vky * vaa - vay * vak) / (vaa * vkk - vak * vak) AS fk FROM {out}_v),
{out} AS (SELECT brand_norm, model_norm, ma, mk, my, CASE WHEN fk > -0.010 THEN (vay + 0.012::DOUBLE * vak) / vaa ELSE fa END AS b_age, CASE WHEN fk > -0.010 THEN -0.012::DOUBLE ELSE fk END AS b_km FROM {out}_f)"""


_RES = "y - my - b_age * (a - ma) - b_km * (k - mk)"
_CURVES = f"""{LISTINGS_SQL},
eff AS (SELECT *, CASE WHEN km IN (123456, 1234567, 654321, 12345678) OR regexp_matches(km::VARCHAR, '^(1{{6,7}}|2{{6,7}}|3{{6,7}}|4{{6,7}}|5{{6,7}}|6{{6,7}}|7{{6,7}}|8{{6,7}}|9{{6,7}})$')
  OR (km < 1000 AND {_Y} - year >= 2) OR (km < 15000 AND {_Y} - year >= 10) THEN NULL ELSE km END AS ekm FROM listings),
pts AS (SELECT brand_norm, model_norm, id, seller, year, ln(price_gbp) AS y, ({_Y} - year)::DOUBLE AS a, ekm / 10000.0::DOUBLE AS k, w FROM (
  SELECT *, least(1.0::DOUBLE, 2.0::DOUBLE / count(*) OVER (PARTITION BY brand_norm, model_norm, seller)) AS w FROM eff) WHERE price_gbp > 0 AND ekm IS NOT NULL AND steering IS DISTINCT FROM 'LHD'),
{_fit_sql('pts', 'f1')},
r1 AS (SELECT p.*, {_RES} AS r FROM pts p JOIN f1 USING (brand_norm, model_norm)),
r2 AS (SELECT *, abs(r - median(r) OVER (PARTITION BY brand_norm, model_norm)) AS off FROM r1),
r3 AS (SELECT *, median(off) OVER (PARTITION BY brand_norm, model_norm) AS mad FROM r2),
marked AS (SELECT brand_norm, model_norm, id, seller, year, y, a, k, w, mad <= 0 OR off <= 2.5::DOUBLE * 1.4826::DOUBLE * mad AS near FROM r3),
near AS (SELECT * FROM marked WHERE near),
{_fit_sql('near', 'f2')},
c AS (SELECT brand_norm, model_norm, f2.my IS NOT NULL AS refit, coalesce(f2.ma, f1.ma) AS ma, coalesce(f2.mk, f1.mk) AS mk, coalesce(f2.my, f1.my) AS my, coalesce(f2.b_age, f1.b_age) AS b_age, coalesce(f2.b_km, f1.b_km) AS b_km
  FROM f1 LEFT JOIN f2 USING (brand_norm, model_norm)),
curve AS (SELECT brand_norm, model_norm, any_value(ma) AS ma, any_value(mk) AS mk, any_value(my) AS my, any_value(b_age) AS b_age, any_value(b_km) AS b_km, sqrt(sum(w * pow({_RES}, 2)) / greatest(sum(w) - 3, 1)) AS sigma,
  count(*) AS n, count(DISTINCT seller) AS sellers, min(year) AS min_year, max(year) AS max_year, floor(max(k) * 10000 + 1e-6)::BIGINT AS max_km, median(k * 10000 / greatest(a, 1)) AS km_per_year
  FROM marked JOIN c USING (brand_norm, model_norm) WHERE near OR NOT refit GROUP BY 1, 2 HAVING sigma <= {S.curve_max_sigma} AND any_value(b_age) <= {S.curve_max_age_slope}),
dense AS (SELECT brand_norm, model_norm, of_year AS year FROM (SELECT brand_norm, model_norm, unnest(generate_series(year - 2, year + 2)) AS of_year FROM pts) GROUP BY ALL HAVING count(*) >= 3)"""
_LN = "my + b_age * (({y}) - ma) + least(b_km, -0.005::DOUBLE) * ({km} / 10000.0::DOUBLE - mk)"
_COMPS = f"""pool AS (SELECT * FROM eff WHERE price_gbp BETWEEN 500 AND 250000 AND (is_active OR is_sold) AND datediff('day', first_seen_at::DATE, DATE '{S.as_of}') <= {S.window_days}
  AND (NOT is_active OR datediff('day', first_seen_at::DATE, DATE '{S.as_of}') <= {S.active_max_age_days}) AND coalesce(steering, 'RHD') = 'RHD'),
wide AS (SELECT *, unnest([year - 1, year, year + 1]) AS o FROM pool),
near_y AS (SELECT w.* FROM wide w JOIN (SELECT DISTINCT brand_norm, model_norm, year AS o FROM pool) y USING (brand_norm, model_norm, o)),
cap AS (SELECT * FROM near_y QUALIFY row_number() OVER (PARTITION BY brand_norm, model_norm, o, seller ORDER BY first_seen_at DESC, id) <= 2),
ref AS (SELECT *, CASE WHEN count(*) FILTER (ekm <> 0) OVER g >= 3 THEN floor(median(ekm) FILTER (ekm <> 0) OVER g) END AS ref_km FROM cap WINDOW g AS (PARTITION BY brand_norm, model_norm, o)),
adj AS (SELECT r.*, exp(ln(price_gbp) + coalesce(least(b_age, 0), -0.08::DOUBLE) * (r.year - o) + coalesce(coalesce(least(b_km, -0.005::DOUBLE), -0.03::DOUBLE) * (ref_km - CASE WHEN ekm <> 0 THEN ekm END) / 10000, 0)) AS adj
  FROM ref r LEFT JOIN curve USING (brand_norm, model_norm)),
sorted AS (SELECT brand_norm, model_norm, o, list_sort(list(adj)) AS xs, count(*) AS n0, median(adj) AS m FROM adj GROUP BY ALL HAVING count(*) >= 3),
rank AS (SELECT *, greatest(1, least((n0 + 1) // 4, n0 - 1)) AS j1, greatest(1, least(3 * (n0 + 1) // 4, n0 - 1)) AS j3 FROM sorted),
quart AS (SELECT *, (xs[j1] * (4 - (n0 + 1 - 4 * j1)) + xs[j1 + 1] * (n0 + 1 - 4 * j1)) / 4 AS q1, (xs[j3] * (4 - (3 * (n0 + 1) - 4 * j3)) + xs[j3 + 1] * (3 * (n0 + 1) - 4 * j3)) / 4 AS q3 FROM rank),
fence AS (SELECT brand_norm, model_norm, o, CASE WHEN n0 < 8 THEN 0.5 * m ELSE q1 - 1.5 * (q3 - q1) END AS lo, CASE WHEN n0 < 8 THEN m / 0.5 ELSE q3 + 1.5 * (q3 - q1) END AS hi FROM quart),
kept AS (SELECT a.* FROM adj a JOIN fence f USING (brand_norm, model_norm, o) WHERE a.adj BETWEEN f.lo AND f.hi)"""
_BASE = _CURVES.replace("listings AS (", "listings_all AS (", 1).replace("""eff AS (SELECT *""", f"""listings AS (SELECT * FROM listings_all WHERE model_norm NOT IN ('ECONOMY', 'PROMO') OR (year = 1999 AND seller % 10 <= 1)),
eff AS (SELECT *""", 1)
_BRAND = _CURVES.split("pts AS (", 1)[1]


def _brand_sql() -> str:
    """The curves over all models of a brand, under names of their own."""
    text = "pts AS (" + _BRAND.split(",\ndense AS", 1)[0]
    text = text.replace("SELECT brand_norm, model_norm, id", "SELECT brand_norm, '*' AS model_norm, id", 1).replace("PARTITION BY brand_norm, model_norm, seller", "PARTITION BY brand_norm, seller", 1)
    return re.sub(r"\b(pts|f1_m|f1_v|f1_f|f1|r1|r2|r3|marked|near|f2_m|f2_v|f2_f|f2|c|curve)\b(?=[ ,.)\n])", r"\1_x", text)


# every row of a model against the points of the others, summed anew
_PLAIN = _CURVES.replace("least(1.0::DOUBLE, 2.0::DOUBLE / count(*) OVER (PARTITION BY brand_norm, model_norm, seller)) AS w", "1.0::DOUBLE AS w")
_WITHOUT = f"""{_PLAIN},
used AS MATERIALIZED (SELECT brand_norm, model_norm, id, seller, year, y, a, k FROM marked JOIN c USING (brand_norm, model_norm) WHERE near OR NOT refit),
sums AS MATERIALIZED (SELECT e.id, count(*) AS n, count(DISTINCT u.seller) AS sellers, count(DISTINCT u.year) AS years, min(u.year) AS min_year, max(u.year) AS max_year, floor(max(u.k) * 10000 + 1e-6)::BIGINT AS max_km,
  avg(u.a) AS ma, avg(u.k) AS mk, avg(u.y) AS my FROM eff e JOIN used u ON u.brand_norm = e.brand_norm AND u.model_norm = e.model_norm AND u.id <> e.id GROUP BY e.id HAVING count(*) >= {S.curve_min_rows} AND count(DISTINCT u.year) >= {S.curve_min_years}),
dev AS (SELECT e.id, sum((u.a - ma) * (u.a - ma)) AS aa, sum((u.k - mk) * (u.k - mk)) AS kk, sum((u.a - ma) * (u.k - mk)) AS ak, sum((u.a - ma) * (u.y - my)) AS ay, sum((u.k - mk) * (u.y - my)) AS ky, sum((u.y - my) * (u.y - my)) AS yy
  FROM eff e JOIN sums USING (id) JOIN used u ON u.brand_norm = e.brand_norm AND u.model_norm = e.model_norm AND u.id <> e.id GROUP BY e.id),
slope AS (SELECT *, aa + {S.ridge_lambda}::DOUBLE AS va, kk + {S.ridge_lambda}::DOUBLE AS vk FROM dev JOIN sums USING (id)),
bent AS (SELECT *, (ky * va - ay * ak) / (va * vk - ak * ak) AS fk FROM slope),
line AS (SELECT *, CASE WHEN fk > -0.010 THEN -0.012::DOUBLE ELSE fk END AS b_km, CASE WHEN fk > -0.010 THEN (ay + 0.012::DOUBLE * ak) / va ELSE (ay * vk - ky * ak) / (va * vk - ak * ak) END AS b_age FROM bent),
lone AS (SELECT * FROM (SELECT *, sqrt(greatest(yy - 2 * (b_age * ay + b_km * ky) + b_age * b_age * aa + 2 * b_age * b_km * ak + b_km * b_km * kk, 0) / greatest(n - 3, 1)) AS sigma FROM line)
  WHERE sigma <= {S.curve_max_sigma} AND b_age <= {S.curve_max_age_slope})"""
ORACLE_SQL = {
    "DM25_curves_without": f"""WITH {_WITHOUT} SELECT id, round(my, 5) + 0.0::DOUBLE AS my, round(b_age, 5) + 0.0::DOUBLE AS b_age, round(b_km, 5) + 0.0::DOUBLE AS b_km, round(sigma, 5) + 0.0::DOUBLE AS sigma, n, sellers, min_year, max_year, max_km FROM lone""",
    "DM26_dry_run": f"""WITH {_WITHOUT}, t AS (SELECT e.* FROM eff e WHERE steering IS DISTINCT FROM 'LHD' AND ekm IS NOT NULL AND first_seen_at > TIMESTAMP '1998-01-01'),
val AS (SELECT t.id, {_LN.format(y=f'{_Y} - t.year', km='ekm')} AS v, ln(t.price_gbp) AS p, sigma, l.n, l.sellers FROM t JOIN lone l ON l.id = t.id WHERE t.year BETWEEN min_year - 1 AND max_year + 1 AND ekm <= max_km * 1.1::DOUBLE
  AND l.sellers >= {S.est_min_curve_sellers} AND (SELECT count(*) FROM pts q WHERE q.brand_norm = t.brand_norm AND q.model_norm = t.model_norm AND abs(q.year - t.year) <= 2 AND q.id <> t.id) >= 3)
SELECT id, round(v, 5) AS ln_value, round(v - {S.est_z}::DOUBLE * sigma, 5) AS ln_lower, round(p - v, 5) + 0.0::DOUBLE AS below, n, sellers FROM val""",
    "AG31_robust_curves": f"""WITH {_CURVES} SELECT brand_norm, model_norm, round(my, 5) AS my, round(b_age, 5) AS b_age, round(b_km, 5) AS b_km, round(sigma, 5) AS sigma, round(km_per_year, 5) AS km_per_year, n, sellers, min_year, max_year, max_km FROM curve""",
    "DM22_estimates": f"""WITH {_CURVES} SELECT e.id, round({_LN.format(y=f'{_Y} - e.year', km='ekm')}, 5) AS ln_value, round({_LN.format(y=f'{_Y} - e.year', km='ekm')} - {S.est_z}::DOUBLE * sigma, 5) AS ln_lower, n, sellers
FROM eff e JOIN curve USING (brand_norm, model_norm) JOIN dense USING (brand_norm, model_norm, year)
WHERE steering IS DISTINCT FROM 'LHD' AND ekm IS NOT NULL AND e.year BETWEEN min_year - 1 AND max_year + 1 AND ekm <= max_km * 1.1::DOUBLE AND sellers >= {S.est_min_curve_sellers}""",
    "DM18_curve_rows": f"""WITH {_CURVES}, y AS (SELECT *, floor(least(km_per_year * greatest({_Y} - year, 0.5::DOUBLE), max_km) + 1e-6)::BIGINT AS ref_km FROM curve JOIN dense USING (brand_norm, model_norm) WHERE year BETWEEN min_year AND max_year)
SELECT brand_norm, model_norm, year, ref_km, round({_LN.format(y=f'{_Y} - year', km='ref_km')}, 5) AS ln_value, round({_LN.format(y=f'{_Y} - year', km='ref_km')} + {S.est_z}::DOUBLE * sigma, 5) AS ln_high, n FROM y""",
    "AG25_AG27_WN13_DM21_DM24_comparable_rows": f"""WITH {_CURVES},
{_COMPS}
SELECT brand_norm, model_norm, o AS year, any_value(ref_km)::BIGINT AS ref_km, round(ln(median(adj)), 5) AS ln_value, round(ln(quantile_cont(adj, 0.25)), 5) AS ln_low, round(ln(quantile_cont(adj, 0.75)), 5) AS ln_high,
  count(*) AS n, count(DISTINCT seller) AS sellers FROM kept GROUP BY ALL HAVING count(*) >= 3""",
    "DM18_DM20_SM36_whole_book": f"""WITH {_BASE},
{_COMPS},
a AS (SELECT brand_norm, model_norm, o AS year, ln(median(adj)) AS v, count(*) AS n, count(DISTINCT seller) AS sellers FROM kept GROUP BY ALL HAVING count(*) >= 3),
a2 AS (SELECT *, CASE WHEN n < 5 OR sellers < 3 THEN 'ince' ELSE 'oturmus' END AS status FROM a),
b AS (SELECT brand_norm, model_norm, y.year, {_LN.format(y=f'{_Y} - y.year', km='ref_km')} AS v, y.n, y.sellers, CASE WHEN y.n < 5 OR y.sellers < {S.est_min_curve_sellers} THEN 'ince' ELSE 'oturmus' END AS status
  FROM (SELECT *, floor(least(km_per_year * greatest({_Y} - year, 0.5::DOUBLE), max_km) + 1e-6)::BIGINT AS ref_km FROM curve JOIN dense USING (brand_norm, model_norm) WHERE year BETWEEN min_year AND max_year) y
  WHERE NOT EXISTS (SELECT 1 FROM a2 WHERE a2.brand_norm = y.brand_norm AND a2.model_norm = y.model_norm AND a2.year = y.year AND a2.status <> 'ince')),
ab AS (SELECT brand_norm, model_norm, year, 'B' AS method, status, v, n, sellers FROM b UNION ALL SELECT brand_norm, model_norm, year, 'A', status, v, n, sellers FROM a2 WHERE (brand_norm, model_norm, year) NOT IN (SELECT (brand_norm, model_norm, year) FROM b)),
{_brand_sql()},
bare AS (SELECT DISTINCT p.brand_norm, p.model_norm, p.year FROM (SELECT * FROM eff WHERE price_gbp BETWEEN 500 AND 250000 AND (is_active OR is_sold) AND datediff('day', first_seen_at::DATE, DATE '{S.as_of}') <= {S.window_days}
  AND (NOT is_active OR datediff('day', first_seen_at::DATE, DATE '{S.as_of}') <= {S.active_max_age_days})) p WHERE (p.brand_norm, p.model_norm) NOT IN (SELECT (brand_norm, model_norm) FROM ab)),
cc AS (SELECT q.brand_norm, q.model_norm, q.year, 'C' AS method, 'ince' AS status, {_LN.format(y=f'{_Y} - q.year', km='ref_km')} AS v, n, sellers
  FROM (SELECT b.*, x.* EXCLUDE (brand_norm, model_norm), floor(least(km_per_year * greatest({_Y} - b.year, 0.5::DOUBLE), max_km) + 1e-6)::BIGINT AS ref_km FROM bare b JOIN curve_x x ON x.brand_norm = b.brand_norm) q),
book AS (SELECT * FROM ab UNION ALL SELECT * FROM cc),
sold AS (SELECT brand_norm, model_norm, unnest([year - 1, year, year + 1]) AS year FROM listings_all WHERE is_sold AND km IS NULL)
SELECT k.brand_norm, k.model_norm, k.year, k.method, k.status, round(k.v, 5) AS ln_value, k.n, k.sellers, (SELECT count(*) FROM sold s WHERE s.brand_norm = k.brand_norm AND s.model_norm = k.model_norm AND s.year = k.year) AS sales_n FROM book k""",
    "AG26_sales_info": f"""WITH {LISTINGS_SQL}, b AS (SELECT DISTINCT brand_norm, model_norm, year FROM listings)
SELECT b.brand_norm, b.model_norm, b.year, count(l.id) AS sales_n, round(median(l.price_gbp), 4) AS sales_median FROM b LEFT JOIN listings l
  ON l.brand_norm = b.brand_norm AND l.model_norm = b.model_norm AND abs(l.year - b.year) <= 1 AND l.is_sold AND l.km IS NULL GROUP BY ALL""",
    "AG33_self_check": f"""WITH {_CURVES}, e AS (SELECT brand_norm, model_norm, abs(ln(price_gbp) - ({_LN.format(y=f'{_Y} - e.year', km='ekm')})) AS off FROM eff e JOIN curve USING (brand_norm, model_norm)
  WHERE steering IS DISTINCT FROM 'LHD' AND ekm IS NOT NULL AND price_gbp > 0 AND first_seen_at > TIMESTAMP '1998-01-01')
SELECT brand_norm, model_norm, count(*) AS judged, round(exp(median(off)) - 1, 5) AS error, count(*) >= 5 AND exp(median(off)) - 1 > 0.9 AS unreliable FROM e GROUP BY ALL""",
}
