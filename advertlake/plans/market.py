"""Queries of the comparable market and the decisions on it, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from advertlake.functions.rules import buy_ceiling
from advertlake.operators import decision, market
from advertlake.operators.curves import medians
from advertlake.settings import ANALOGUE as S
from advertlake.sources.listings import LISTINGS_SQL, listings
from advertlake.sources.shared import persisted


def _targets(pool: DataFrame) -> DataFrame:
    """Every advert is a target, against the complete pool."""
    return pool.dropDuplicates(["id"])


def _money(*cols: str):
    return [F.round(c, 6).alias(c) for c in cols]


def market_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = listings(spark, sf_dir)
    return market.market_median(_targets(pool), pool, S).select(F.col("t_id").alias("id"), "n", "sellers_n", *_money("median", "p25"))


def find_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = listings(spark, sf_dir)
    got = market.find_market(_targets(pool), pool, S)
    return got.select(
        F.col("t_id").alias("id"), "step", F.col("n").cast("long").alias("n"), F.col("sellers_n").cast("long").alias("sellers_n"),
        *_money("median", "p25", "low", "high", "archived_share", "median_year", "z"), "median_km", F.col("near_n").cast("long").alias("near_n"), "merged",
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = listings(spark, sf_dir)
    t = _targets(pool)
    got = decision.assess(market.find_market(t, pool, S), S)
    return got.select(
        F.col("t_id").alias("id"), F.col("n").cast("long").alias("n"), *_money("profit", "profit_pct"), "confidence", "raw_tier", "tier",
        F.array_join("gaps", ",").alias("gaps"), F.round(buy_ceiling(F.col("median"), S), 6).alias("ceiling"),
    )


def evaluate_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quick round: active adverts first seen in the last days before the instant of the settings are assessed against the whole pool."""
    pool = listings(spark, sf_dir)
    t = decision.work_list(pool, S).dropDuplicates(["id"])
    got = decision.assess(market.find_market(t, pool, S), S)
    return got.select(F.col("t_id").alias("id"), F.col("n").cast("long").alias("n"), *_money("profit", "profit_pct"), "confidence", "tier", F.array_join("gaps", ",").alias("gaps"))


def decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = listings(spark, sf_dir)
    got = decision.decide(_targets(pool), pool, S)
    return got.select(F.col("t_id").alias("id"), "tier", F.array_join("gaps", ",").alias("gaps"), *_money("profit", "z"))


def tier_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of the asking price against the market, and tier rates, by confidence."""
    pool = listings(spark, sf_dir)
    t = _targets(pool)
    d = decision.assess(market.find_market(t, pool, S), S)
    err = F.abs(F.col("t_price_gbp") - F.col("median")) / F.col("median")
    d = persisted(d.select("confidence", "raw_tier", "tier", err.alias("err")))
    rates = d.groupBy("confidence").agg(F.count("*").alias("adverts"), F.count_if(F.col("raw_tier") == "guclu").alias("strong"), F.count_if(F.col("tier") == "pazarlik").alias("negotiable"))
    mid = medians(d, ["confidence"], "err", "median_error", cells=1 << 16)
    return rates.join(mid, "confidence", "left").select("confidence", "adverts", F.round("median_error", 6).alias("median_error"), "strong", "negotiable")


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = listings(spark, sf_dir)
    got = market.nearest_comparables(_targets(pool), pool, S)
    return got.select(F.col("t_id").alias("id"), "rank", F.col("id").alias("other_id"), F.round("distance", 6).alias("distance"))


def _clear(d: DataFrame) -> DataFrame:
    return d.select(F.col("t_id").alias("id"), F.col("n").cast("long").alias("n"), *_money("profit", "profit_pct", "z"))


def clean_negotiable(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = listings(spark, sf_dir)
    return _clear(decision.clean_negotiable(_targets(pool), pool, S))


def cheap_to_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = listings(spark, sf_dir)
    return _clear(decision.cheap_to_verify(_targets(pool), pool, S))


def ask_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = listings(spark, sf_dir)
    return decision.ask_value(_targets(pool), pool, S).select(F.col("t_id").alias("id"), F.col("n").cast("long").alias("n"), *_money("median"), F.col("max_buy").cast("double").alias("max_buy"))


def send_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each assessed advert: whether it may be sent, is worth sharing, and its profit as the stored percentage."""
    pool = listings(spark, sf_dir)
    t = _targets(pool)
    d = decision.assess(market.find_market(t, pool, S), S)
    price = F.col("t_price_gbp")
    method = F.when(F.col("t_year") % 2 == 0, "A").otherwise("B")
    pct = F.greatest(F.lit(-999.99), F.least(F.lit(999.99), F.round(F.col("profit_pct") * 100, 2)))
    return d.select(F.col("t_id").alias("id"), decision.send_floor(F.col("tier"), F.col("n"), method, S).alias("sendable"), decision.worth_sharing(price, F.col("median"), S, 0.10).alias("shared"), F.floor(pct).alias("percent"))


_DATE = f"DATE '{S.as_of}'"
_EFFECTIVE = """CASE WHEN km IN (123456, 1234567, 654321, 12345678) OR regexp_matches(km::VARCHAR, '^(1{6,7}|2{6,7}|3{6,7}|4{6,7}|5{6,7}|6{6,7}|7{6,7}|8{6,7}|9{6,7})$')
    OR coalesce((km < 1000 AND 1998 - year >= 2) OR (km < 15000 AND 1998 - year >= 10), false) THEN NULL ELSE km END"""
# adverts and targets go by numbers in the order of their ids, and pairs hold what the statistics need and no more: DuckDB then keeps them in memory
_PAIRS = f"""{LISTINGS_SQL},
eff AS MATERIALIZED (SELECT * REPLACE ({_EFFECTIVE} AS km, seller::INTEGER AS seller), dense_rank() OVER (ORDER BY id)::INTEGER AS k FROM listings),
names AS MATERIALIZED (SELECT k, any_value(id) AS id FROM eff GROUP BY k),
has_try AS (SELECT DISTINCT brand_norm, model_norm FROM listings WHERE currency = 'TRY'),
pool AS (SELECT * FROM eff WHERE price_gbp BETWEEN 500 AND 250000 AND (is_active OR is_sold) AND datediff('day', first_seen_at::DATE, {_DATE}) <= {S.window_days}
  AND (NOT is_active OR datediff('day', first_seen_at::DATE, {_DATE}) <= {S.active_max_age_days})),
target AS (SELECT DISTINCT ON (k) * FROM eff),
aim AS (SELECT t.*, unnest(generate_series(t.year - 2, t.year + 2)) AS of_year FROM target t),
pairs AS MATERIALIZED (
  SELECT t.k AS t_id, t.year::SMALLINT AS t_year, t.km AS t_km, r.k AS id, r.year::SMALLINT AS year, r.km, r.price_gbp, r.seller, r.is_active,
    t.currency <> 'TRY' AND r.currency <> 'TRY' AND h.brand_norm IS NOT NULL AS gbp,
    abs(r.year - t.year) + CASE WHEN r.km <> 0 AND t.km <> 0 THEN abs(r.km - t.km) / 30000.0::DOUBLE ELSE 1.0::DOUBLE END AS closeness
  FROM aim t JOIN pool r ON r.brand_norm = t.brand_norm AND r.model_norm = t.model_norm AND r.year = t.of_year AND r.k <> t.k
   AND coalesce(r.steering, 'RHD') = coalesce(t.steering, 'RHD') AND (r.transmission IS NULL OR t.transmission IS NULL OR r.transmission = t.transmission)
   AND (r.engine_l IS NULL OR t.engine_l IS NULL OR round(abs(r.engine_l - t.engine_l), 1) <= 0.3)
  LEFT JOIN has_try h ON h.brand_norm = t.brand_norm AND h.model_norm = t.model_norm)"""


def _steps_sql(span: int, targets: str) -> str:
    """The statistics of the two steps of a span, for the targets that a condition on t_id names."""
    x = f"_{span}"
    return f"""
stepped{x} AS (
  SELECT p.t_id, p.t_km, p.id, p.year, p.km, p.price_gbp, p.seller, p.is_active, p.closeness, s.step::TINYINT AS step
  FROM pairs p JOIN (VALUES ({2 * span - 1}, true), ({2 * span}, false)) s(step, gbp) ON NOT s.gbp OR p.gbp WHERE abs(p.year - p.t_year) <= {span} AND {targets}),
capped{x} AS MATERIALIZED (
  SELECT t_id, step, t_km, year, km, seller, is_active, CASE WHEN t_km IS NOT NULL AND km IS NOT NULL THEN price_gbp * exp(-0.011::DOUBLE * (t_km - km) / 10000) ELSE price_gbp END AS adj
  FROM stepped{x} QUALIFY row_number() OVER (PARTITION BY t_id, step, seller ORDER BY closeness, id) <= 2),
sorted{x} AS (SELECT t_id, step, list_sort(list(adj)) AS xs, count(*) AS n0, median(adj) AS m FROM capped{x} GROUP BY ALL HAVING count(*) >= 3),
rank{x} AS (SELECT *, greatest(1, least((n0 + 1) // 4, n0 - 1)) AS j1, greatest(1, least(3 * (n0 + 1) // 4, n0 - 1)) AS j3 FROM sorted{x}),
quart{x} AS (SELECT *, (xs[j1] * (4 - (n0 + 1 - 4 * j1)) + xs[j1 + 1] * (n0 + 1 - 4 * j1)) / 4 AS q1,
                    (xs[j3] * (4 - (3 * (n0 + 1) - 4 * j3)) + xs[j3 + 1] * (3 * (n0 + 1) - 4 * j3)) / 4 AS q3 FROM rank{x}),
fence{x} AS (SELECT t_id, step, CASE WHEN n0 < 8 THEN 0.5 * m ELSE q1 - 1.5 * (q3 - q1) END AS lo, CASE WHEN n0 < 8 THEN m / 0.5 ELSE q3 + 1.5 * (q3 - q1) END AS hi FROM quart{x}),
kept{x} AS (SELECT c.* FROM capped{x} c JOIN fence{x} f USING (t_id, step) WHERE c.adj BETWEEN f.lo AND f.hi),
logmid{x} AS (SELECT t_id, step, median(ln(adj)) AS lm FROM kept{x} GROUP BY ALL),
stat{x} AS (
  SELECT t_id, step, count(*) AS n, count(DISTINCT seller) AS sellers_n, median(adj) AS median, quantile_cont(adj, 0.25) AS p25, min(adj) AS low, max(adj) AS high,
    count(*) FILTER (NOT is_active) / count(*)::DOUBLE AS archived_share,
    CASE WHEN count(*) FILTER (km <> 0) >= 3 THEN floor(median(km) FILTER (km <> 0))::INTEGER END AS median_km,
    CASE WHEN any_value(t_km) IS NOT NULL THEN count(*) FILTER (km IS NULL OR abs(km - t_km) <= 50000) END AS near_n,
    median(year::DOUBLE) AS median_year, CASE WHEN count(*) >= 5 THEN greatest(1.4826 * median(abs(ln(adj) - lm)), 0.03) END AS sigma
  FROM kept{x} JOIN logmid{x} USING (t_id, step) GROUP BY t_id, step
  HAVING count(*) >= 3 AND (step IN (2, 4) OR count(*) >= 8) AND count(DISTINCT seller) >= 2)"""


_MARKET = f"""{_PAIRS},{_steps_sql(1, "true")},
rich AS (SELECT DISTINCT t_id FROM stat_1 WHERE n >= 8),{_steps_sql(2, "p.t_id NOT IN (SELECT t_id FROM rich)")},
stat AS (SELECT * FROM stat_1 UNION ALL SELECT * FROM stat_2),
pick AS (
  SELECT *, min(step) OVER w AS first_step, min(CASE WHEN n >= 8 THEN step END) OVER w AS rich_step FROM stat WINDOW w AS (PARTITION BY t_id)),
market AS (
  SELECT g.t_id, e.year AS t_year, e.km AS t_km, e.price_gbp AS t_price, e.currency AS t_currency, g.step, g.n, g.sellers_n, g.low, g.high, g.archived_share, g.near_n, g.median_year, g.sigma,
    least(g.median, f.median) AS median, least(g.p25, f.p25) AS p25, least(g.median_km, f.median_km) AS median_km, g.step > g.first_step AS merged
  FROM pick g JOIN pick f ON f.t_id = g.t_id AND f.step = g.first_step JOIN target e ON e.k = g.t_id WHERE g.step = coalesce(g.rich_step, g.first_step))"""
_DECIDED = f"""{_MARKET},
calc AS (SELECT *, 0.95 * median - t_price - 300 AS profit, (0.95 * median - t_price - 300) / t_price AS pct, ln(t_price / median) / sigma AS z FROM market),
t1 AS (SELECT *, CASE WHEN n < 3 THEN 'yok' WHEN pct >= 0.20 THEN 'guclu' WHEN pct >= 0.12 THEN 'pazarlik' ELSE 'yok' END AS a FROM calc),
t2 AS (SELECT *, CASE WHEN n < 8 AND pct < 0.30 THEN 'yok' WHEN n < 8 AND a = 'guclu' THEN 'pazarlik' ELSE a END AS b FROM t1),
t3 AS (SELECT *, CASE WHEN b = 'guclu' AND profit < 750 THEN 'pazarlik' ELSE b END AS c FROM t2),
raw AS (SELECT *, CASE WHEN t_price < 0.5 * median AND n < 8 THEN 'yok' WHEN t_price < 0.5 * median AND c = 'guclu' THEN 'pazarlik' ELSE c END AS raw_tier FROM t3),
gapped AS (
  SELECT *, concat_ws(',', CASE WHEN t_currency = 'TRY' THEN 'tl_fiyat' END, CASE WHEN near_n < 8 THEN 'km_yakin_emsal_az' END,
    CASE WHEN raw_tier = 'guclu' AND t_price > p25 THEN 'ucuz_ceyrek_degil' END,
    CASE WHEN raw_tier = 'guclu' AND (median_year - t_year >= 1 OR (step >= 3 AND median_year - t_year > 0)) THEN 'emsal_yili_yeni' END,
    CASE WHEN raw_tier = 'guclu' AND z > -2.0 THEN 'fiyat_gurultu' END) AS g FROM raw),
decided AS (SELECT *, CASE WHEN n >= 20 THEN 'yuksek' WHEN n >= 8 THEN 'orta' WHEN n >= 3 THEN 'dusuk' ELSE 'yok' END AS confidence,
  CASE WHEN raw_tier = 'guclu' AND g <> '' THEN 'pazarlik' ELSE raw_tier END AS tier, CASE WHEN raw_tier = 'guclu' THEN g ELSE '' END AS gaps FROM gapped)"""

_NAMES = re.findall(r"(?:^|,\n|\), )([a-z_0-9]+) AS (?:MATERIALIZED )?\(", _DECIDED.split("listings AS (", 1)[1])


def _again(text: str) -> str:
    """The same expressions under names of their own."""
    return re.sub(rf"\b({'|'.join(sorted(set(_NAMES) - {'eff', 'pool', 'has_try', 'names'}, key=len, reverse=True))})\b(?! *\()", r"\1_b", text)


_DECIDE = f"""{_DECIDED},
doubt AS (SELECT t_id, median_km + {S.unknown_km_extra} AS km FROM decided WHERE tier = 'guclu' AND t_km IS NULL AND {S.as_of.year} - t_year >= {S.unknown_km_min_age} AND median_km > 0),
target_b AS (SELECT e.* REPLACE (d.km AS km) FROM (SELECT DISTINCT ON (k) * FROM eff) e JOIN doubt d ON d.t_id = e.k),
{_again(_DECIDED.split("target AS (SELECT DISTINCT ON (k) * FROM eff),", 1)[1].replace("z > -2.0", "false")).strip()}"""


def _named(sql: str, *ids: str) -> str:
    """The query with the ids of the adverts in place of their numbers."""
    head, tail = sql.rsplit("\nSELECT ", 1) if "\nSELECT " in sql else (None, None)
    joins = " ".join(f"JOIN names n{i} ON n{i}.k = x.{c}" for i, c in enumerate(ids))
    return f"{head}\nSELECT x.* REPLACE ({', '.join(f'n{i}.id AS {c}' for i, c in enumerate(ids))}) FROM (SELECT {tail}) x {joins}"


QUERIES = {
    "DM_market_median": market_median,
    "DM01_find_market": find_market,
    "DM02_DM08_assessment": decisions,
    "SC04_DM37_evaluate_recent": evaluate_recent,
    "DM07_DM11_decide": decide,
    "DM13_clean_negotiable": clean_negotiable,
    "DM14_cheap_to_verify": cheap_to_verify,
    "DM16_ask_value": ask_value,
    "DM17_DM34_PR19_PR23_SF05_send_checks": send_checks,
    "AG36_backtest": tier_backtest,
    "WN14_nearest_comparables": nearest,
}
ORACLE_SQL = {
    "DM_market_median": f"""WITH {_PAIRS},
capped AS (SELECT * FROM pairs WHERE abs(year - t_year) <= 1 QUALIFY row_number() OVER (PARTITION BY t_id, seller ORDER BY closeness, id) <= 2)
SELECT t_id AS id, count(*) AS n, count(DISTINCT seller) AS sellers_n, round(median(price_gbp), 6) AS median, round(quantile_cont(price_gbp, 0.25), 6) AS p25
FROM capped GROUP BY t_id HAVING count(*) >= 3""",
    "DM01_find_market": f"""WITH {_MARKET}
SELECT t_id AS id, step, n, sellers_n, round(median, 6) AS median, round(p25, 6) AS p25, round(low, 6) AS low, round(high, 6) AS high,
  round(archived_share, 6) AS archived_share, round(median_year, 6) AS median_year, round(ln(t_price / median) / sigma, 6) AS z, median_km, near_n, merged FROM market""",
    "DM02_DM08_assessment": f"""WITH {_DECIDED}
SELECT t_id AS id, n, round(profit, 6) AS profit, round(pct, 6) AS profit_pct, confidence, raw_tier, tier, gaps,
  round(least((0.95 * median - 300) / 1.2, 0.95 * median - 1050), 6) AS ceiling FROM decided""",
    "SC04_DM37_evaluate_recent": f"""WITH {_DECIDED}
SELECT t_id AS id, n, round(profit, 6) AS profit, round(pct, 6) AS profit_pct, confidence, tier, gaps FROM decided
WHERE t_id IN (SELECT k FROM eff WHERE is_active AND datediff('day', first_seen_at::DATE, {_DATE}) BETWEEN 0 AND {S.recent_days})""",
    "AG36_backtest": f"""WITH {_DECIDED}
SELECT confidence, count(*) AS adverts, round(median(abs(t_price - median) / median), 6) AS median_error,
  count(*) FILTER (raw_tier = 'guclu') AS strong, count(*) FILTER (tier = 'pazarlik') AS negotiable FROM decided GROUP BY confidence""",
    "DM07_DM11_decide": f"""WITH {_DECIDE}
SELECT d.t_id AS id, CASE WHEN w.lower THEN 'pazarlik' ELSE tier END AS tier, CASE WHEN w.lower THEN 'km_temkinli' ELSE gaps END AS gaps, round(profit, 6) AS profit, round(z, 6) AS z
FROM decided d LEFT JOIN (SELECT t_id, NOT EXISTS (SELECT 1 FROM decided_b b WHERE b.t_id = u.t_id AND b.tier = 'guclu') AS lower FROM doubt u) w ON w.t_id = d.t_id""",
    "DM13_clean_negotiable": f"""WITH {_DECIDE.replace("pct >= 0.20 ", "pct >= 0.15 ").replace("profit < 750 ", "profit < 500 ")}
SELECT t_id AS id, n, round(profit, 6) AS profit, round(pct, 6) AS profit_pct, round(z, 6) AS z FROM decided d WHERE tier = 'guclu' AND n >= 8
AND NOT EXISTS (SELECT 1 FROM doubt u WHERE u.t_id = d.t_id AND NOT EXISTS (SELECT 1 FROM decided_b b WHERE b.t_id = u.t_id AND b.tier = 'guclu'))""",
    "DM14_cheap_to_verify": f"""WITH {_DECIDE},
loose AS (SELECT *, CASE WHEN c = 'guclu' AND t_price < 0.35::DOUBLE * median THEN 'pazarlik' ELSE c END AS l_tier FROM t3),
l_gap AS (SELECT * FROM loose WHERE l_tier = 'guclu' AND n >= 8 AND coalesce(t_currency <> 'TRY', true) AND coalesce(near_n >= 8, true) AND t_price <= p25
  AND NOT (median_year - t_year >= 1 OR (step >= 3 AND median_year - t_year > 0))),
firm AS (SELECT t_id FROM decided d WHERE tier = 'guclu' AND NOT EXISTS (SELECT 1 FROM doubt u WHERE u.t_id = d.t_id AND NOT EXISTS (SELECT 1 FROM decided_b b WHERE b.t_id = u.t_id AND b.tier = 'guclu')))
SELECT t_id AS id, n, round(profit, 6) AS profit, round(pct, 6) AS profit_pct, round(z, 6) AS z FROM l_gap WHERE t_id NOT IN (SELECT t_id FROM firm)""",
    "DM16_ask_value": f"""WITH {_MARKET}, a AS (SELECT *, floor(least((0.95 * median - 300) / 1.2, 0.95 * median - 1050) / 50) * 50 AS max_buy FROM market WHERE n >= 8)
SELECT t_id AS id, n, round(median, 6) AS median, max_buy::DOUBLE AS max_buy FROM a WHERE max_buy > 0""",
    "DM17_DM34_PR19_PR23_SF05_send_checks": f"""WITH {_DECIDED}
SELECT t_id AS id, CASE WHEN tier = 'guclu' THEN t_year % 2 = 0 AND n >= 8 ELSE true END AS sendable, t_price - floor(least((0.95 * median - 300) / 1.2, 0.95 * median - 1050) / 50) * 50 <= t_price * 0.10::DOUBLE AS shared,
  floor(greatest(-999.99::DOUBLE, least(999.99::DOUBLE, round(pct * 100, 2))))::BIGINT AS percent FROM decided""",
    "WN14_nearest_comparables": f"""WITH {_PAIRS},
d AS (SELECT p.t_id, p.id, closeness + 0.1 * abs(p.price_gbp - e.price_gbp) / e.price_gbp AS distance FROM pairs p JOIN target e ON e.k = p.t_id)
SELECT t_id AS id, row_number() OVER (PARTITION BY t_id ORDER BY distance, id)::INTEGER AS rank, id AS other_id, round(distance, 6) AS distance
FROM d QUALIFY rank <= 5""",
}
ORACLE_SQL = {n: q if n == "AG36_backtest" else _named(q, *(("id", "other_id") if n == "WN14_nearest_comparables" else ("id",))) for n, q in ORACLE_SQL.items()}
