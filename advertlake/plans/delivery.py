"""Queries of the work-lists, deliveries, summaries and state changes. Events stand for evaluations (view), alerts (purchase), votes (click) and history (error)."""

from __future__ import annotations

from pyspark.sql import functions as F

from advertlake.functions import rules
from advertlake.functions import text as X
from advertlake.operators import delivery as D
from advertlake.operators import relational as R
from advertlake.session import table
from advertlake.settings import ANALOGUE as S
from advertlake.sources.listings import LISTINGS_SQL, listings
from advertlake.sources.shared import new_path


def _events(spark, d, kind=None):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e if kind is None else e.filter(F.col("event_type") == kind)


def market_pool(spark, d):
    """Priced rows of the window that no vote calls wrong and whose seller is no shadow source."""
    age = F.datediff(F.lit(S.as_of), "first_seen_at")
    wrong = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").select(F.col("o_orderkey").alias("order_id"))
    shadow = table(spark, d, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("seller"))
    x = listings(spark, d).filter(F.col("price_gbp").isNotNull() & F.col("brand_norm").isNotNull() & (age <= S.window_days))
    return x.join(wrong, "order_id", "left_anti").join(shadow, "seller", "left_anti").groupBy("brand_norm").agg(F.count("*").alias("n"), F.count_distinct("seller").alias("sellers"))


def work_list(spark, d):
    e = _events(spark, d)
    items = e.select(F.col("user_id").alias("item")).distinct()
    done = e.filter("event_type = 'view'").select(F.col("user_id").alias("item"), F.col("ts").alias("at"), F.col("event_id").alias("tie"), F.when(F.col("value") > 5, F.floor(F.col("value") / 40)).alias("version"))
    moved = e.filter("event_type = 'error'").select(F.col("user_id").alias("item"), F.col("ts").alias("at"))
    return D.never_or_changed(items, done, moved, F.lit(1))


def pending(spark, d):
    """Users whose last view is worth something and that not all days of the week have served."""
    last = R.latest_per_key(_events(spark, d, "view").select(F.col("user_id").alias("item"), "ts", "event_id", "value"), ["item"], "ts", "event_id").filter("value > 20")
    alerts = _events(spark, d, "purchase").select(F.col("user_id").alias("item"), F.dayofweek("ts").alias("recipient"))
    recipients = _events(spark, d).select(F.dayofweek("ts").alias("recipient")).distinct()
    return D.pending(last.select("item", "value"), alerts, recipients)


def gate(spark, d):
    x = listings(spark, d)
    gates = {"aktif": F.col("is_active"), "fiyat": F.col("price_gbp").between(S.min_price, S.max_price), "km": rules.effective_km(F.col("km"), F.col("year"), S.as_of).isNotNull(),
             "tl": F.col("currency") != "TRY", "yon": F.coalesce("steering", F.lit("RHD")) == "RHD"}
    return x.groupBy(F.coalesce(D.first_failing(gates), F.lit("gecti")).alias("reason")).agg(F.count("*").alias("n"))


def insert_ignore(spark, d):
    a = _events(spark, d, "purchase").select("user_id", F.dayofyear("ts").alias("day"))
    b = _events(spark, d, "click").select("user_id", F.dayofyear("ts").alias("day"))
    return D.insert_ignore(a.distinct(), b, ["user_id", "day"])


def orphans(spark, d):
    """Orders of which one in three points to another order, which may be a copy or missing."""
    k = F.col("o_orderkey")
    return D.release_orphans(table(spark, d, "orders").select(k.alias("id"), F.when(F.col("o_orderstatus") == "O", F.floor(k / 2)).when(F.col("o_orderstatus") == "P", k + 1).alias("duplicate_of"))).filter("duplicate_of is not null")


def standing(spark, d):
    """Suppliers' saved filters: one of four has no brand of its own."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    f = s.select(k.alias("filter_id"), F.when(k % 4 != 0, F.concat(F.lit("Brand#"), (k % 5 + 1).cast("string"), (k % 5 + 1).cast("string"))).alias("brand_norm"), (F.col("s_acctbal") / 2).alias("price_max"), (1990 + k % 10).alias("year_min"))
    rows = listings(spark, d).filter("is_active").select("id", "brand_norm", "price_gbp", "year")
    return D.standing_counts(rows, f).select("filter_id", "hits", F.round("cheapest", 4).alias("cheapest"))


def undo(spark, d):
    now = R.latest_per_key(_events(spark, d).select(F.col("user_id").alias("item"), "ts", "event_id", "value"), ["item"], "ts", "event_id").select("item", "value")
    h = _events(spark, d, "error").select(F.col("user_id").alias("item"), F.col("value").alias("old"), F.col("ts").alias("at"), F.col("event_id").alias("tie"))
    return D.undo_changes(now, h, F.lit("2024-01-10").cast("timestamp"))


def downgrade(spark, d):
    """The last view of each user again, as an appended row one microsecond later with a reason more."""
    last = R.latest_per_key(_events(spark, d, "view").select("user_id", "event_id", "ts", "value"), ["user_id"], "ts", "event_id")
    reasons = F.when(F.col("value") > 30, F.array(F.lit("masraf")))
    return last.select("user_id", "event_id", (F.unix_micros(F.col("ts") + F.expr("interval 1 microsecond"))).alias("at_us"),
                       F.array_join(F.array_union(F.coalesce(reasons, F.array().cast("array<string>")), F.array(F.lit("uyari"))), ",").alias("reasons"))


def summary(spark, d):
    """One row of counts, shares and medians over the adverts."""
    sold = F.when(F.col("is_sold"), F.col("price_gbp"))
    return listings(spark, d).agg(
        F.count("*").alias("n"), F.count_if("is_active").alias("active"), F.count_if(F.col("currency") == "TRY").alias("tl"), F.count_distinct("brand_norm").alias("brands"),
        F.round(F.avg(F.col("is_sold").cast("double")), 6).alias("sold_share"), F.round(F.median(sold), 4).alias("sold_median"), F.unix_micros(F.max("first_seen_at").cast("timestamp")).alias("newest_us"))


def votes(spark, d):
    """Users with enough failing days, whether they ever bought, and their last event."""
    return _events(spark, d).groupBy("user_id").agg(
        F.count_distinct(F.when(F.col("event_type") == "error", F.to_date("ts"))).alias("bad_days"), F.bool_or(F.col("event_type") == "purchase").alias("bought"), F.max("event_id").alias("last_id")).filter("bad_days >= 2")


def vanished(spark, d):
    """Closed adverts per reason, and how many of them had been alerted."""
    sig = F.array_compact(F.array(F.when(F.col("is_sold"), "satildi"), F.when(F.col("price_gbp") > 60000, "kaldirildi")))
    alerted = table(spark, d, "orders").filter("o_orderpriority = '2-HIGH'").select(F.col("o_orderkey").alias("order_id"), F.lit(True).alias("hit"))
    x = listings(spark, d).filter("not is_active").withColumn("reason", rules.inactive_reason(sig)).join(alerted, "order_id", "left")
    return x.groupBy("reason").agg(F.count("*").alias("n"), F.count_if("hit").alias("alerted"))


def scalars(spark, d):
    """Scalar functions of the engine on one row each."""
    at = F.col("ts")
    return _events(spark, d).select(
        "event_id", F.hour(F.from_utc_timestamp(at, "Asia/Famagusta")).alias("local_hour"), F.to_json(F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("user_id").alias("u"))).alias("merged"),
        F.coalesce(F.regexp_extract(F.concat(F.col("event_id").cast("string"), F.lit("x9")), "^[0-9]{1,15}", 0).try_cast("bigint"), F.lit(0)).alias("digits"),
        F.array_position(F.array(*[F.lit(k) for k in ("purchase", "click", "view")]), F.col("event_type")).alias("place"), F.floor(F.col("value") / 50).cast("long").alias("step50"),
        F.round(rules.km_adjusted(F.col("value") * 100, F.lit(60000.0), F.col("value") * 1000, S.km_adjust_per_10k), 6).alias("adjusted"),
        F.round((F.unix_micros(at) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 3.6e9, 6).alias("hours"), F.bround(F.floor("value") / 2, 0).alias("even"))


def export(spark, d):
    """Tables as CSV with header, then a manifest of their rows written last; the manifest gives the files' own row counts."""
    path, names = new_path(spark, "backup"), ["region", "nation", "supplier"]
    for n in names:
        table(spark, d, n).write.option("header", True).csv(f"{path}/{n}")
    counts = [spark.read.option("header", True).csv(f"{path}/{n}").agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in names]
    counts[0].union(counts[1]).union(counts[2]).coalesce(1).write.json(f"{path}/manifest")
    return spark.read.schema("name string, n long").json(f"{path}/manifest")


def canonical_words(spark, d):
    """Fuel, gear and phone spellings made from the events."""
    e = _events(spark, d)
    raw = F.element_at(F.array(*[F.lit(w) for w in (" Elektrik", "Mazot", "hybrid", "LPG", "düz ", "Otomotik", "CVT")]), (F.col("event_id") % 7 + 1).cast("int"))
    phone = F.concat(F.element_at(F.array(*[F.lit(w) for w in ("+90 ", "0", "", "44 ")]), (F.col("user_id") % 4 + 1).cast("int")), F.lit("533 "), F.lpad((F.col("event_id") % 10_000_000).cast("string"), 7, "0"))
    return e.select("event_id", X.canon(raw, X.FUELS).alias("fuel"), X.canon(raw, X.GEARS).alias("gear"), X.normalize_phone(phone).alias("phone"))


QUERIES = {
    "SC03_JN18_JN19_market_pool": market_pool, "SC04_JN15_AG04_work_list": work_list, "SL12_JN20_pending": pending, "DM42_gate_reason": gate, "SM04_DL25_insert_ignore": insert_ignore,
    "JN23_SM15_release_orphans": orphans, "SM31_standing_queries": standing, "SM19_WN08_undo": undo, "SM17_SF10_downgrade": downgrade, "AG02_AG18_AG20_summary": summary,
    "AG10_AG11_votes": votes, "AG17_PR24_vanished": vanished, "SF_scalars": scalars, "SC45_SC47_export": export, "TX02_TX03_TX23_canonical": canonical_words,
}
_LAST = "SELECT user_id, max_by(value, (ts, event_id)) AS value, max_by(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events WHERE event_type = 'view' GROUP BY 1"
_RAW = "[' Elektrik', 'Mazot', 'hybrid', 'LPG', 'düz ', 'Otomotik', 'CVT'][event_id % 7 + 1]"
_DIGITS = "regexp_replace(['+90 ', '0', '', '44 '][user_id % 4 + 1] || '533 ' || lpad((event_id % 10000000)::VARCHAR, 7, '0'), '[^0-9]', '', 'g')"
ORACLE_SQL = {
    "SC03_JN18_JN19_market_pool": f"""WITH {LISTINGS_SQL} SELECT brand_norm, count(*) AS n, count(DISTINCT seller) AS sellers FROM listings WHERE price_gbp IS NOT NULL AND brand_norm IS NOT NULL
AND datediff('day', first_seen_at::DATE, DATE '{S.as_of}') <= {S.window_days} AND order_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')
AND seller NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY 1""",
    "SC04_JN15_AG04_work_list": f"""WITH i AS (SELECT DISTINCT user_id FROM events), v AS (SELECT user_id, ts, CASE WHEN value > 5 THEN floor(value / 40) END AS version FROM ({_LAST})),
m AS (SELECT user_id, max(ts) AS moved FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT * FROM (SELECT user_id AS item, CASE WHEN ts IS NULL THEN 'new' WHEN moved > ts THEN 'changed' WHEN version IS DISTINCT FROM 1 THEN 'rules' END AS why
FROM i LEFT JOIN v USING (user_id) LEFT JOIN m USING (user_id)) WHERE why IS NOT NULL""",
    "SL12_JN20_pending": f"""SELECT * FROM (SELECT user_id AS item, value, (SELECT count(DISTINCT dayofweek(ts)) FROM events) -
(SELECT count(DISTINCT dayofweek(ts)) FROM events a WHERE a.event_type = 'purchase' AND a.user_id = l.user_id) AS missing FROM ({_LAST}) l WHERE value > 20) WHERE missing > 0""",
    "DM42_gate_reason": f"""WITH {LISTINGS_SQL} SELECT CASE WHEN NOT is_active THEN 'aktif' WHEN price_gbp NOT BETWEEN 500 AND 250000 THEN 'fiyat'
WHEN km IS NULL OR km IN (123456, 1234567, 654321, 12345678) OR (km < 1000 AND 1998 - year >= 2) OR (km < 15000 AND 1998 - year >= 10) OR regexp_matches(km::VARCHAR, '^(1{{6,7}}|2{{6,7}}|3{{6,7}}|4{{6,7}}|5{{6,7}}|6{{6,7}}|7{{6,7}}|8{{6,7}}|9{{6,7}})$') THEN 'km'
WHEN currency = 'TRY' THEN 'tl' WHEN coalesce(steering, 'RHD') <> 'RHD' THEN 'yon' ELSE 'gecti' END AS reason, count(*) AS n FROM listings GROUP BY 1""",
    "SM04_DL25_insert_ignore": """SELECT user_id, dayofyear(ts)::INTEGER AS day FROM events WHERE event_type = 'click' EXCEPT SELECT user_id, dayofyear(ts)::INTEGER FROM events WHERE event_type = 'purchase'""",
    "JN23_SM15_release_orphans": """WITH r AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN o_orderkey // 2 WHEN 'P' THEN o_orderkey + 1 END AS of FROM orders)
SELECT r.id, coalesce(h.of, r.of) AS duplicate_of FROM r JOIN r h ON r.of = h.id WHERE coalesce(h.of, r.of) <> r.id""",
    "SM31_standing_queries": f"""WITH {LISTINGS_SQL}, f AS (SELECT s_suppkey AS filter_id, CASE WHEN s_suppkey % 4 <> 0 THEN concat('Brand#', s_suppkey % 5 + 1, s_suppkey % 5 + 1) END AS brand, s_acctbal / 2 AS price_max, 1990 + s_suppkey % 10 AS year_min FROM supplier)
SELECT filter_id, count(*) AS hits, round(min(price_gbp), 4) AS cheapest FROM listings JOIN f ON (brand IS NULL OR brand = brand_norm) AND price_gbp <= price_max AND year >= year_min WHERE is_active GROUP BY 1""",
    "SM19_WN08_undo": """WITH n AS (SELECT user_id AS item, max_by(value, (ts, event_id)) AS value FROM events GROUP BY 1),
h AS (SELECT user_id AS item, min_by(value, (ts, event_id)) AS was FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-10' GROUP BY 1) SELECT item, coalesce(was, value) AS value FROM n LEFT JOIN h USING (item)""",
    "SM17_SF10_downgrade": f"SELECT user_id, event_id, epoch_us(ts) + 1 AS at_us, CASE WHEN value > 30 THEN 'masraf,uyari' ELSE 'uyari' END AS reasons FROM ({_LAST})",
    "AG02_AG18_AG20_summary": f"""WITH {LISTINGS_SQL} SELECT count(*) AS n, count(*) FILTER (is_active) AS active, count(*) FILTER (currency = 'TRY') AS tl, count(DISTINCT brand_norm) AS brands,
round(avg(is_sold::INTEGER), 6) AS sold_share, round(median(price_gbp) FILTER (is_sold), 4) AS sold_median, epoch_us(max(first_seen_at)) AS newest_us FROM listings""",
    "AG10_AG11_votes": """SELECT user_id, count(DISTINCT ts::DATE) FILTER (event_type = 'error') AS bad_days, bool_or(event_type = 'purchase') AS bought, max(event_id) AS last_id FROM events GROUP BY 1 HAVING bad_days >= 2""",
    "AG17_PR24_vanished": f"""WITH {LISTINGS_SQL} SELECT CASE WHEN is_sold THEN 'satildi' WHEN price_gbp > 60000 THEN 'kaldirildi' ELSE 'belirsiz' END AS reason, count(*) AS n,
count(*) FILTER (order_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH')) AS alerted FROM listings WHERE NOT is_active GROUP BY 1""",
    "SF_scalars": f"""SELECT event_id, hour(ts + INTERVAL 2 HOUR)::INTEGER AS local_hour, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN '{{"u":' || user_id || '}}' ELSE '{{"k":' || json_extract_string(props, '$.k') || ',"u":' || user_id || '}}' END AS merged, event_id AS digits,
coalesce(list_position(['purchase', 'click', 'view'], event_type), 0) AS place, floor(value / 50)::BIGINT AS step50,
round(value * 100 * exp(-{S.km_adjust_per_10k}::DOUBLE * (60000.0::DOUBLE - value * 1000) / 10000), 6) AS adjusted, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9::DOUBLE, 6) AS hours, round_even(floor(value) / 2, 0) AS even FROM events""",
    "SC45_SC47_export": "SELECT 'region' AS name, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier",
    "TX02_TX03_TX23_canonical": f"""WITH w AS (SELECT event_id, lower(trim({_RAW})) AS w, {_DIGITS} AS p FROM events)
SELECT event_id, CASE w WHEN 'elektrik' THEN 'elektrikli' WHEN 'mazot' THEN 'dizel' WHEN 'hybrid' THEN 'hibrit' ELSE w END AS fuel, CASE w WHEN 'düz' THEN 'manuel' WHEN 'otomotik' THEN 'otomatik' ELSE w END AS gear,
CASE WHEN length(p) = 12 AND starts_with(p, '90') THEN p WHEN length(p) = 11 AND starts_with(p, '0') THEN '9' || p WHEN length(p) = 10 AND starts_with(p, '5') THEN '90' || p END AS phone FROM w""",
}
