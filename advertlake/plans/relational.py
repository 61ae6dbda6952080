"""Queries of the join, window, aggregate, sort and set shapes, over the events, orders and documents of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from advertlake.operators import relational as R
from advertlake.session import table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _us(c: str):
    return F.unix_micros(c).alias(f"{c}_us")


def latest(spark, d):
    e = R.latest_per_key(_events(spark, d), ["user_id", "event_type"], "ts", "event_id")
    return e.select("user_id", "event_type", "event_id", "value", _us("ts"))


def first(spark, d):
    e = R.first_per_key(_events(spark, d), ["user_id"], "ts", "event_id")
    return e.select("user_id", "event_type", "event_id", "value")


def asof(spark, d):
    e = _events(spark, d)
    views = e.filter("event_type = 'view'").select("user_id", "ts", "value")
    got = R.asof_join(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, "user_id", "ts", "ts", "value", 3600)
    return got.select("event_id", "user_id", "asof_value")


def interval_semi(spark, d):
    e = _events(spark, d)
    got = R.interval_semi(e.filter("event_type = 'click'"), e.filter("event_type = 'error'").select("user_id", "ts"), ["user_id"], "ts", 3600 * 6)
    return got.select("event_id", "user_id")


def mutual_pairs(spark, d):
    e = _events(spark, d).select(F.col("event_id").alias("id"), "user_id", "ts", "event_type")
    got = R.unique_pairs(e.filter("event_type = 'click'").drop("event_type"), e.filter("event_type = 'purchase'").drop("event_type"), ["user_id"], "ts", 3600 * 12)
    return got.select("id", "r_id")


def tolerance_join(spark, d):
    o = table(spark, d, "orders")
    a, b = o.alias("a"), o.alias("b")
    near = F.abs(F.datediff("a.o_orderdate", "b.o_orderdate")) <= 30
    price = F.abs(F.col("a.o_totalprice") - F.col("b.o_totalprice")) <= F.greatest(F.lit(500.0), 0.2 * F.col("a.o_totalprice"))
    got = a.join(b, (F.col("a.o_custkey") == F.col("b.o_custkey")) & (F.col("a.o_orderkey") < F.col("b.o_orderkey")) & near & price)
    return got.select(F.col("a.o_orderkey").alias("left_key"), F.col("b.o_orderkey").alias("right_key"))


def left_with_bound(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    got = c.join(o, (c["c_custkey"] == o["o_custkey"]) & (o["o_orderdate"] >= F.lit("2001-01-01").cast("timestamp")), "left")
    return got.groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"), F.max("o_totalprice").alias("top"))


def anti(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o.filter("o_totalprice > 400000"), c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey", "c_mktsegment")


def resurfaced(spark, d):
    """Events that show up after an event of a larger number of the same user: a running maximum instead of a non-equi join."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.unix_micros("ts")).rangeBetween(Window.unboundedPreceding, -1)
    e = _events(spark, d).withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("before", F.max("k").over(w))
    return e.filter("k < before").select("event_id", "k", "before")


def consensus(spark, d):
    e = _events(spark, d)
    kind = F.when(F.col("event_type") == "error", "wrong").when(F.col("event_type") == "purchase", "right").when(F.col("event_type") == "signup", "sold")
    kind = F.when((F.col("event_type") == "view") & (F.col("value") > 200), "audit_wrong").otherwise(kind)
    v = e.select((F.get_json_object("props", "$.k").cast("int")).alias("listing"), F.col("user_id").alias("voter"), kind.alias("action"), F.col("ts").alias("at"), F.col("event_id").alias("tie"))
    return R.vote_consensus(v)


def button_stats(spark, d):
    e = _events(spark, d)
    began = R.first_per_key(e.filter("event_type = 'view'"), ["user_id"], "ts", "event_id").select("user_id", F.col("ts").alias("began"))
    hours = (F.unix_micros("ts") - F.unix_micros("began")) / 3.6e9
    g = e.join(began, "user_id").withColumn("h", hours).groupBy((F.col("user_id") % 7).alias("bucket"))
    return g.agg(
        F.count_distinct(F.when(F.col("event_type") == "click", F.col("user_id"))).alias("clickers"),
        F.count_distinct(F.when(F.col("event_type") == "error", F.col("user_id"))).alias("failing"),
        F.round(F.median(F.when((F.col("event_type") == "purchase") & (F.col("h") >= 0), F.col("h"))), 6).alias("median_hours"),
    )


def source_volume(spark, d):
    day = F.datediff(F.lit("2024-01-30").cast("date"), F.col("ts"))
    g = _events(spark, d).groupBy("event_type")
    return g.agg(F.round(F.count_if((day >= 1) & (day < 8)) / 7, 6).alias("per_day"), F.count_if(day < 1).alias("today"), F.max(F.unix_micros("ts")).alias("last_us"))


def failing_sources(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    last = _events(spark, d).withColumn("rn", F.row_number().over(w)).filter("rn <= 10")
    return last.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("bad"), F.count("*").alias("n")).filter("bad >= 3")


def twin_keys(spark, d):
    from pyspark.sql import Window

    doc = table(spark, d, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("fp"))
    return doc.withColumn("twins", F.count("*").over(Window.partitionBy("fp"))).filter("twins > 1").select("doc_id", "fp", "twins")


def sample(spark, d):
    got = R.stratified_sample(_events(spark, d), "event_type", 5, F.md5(F.concat(F.lit("s:"), F.col("event_id").cast("string"))))
    return got.select("event_type", "event_id", "rn")


def best_tier(spark, d):
    order = F.array(*[F.lit(x) for x in ("purchase", "signup", "click", "view", "error")])
    return _events(spark, d).groupBy("user_id").agg(F.min_by("event_type", F.array_position(order, F.col("event_type"))).alias("best"))


def search(spark, d):
    o = table(spark, d, "orders").filter("o_totalprice between 100000 and 200000 and o_orderpriority in ('1-URGENT', '2-HIGH')")
    total = o.agg(F.count("*").alias("total"))
    top = o.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20)
    return top.join(F.broadcast(total)).select("o_orderkey", "o_totalprice", "total")


def ranked(spark, d):
    o = table(spark, d, "orders")
    rank = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    return o.orderBy(rank, F.desc_nulls_first("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_orderstatus", "o_totalprice")


def union_distinct(spark, d):
    a = table(spark, d, "orders").filter("o_totalprice > 480000").select(F.col("o_custkey").alias("k"))
    return a.union(table(spark, d, "customer").filter("c_acctbal < -900").select(F.col("c_custkey").alias("k"))).distinct()


def difference(spark, d):
    e = _events(spark, d)
    half = F.lit("2024-01-15").cast("timestamp")
    return R.snapshot_diff(e.filter(F.col("ts") < half), e.filter((F.col("ts") >= half) & (F.col("event_type") == "purchase")), "user_id")


def streaks(spark, d):
    got = R.islands(_events(spark, d), "user_id", "ts", 3600 * 8)
    return got.select("user_id", "streak", "rows", F.unix_micros("began").alias("began_us"), F.unix_micros("ended").alias("ended_us"))


def upsert(spark, d):
    e = _events(spark, d).select("user_id", "event_type", "ts", "event_id", "value")
    half = F.lit("2024-01-15").cast("timestamp")
    got = R.upsert(e.filter(F.col("ts") < half), e.filter(F.col("ts") >= half), ["user_id", "event_type"], "ts", "event_id")
    return got.select("user_id", "event_type", "event_id", "value")


def price_changes(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _events(spark, d).filter("event_type = 'purchase'").withColumn("old", F.lag("value").over(w))
    return e.filter(F.abs(F.col("value") - F.col("old")) > 0.01 * F.col("old")).select("event_id", "user_id", "old", "value")


def retention(spark, d):
    age = F.datediff(F.lit("2024-01-31").cast("date"), F.col("ts"))
    return _events(spark, d).select("event_id", F.when(age <= 10, F.col("props")).alias("props"), F.when(age <= 20, F.col("value")).alias("value"))


def history_alerts(spark, d):
    from pyspark.sql import Window

    day = _events(spark, d).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("event_type").orderBy("day").rowsBetween(-5, -1)
    got = day.withColumns({"mean": F.avg("n").over(w), "seen": F.count("n").over(w)}).filter("seen = 5 and n < 0.9 * mean")
    return got.select("event_type", F.col("day").cast("string").alias("day"), "n", F.round("mean", 6).alias("mean"))


QUERIES = {
    "WN06_JN04_latest_per_key": latest, "WN09_JN08_first_per_key": first, "JN09_asof_join": asof, "JN12_interval_semi_join": interval_semi,
    "JN25_mutual_unique_pairs": mutual_pairs, "JN13_tolerance_join": tolerance_join, "JN03_left_join_with_bound": left_with_bound, "JN17_anti_join": anti,
    "JN14_resurfaced": resurfaced, "AG01_vote_consensus": consensus, "AG16_button_stats": button_stats, "AG12_source_volume": source_volume,
    "AG13_WN05_failing_sources": failing_sources, "WN01_twin_keys": twin_keys, "WN04_SL10_stratified_sample": sample, "WN10_best_tier": best_tier,
    "SC09_WN02_search": search, "SL01_SL02_ranked": ranked, "ST01_union_distinct": union_distinct, "ST05_SM11_snapshot_diff": difference,
    "SM27_streaks": streaks, "SM02_upsert": upsert, "SM10_price_changes": price_changes, "SM14_retention": retention, "SM24_history_alerts": history_alerts,
}
_K = "(props->>'$.k')::INTEGER"
ORACLE_SQL = {
    "WN06_JN04_latest_per_key": "SELECT user_id, event_type, event_id, value, epoch_us(ts) AS ts_us FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "WN09_JN08_first_per_key": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1",
    "JN09_asof_join": """SELECT p.event_id, p.user_id, v.value AS asof_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts + INTERVAL 1 HOUR >= v.ts""",
    "JN12_interval_semi_join": """SELECT event_id, user_id FROM events c WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'error'
AND e.user_id = c.user_id AND abs(epoch_us(e.ts) - epoch_us(c.ts)) <= 21600000000)""",
    "JN25_mutual_unique_pairs": """WITH p AS (SELECT c.event_id AS id, e.event_id AS r_id FROM events c JOIN events e ON c.event_type = 'click' AND e.event_type = 'purchase'
AND e.user_id = c.user_id AND abs(epoch_us(e.ts) - epoch_us(c.ts)) <= 43200000000) SELECT id, r_id FROM p QUALIFY count(*) OVER (PARTITION BY id) = 1 AND count(*) OVER (PARTITION BY r_id) = 1""",
    "JN13_tolerance_join": """SELECT a.o_orderkey AS left_key, b.o_orderkey AS right_key FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
AND abs(datediff('day', a.o_orderdate, b.o_orderdate)) <= 30 AND abs(a.o_totalprice - b.o_totalprice) <= greatest(500.0, 0.2::DOUBLE * a.o_totalprice)""",
    "JN03_left_join_with_bound": "SELECT c_custkey, count(o_orderkey) AS orders, max(o_totalprice) AS top FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderdate >= TIMESTAMP '2001-01-01' GROUP BY 1",
    "JN17_anti_join": "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    "JN14_resurfaced": f"""SELECT event_id, k, before FROM (SELECT event_id, {_K} AS k, max({_K}) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
FROM events) WHERE k < before""",
    "AG01_vote_consensus": f"""WITH v AS (SELECT {_K} AS listing, user_id AS voter, ts, event_id, CASE WHEN event_type = 'view' AND value > 200 THEN 'audit_wrong' WHEN event_type = 'error' THEN 'wrong'
WHEN event_type = 'purchase' THEN 'right' WHEN event_type = 'signup' THEN 'sold' END AS action FROM events),
l AS (SELECT * FROM v WHERE action IN ('wrong', 'right', 'sold') QUALIFY row_number() OVER (PARTITION BY listing, voter ORDER BY ts DESC, event_id DESC) = 1)
SELECT listing FROM l GROUP BY 1 HAVING count(*) FILTER (action = 'wrong') >= 2 AND count(*) FILTER (action = 'wrong') > count(*) FILTER (action = 'right')
UNION SELECT listing FROM v WHERE action = 'audit_wrong'""",
    "AG16_button_stats": """WITH b AS (SELECT user_id, min(ts) AS began FROM events WHERE event_type = 'view' GROUP BY 1),
e AS (SELECT e.*, (epoch_us(ts) - epoch_us(began)) / 3.6e9::DOUBLE AS h FROM events e JOIN b USING (user_id))
SELECT user_id % 7 AS bucket, count(DISTINCT user_id) FILTER (event_type = 'click') AS clickers, count(DISTINCT user_id) FILTER (event_type = 'error') AS failing,
round(median(h) FILTER (event_type = 'purchase' AND h >= 0), 6) AS median_hours FROM e GROUP BY 1""",
    "AG12_source_volume": """WITH e AS (SELECT *, datediff('day', ts::DATE, DATE '2024-01-30') AS day FROM events)
SELECT event_type, round(count(*) FILTER (day >= 1 AND day < 8) / 7.0::DOUBLE, 6) AS per_day, count(*) FILTER (day < 1) AS today, max(epoch_us(ts)) AS last_us FROM e GROUP BY 1""",
    "AG13_WN05_failing_sources": """WITH l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10)
SELECT user_id, count(*) FILTER (event_type = 'error') AS bad, count(*) AS n FROM l GROUP BY 1 HAVING bad >= 3""",
    "WN01_twin_keys": "SELECT doc_id, md5(coalesce(text, '')) AS fp, count(*) OVER (PARTITION BY md5(coalesce(text, ''))) AS twins FROM documents QUALIFY twins > 1",
    "WN04_SL10_stratified_sample": "SELECT event_type, event_id, (row_number() OVER (PARTITION BY event_type ORDER BY md5('s:' || event_id::VARCHAR), event_id))::INTEGER AS rn FROM events QUALIFY rn <= 5",
    "WN10_best_tier": "SELECT user_id, arg_min(event_type, list_position(['purchase', 'signup', 'click', 'view', 'error'], event_type)) AS best FROM events GROUP BY 1",
    "SC09_WN02_search": """SELECT o_orderkey, o_totalprice, count(*) OVER () AS total FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')
ORDER BY o_orderdate DESC, o_orderkey LIMIT 20""",
    "SL01_SL02_ranked": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 25",
    "ST01_union_distinct": "SELECT o_custkey AS k FROM orders WHERE o_totalprice > 480000 UNION SELECT c_custkey FROM customer WHERE c_acctbal < -900",
    "ST05_SM11_snapshot_diff": """WITH a AS (SELECT DISTINCT user_id FROM events WHERE ts < TIMESTAMP '2024-01-15'), b AS (SELECT DISTINCT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND event_type = 'purchase')
SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN b.user_id IS NULL THEN 'gone' WHEN a.user_id IS NULL THEN 'new' ELSE 'kept' END AS change FROM a FULL JOIN b ON a.user_id = b.user_id""",
    "SM27_streaks": """WITH n AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 28800000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS streak FROM n)
SELECT user_id, streak, count(*) AS rows, min(epoch_us(ts)) AS began_us, max(epoch_us(ts)) AS ended_us FROM s GROUP BY 1, 2""",
    "SM02_upsert": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "SM10_price_changes": """SELECT event_id, user_id, old, value FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM events WHERE event_type = 'purchase')
WHERE abs(value - old) > 0.01::DOUBLE * old""",
    "SM14_retention": """SELECT event_id, CASE WHEN datediff('day', ts::DATE, DATE '2024-01-31') <= 10 THEN props END AS props,
CASE WHEN datediff('day', ts::DATE, DATE '2024-01-31') <= 20 THEN value END AS value FROM events""",
    "SM24_history_alerts": """WITH d AS (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2),
m AS (SELECT *, avg(n) OVER w AS mean, count(n) OVER w AS seen FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT event_type, day::VARCHAR AS day, n, round(mean, 6) AS mean FROM m WHERE seen = 5 AND n < 0.9 * mean""",
}
