"""Queries that run as streams until their source is read, with the SQL of what they leave."""

from __future__ import annotations

from pyspark.sql import functions as F

from advertlake.session import table
from advertlake.sources.shared import new_path
from advertlake.streaming import ingest, tail, watch


def _stream(spark, d):
    """The events as a stream; a pattern, as a stream takes a path without one for a folder."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _lines(spark, d) -> str:
    """The events as hand-off lines: every kind of reject occurs."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    late = F.when(F.col("event_type") == "click", F.col("ts") + F.expr("interval 1 hour")).when(F.col("event_type") != "error", F.col("ts"))
    doc = F.to_json(F.struct(
        F.when(F.col("value") < 10, 2).otherwise(1).alias("surum"), F.when(F.col("event_type") == "signup", "other").otherwise("facebook").alias("platform"),
        F.concat(F.when(F.col("user_id") == 7, "x:").otherwise("fb:"), F.col("user_id").cast("string")).alias("anahtar"), F.col("event_id").cast("string").alias("gonderi"), F.col("props").alias("metin"),
        F.date_format(late, "yyyy-MM-dd'T'HH:mm:ss").alias("paylasim_utc"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("goruldu_utc"), (F.col("user_id") % 5).cast("int").alias("satici_gonderi_14g")))
    path = new_path(spark, "lines")
    e.select(F.when(F.col("value") > 200, "{broken").otherwise(doc).alias("value")).write.text(path)
    return path


def rejects(spark, d):
    return ingest.parse_lines(spark.read.text(_lines(spark, d))).groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("lines"))


def posts(spark, d):
    """The lines go through the ingest twice; the second pass adds nothing."""
    lines, out = _lines(spark, d), new_path(spark, "posts")
    for _ in range(2):
        ingest.ingest(spark, lines, out, new_path(spark, "chk"), 2)
    return spark.read.parquet(out).select("source_key", F.col("post_id").cast("long").alias("post_id"), F.unix_seconds("posted_at").alias("posted_s"), "dated", "seller_kind")


def failures(spark, d):
    e = _stream(spark, d).select(F.col("user_id").alias("key"), (F.col("event_type") == "view").alias("ok"), F.col("ts").alias("at"), F.col("event_id").alias("tie"))
    out = new_path(spark, "failures")
    watch.track_failures(e, out, new_path(spark, "chk"))
    last = spark.read.parquet(f"{out}/*").withColumn("version", F.element_at(F.split(F.input_file_name(), "/"), -2).cast("long"))
    got = last.groupBy("key").agg(F.max_by("failures", "version").alias("failures"))
    return got.select(F.col("key").alias("user_id"), "failures", (F.col("failures") >= watch.FAIL_LIMIT).alias("alarm"))


def brakes(spark, d):
    e = _stream(spark, d).filter("event_type in ('error', 'signup')").select(F.col("user_id").alias("key"), "event_id", F.unix_micros("ts").alias("at_us"), (F.col("event_type") == "error").alias("soft"))
    out = new_path(spark, "brakes")
    watch.to_table(watch.brake(e), out, new_path(spark, "chk"))
    return spark.read.schema(watch._BRAKE).parquet(out).select("event_id", "severity", "pause_until_us")


def daily(spark, d):
    """Events per local day and type, of the days that the watermark has closed."""
    out = new_path(spark, "daily")
    watch.to_table(watch.daily_counts(_stream(spark, d), "ts", "event_type", "Asia/Famagusta"), out, new_path(spark, "chk"))
    return spark.read.schema("day date, event_type string, rows long").parquet(out).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "rows")


TAIL_LANES = 6


def tailed(spark, d):
    """The events as lines of a folder that tails side by side read in batches of 200 kB."""
    path, out, chk = (new_path(spark, kind) for kind in ("lines", "tail", "chk"))
    e = table(spark, d, "events").select(F.to_json(F.struct("event_id", "event_type", "user_id")).alias("value"))
    e.repartition(3).write.text(path)
    queries = tail.to_lanes(spark, path, out, chk, TAIL_LANES, 200_000)
    try:
        for query in queries:
            query.processAllAvailable()
    finally:
        for query in queries:
            query.stop()
    got = spark.read.schema(f"{tail.SCHEMA}, lane int, batch int").parquet(out).select(F.from_json("value", "event_id long, event_type string, user_id long").alias("v"))
    return got.select("v.event_id", "v.event_type", "v.user_id")


_SCANS = {"first": ("", 0, "2024-01-08 00:00:00"), "middle": ("facebook-20240105.jsonl", 2000, "2024-01-10 00:00:00"), "uncovered": ("facebook-20240105.jsonl", 0, "2024-01-01 12:00:00"), "no_window": ("z", 0, None)}


def handoff(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    lines = e.select(F.concat(F.lit("facebook-"), F.date_format("ts", "yyyyMMdd"), F.lit(".jsonl")).alias("file"), F.col("event_id").alias("at"), F.when(F.col("event_type") != "error", F.col("ts")).alias("seen"))
    now, out = F.lit("2024-01-20 00:00:00").cast("timestamp"), None
    for name, (file, at, end) in _SCANS.items():
        one = tail.handoff_scan(lines, (file, at), None if end is None else F.lit(end).cast("timestamp"), now).select(F.lit(name).alias("scan"), "in_window", "pending")
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {"SC20_tail": tailed, "SC22_handoff_scan": handoff, "SM23_daily_counts": daily, "SC21_reject_reasons": rejects, "SM01_SM02_ingest": posts, "SM21_failure_counter": failures, "SM29_brake": brakes}
_REASON = """CASE WHEN value > 200 THEN 'bozuk_satir' WHEN value < 10 THEN 'surum' WHEN event_type = 'signup' THEN 'platform' WHEN user_id = 7 OR props IS NULL THEN 'alan' END"""
ORACLE_SQL = {
    "SC20_tail": "SELECT event_id, event_type, user_id FROM events",
    "SC22_handoff_scan": " UNION ALL ".join(f"""SELECT '{n}' AS scan, CASE WHEN count(*) FILTER (seen <= e - INTERVAL 24 HOUR) > 0 THEN count(*) FILTER (seen > e - INTERVAL 24 HOUR AND seen <= e) END AS in_window,
  count(*) FILTER ((file > '{f}' OR (file = '{f}' AND place >= {a})) AND TIMESTAMP '2024-01-20' - seen > INTERVAL 1 HOUR) AS pending
FROM (SELECT 'facebook-' || strftime(ts, '%Y%m%d') || '.jsonl' AS file, event_id AS place, ts AS seen, {'NULL' if w is None else f"'{w}'"}::TIMESTAMP AS e FROM events WHERE event_type <> 'error')""" for n, (f, a, w) in _SCANS.items()),
    "SM23_daily_counts": """WITH e AS (SELECT event_type, timezone('Asia/Famagusta', timezone('UTC', ts))::DATE AS day FROM events)
SELECT strftime(day, '%Y-%m-%d') AS day, event_type, count(*) AS rows FROM e WHERE day <= (SELECT max(day) FROM e) - 2 GROUP BY ALL""",
    "SC21_reject_reasons": f"SELECT coalesce({_REASON}, 'ok') AS reason, count(*) AS lines FROM events GROUP BY 1",
    "SM01_SM02_ingest": f"""SELECT user_id::VARCHAR AS source_key, event_id AS post_id, floor(epoch_us(ts) / 1000000)::BIGINT AS posted_s, event_type NOT IN ('error', 'click') AS dated,
CASE WHEN user_id % 5 >= 3 THEN 'galeri' WHEN user_id % 5 >= 1 THEN 'sahibinden' END AS seller_kind FROM events WHERE {_REASON} IS NULL""",
    "SM21_failure_counter": """WITH l AS (SELECT user_id, max((ts, event_id)) FILTER (event_type = 'view') AS k FROM events GROUP BY 1)
SELECT user_id, count(*) FILTER (k IS NULL OR (ts, event_id) > k) AS failures, count(*) FILTER (k IS NULL OR (ts, event_id) > k) >= 3 AS alarm FROM events JOIN l USING (user_id) GROUP BY 1""",
    "SM29_brake": """WITH s AS (SELECT *, max(CASE WHEN event_type = 'error' THEN epoch_us(ts) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
FROM events WHERE event_type IN ('error', 'signup')), j AS (SELECT *, event_type = 'error' AND (prev IS NULL OR epoch_us(ts) - prev > 604800000000) AS lone FROM s)
SELECT event_id, CASE WHEN lone THEN 'soft' ELSE 'hard' END AS severity, CASE WHEN lone THEN epoch_us(ts) + 172800000000 END AS pause_until_us FROM j""",
}
