"""Hand-off ingest: JSON lines become posts or a reject reason, and micro-batches append the posts that the table does not hold yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: version and platform of the hand-off format, and the pattern of its keys
VERSION, PLATFORM, KEY = 1, "facebook", "^fbp?:[A-Za-z0-9._-]+$"
FUTURE_SLACK_S = 600
_LINE = "surum int, platform string, anahtar string, gonderi string, metin string, paylasim_utc string, goruldu_utc string, satici_gonderi_14g int, metin_kesik boolean, _corrupt string"


def reject_reason(doc: Column) -> Column:
    """Why a line is refused, else null; the first that holds: not JSON, version, platform, missing or malformed fields."""
    broken = doc.isNull() | doc["_corrupt"].isNotNull()
    fields = F.coalesce(doc["anahtar"].rlike(KEY) & doc["gonderi"].rlike("^[0-9A-Za-z_-]+$") & doc["metin"].isNotNull(), F.lit(False))
    return F.when(broken, "bozuk_satir").when(~F.coalesce(doc["surum"] == VERSION, F.lit(False)), "surum").when(~F.coalesce(doc["platform"] == PLATFORM, F.lit(False)), "platform").when(~fields, "alan")


def parse_lines(lines: DataFrame) -> DataFrame:
    """value (one JSON line) -> reason, source_key, post_id, text, posted_at, seen_at, dated, seller_kind, truncated. A post time more than ten
    minutes after the time it was seen is dropped; a missing post time falls back to the seen time and dated is false."""
    d = lines.select(F.from_json("value", _LINE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("d"))
    posted, seen = F.col("d.paylasim_utc").try_cast("timestamp"), F.col("d.goruldu_utc").try_cast("timestamp")
    sure = F.when(~F.coalesce(F.unix_timestamp(posted) > F.unix_timestamp(seen) + FUTURE_SLACK_S, F.lit(False)), posted)
    n = F.col("d.satici_gonderi_14g")
    return d.select(
        reject_reason(F.col("d")).alias("reason"), F.split_part("d.anahtar", F.lit(":"), F.lit(2)).alias("source_key"), F.col("d.gonderi").alias("post_id"), F.col("d.metin").alias("text"),
        F.coalesce(sure, seen).alias("posted_at"), seen.alias("seen_at"), sure.isNotNull().alias("dated"),
        F.when(n >= 3, "galeri").when(n >= 1, "sahibinden").alias("seller_kind"), F.coalesce("d.metin_kesik", F.lit(False)).alias("truncated"))


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, files_per_batch: int = 8) -> None:
    """Reads what a folder of line files has got since the checkpoint and appends each post once, by (source_key, post_id). A batch writes its own
    partition with overwrite: a batch that is run again after a failure replaces what it wrote, and is compared with the other batches only."""
    schema = None

    def upsert(batch: DataFrame, number: int) -> None:
        nonlocal schema
        rows = batch.filter("reason is null").drop("reason").dropDuplicates(["source_key", "post_id"])
        if number:
            rows = rows.join(spark.read.schema(schema).parquet(out).filter(F.col("batch") < number).select("source_key", "post_id"), ["source_key", "post_id"], "left_anti")
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").partitionBy("batch").option("partitionOverwriteMode", "dynamic").parquet(out)

    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    posts = parse_lines(lines)
    schema = posts.drop("reason").withColumn("batch", F.lit(0)).schema
    posts.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
