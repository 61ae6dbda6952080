"""Stateful watchers over event streams: consecutive failures of a source, the brake of a reader, and daily counts by local day."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# fixed values: alarm after so many failures in a row; a soft signal pauses for 48 h, a second one within 7 days is hard
FAIL_LIMIT, SOFT_PAUSE_S, SOFT_REPEAT_S = 3, 48 * 3600, 7 * 86400
_BRAKE = "key long, event_id long, at_us long, severity string, pause_until_us long"


def failure_runs(results: DataFrame) -> DataFrame:
    """Of one batch (key, ok, at, tie): per key the failures after its last success, and whether it had a success. Two aggregates with partial
    results before the shuffle, so a hot key is no group in memory."""
    order = F.struct("at", "tie")
    last = results.filter("ok").groupBy("key").agg(F.max(order).alias("last_ok"))
    after = F.col("last_ok").isNull() | (order > F.col("last_ok"))
    return results.join(last, "key", "left").groupBy("key").agg(F.count_if(after & ~F.col("ok")).alias("trailing"), F.bool_or(F.col("last_ok").isNotNull()).alias("had_ok"))


def track_failures(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Keeps the failures in a row of each key: state version n + 1 is version n with the batch applied, and each version is its own folder, so a
    batch that is run again writes the same version again."""
    spark = stream.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        got = failure_runs(batch)
        old = spark.read.parquet(f"{out}/{number - 1}") if number else spark.createDataFrame([], "key long, failures long")
        both = got.join(old, "key", "full")
        n = F.when(F.col("trailing").isNull(), F.col("failures")).when(F.col("had_ok"), F.col("trailing")).otherwise(F.coalesce("failures", F.lit(0)) + F.col("trailing"))
        both.select("key", n.cast("long").alias("failures")).write.mode("overwrite").parquet(f"{out}/{number}")

    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def brake(signals: DataFrame) -> DataFrame:
    """Severity of each signal (key, event_id, at_us, soft) of a reader: hard unless soft; a soft one within seven days of the soft one before is
    hard; a lone soft one pauses for 48 hours. The state is the time of the last soft signal. Within a batch signals are taken in time order."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["at_us", "event_id"])  # signals of one reader are rare: a batch of them is small
        severity, until = [], []
        for at, soft in zip(rows["at_us"], rows["soft"], strict=True):
            lone = bool(soft) and (last is None or at - last > SOFT_REPEAT_S * 1_000_000)
            severity.append("soft" if lone else "hard")
            until.append(at + SOFT_PAUSE_S * 1_000_000 if lone else None)
            last = int(at) if soft else last
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"key": key[0], "event_id": rows["event_id"], "at_us": rows["at_us"], "severity": severity, "pause_until_us": pd.array(until, dtype="Int64")})

    return signals.groupBy("key").applyInPandasWithState(step, _BRAKE, "last_soft long", "append", GroupStateTimeout.NoTimeout)


def daily_counts(stream: DataFrame, at: str, by: str, zone: str, lateness: str = "1 day") -> DataFrame:
    """Rows per local day and by, with a watermark; in append mode a day is given once it is closed."""
    local = F.to_date(F.from_utc_timestamp(at, zone)).cast("timestamp")
    return stream.withColumn("_day", local).withWatermark("_day", lateness).groupBy(F.window("_day", "1 day"), by).agg(F.count("*").alias("rows")).select(F.to_date("window.start").alias("day"), by, "rows")


def to_table(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Appends a stream to a Parquet table until its source has no more."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
