"""Join, window, set and consensus shapes of the advert workload, each as one DataFrame function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The last row of each key by (at, tie), as one aggregate with partial maxima before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("r"))
    return top.select(*keys, "r.*")


def first_per_key(df: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(at, tie)).alias("r")).select(*keys, "r.*")


def asof_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, value: str, slack_s: int = 0) -> DataFrame:
    """Each left row with the value of the last right row of its key at or before left_at + slack. Both sides go through one sort by
    (key, time) and a running last value: no pair is ever made, so a hot key costs a sort, not a product."""
    shifted = (F.unix_micros(left_at) + slack_s * 1_000_000).alias("_t")
    both = left.select(F.col(key).alias("_k"), shifted, F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    both = both.unionByName(
        right.select(F.col(key).alias("_k"), F.unix_micros(right_at).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(both.schema["_l"].dataType).alias("_l"), F.col(value).alias("_v"))
    )
    w = Window.partitionBy("_k").orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    got = both.withColumn("_last", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1")
    return got.select("_l.*", F.col("_last").alias(f"asof_{value}"))


def interval_semi(left: DataFrame, right: DataFrame, keys: list[str], at: str, seconds: int, extra: Column | None = None) -> DataFrame:
    """Left rows with a right row of equal keys within the interval around their time; right columns are r_*."""
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    on = F.abs(F.unix_micros(at) - F.unix_micros(f"r_{at}")) <= seconds * 1_000_000
    for k in keys:
        on &= F.col(k) == F.col(f"r_{k}")
    return left.join(r, on if extra is None else on & extra, "left_semi")


def unique_pairs(left: DataFrame, right: DataFrame, keys: list[str], at: str, seconds: int) -> DataFrame:
    """Pairs of equal keys within the interval that are the only partner of each other in both directions."""
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    on = F.abs(F.unix_micros(at) - F.unix_micros(f"r_{at}")) <= seconds * 1_000_000
    for k in keys:
        on &= F.col(k) == F.col(f"r_{k}")
    pairs = left.join(r, on)
    a, b = Window.partitionBy("id"), Window.partitionBy("r_id")
    pairs = pairs.withColumns({"_a": F.count("*").over(a), "_b": F.count("*").over(b)})
    return pairs.filter("_a = 1 and _b = 1").drop("_a", "_b")


def vote_consensus(votes: DataFrame) -> DataFrame:
    """(listing) that voters call wrong: of the last vote of each (listing, voter), at least two are wrong and more than are right;
    an audit of the owner alone suffices. votes: listing, voter, action, at, tie."""
    acts = ["wrong", "right", "sold"]
    last = latest_per_key(votes.filter(F.col("action").isin(acts)), ["listing", "voter"], "at", "tie")
    g = last.groupBy("listing").agg(F.count_if(F.col("action") == "wrong").alias("w"), F.count_if(F.col("action") == "right").alias("r"))
    agreed = g.filter("w >= 2 and w > r").select("listing")
    return agreed.union(votes.filter(F.col("action") == "audit_wrong").select("listing")).distinct()


def stratified_sample(df: DataFrame, by: str, n: int, seed: Column) -> DataFrame:
    """n rows of each stratum by the order of a seeded hash: the same rows on every run."""
    w = Window.partitionBy(by).orderBy(seed, "event_id")
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def islands(df: DataFrame, key: str, at: str, gap_s: int) -> DataFrame:
    """Streaks of each key: rows whose distance to the row before is at most gap_s belong together."""
    w = Window.partitionBy(key).orderBy(at, "event_id")
    new = F.coalesce(F.unix_micros(at) - F.lag(F.unix_micros(at)).over(w) > gap_s * 1_000_000, F.lit(True))
    rows = df.withColumn("_new", new.cast("int")).withColumn("streak", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "streak").agg(F.count("*").alias("rows"), F.min(at).alias("began"), F.max(at).alias("ended"))


def snapshot_diff(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """(key, change): new rows, vanished rows and rows that stay, between two snapshots."""
    a, b = before.select(F.col(key).alias("_b")).distinct(), now.select(F.col(key)).distinct()
    gone = a.join(b, F.col("_b") == F.col(key), "left_anti").select(F.col("_b").alias(key), F.lit("gone").alias("change"))
    new = b.join(a, F.col("_b") == F.col(key), "left_anti").select(key, F.lit("new").alias("change"))
    stay = b.join(a, F.col("_b") == F.col(key), "left_semi").select(key, F.lit("kept").alias("change"))
    return gone.unionByName(new).unionByName(stay)


def upsert(state: DataFrame, rows: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """State after an idempotent upsert: of each key the last row wins, whichever side it comes from; applying it again changes nothing."""
    return latest_per_key(state.unionByName(rows), keys, at, tie)
