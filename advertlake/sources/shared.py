"""The folder that driver and executors share, for tables between jobs and for streaming checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder, in a local session only."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="advertlake-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def persisted(df: DataFrame) -> DataFrame:
    """df as a written table of the shared folder, for results that a plan reads twice: a lost executor loses none of it. The shuffle files of the write
    are dropped as soon as it has ended."""
    spark = df.sparkSession
    path, schema, before = new_path(spark, "table"), df.schema, spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(schema).parquet(path)


def spread(rows: DataFrame, per_core: int = 4) -> DataFrame:
    """rows over several tasks a core, for work that takes long per row: a small file is read by one task however many cores there are."""
    least = per_core * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(least) if rows.rdd.getNumPartitions() < least else rows
