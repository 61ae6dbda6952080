"""Rows without a key, which match nothing, are dealt over all tasks of a left join."""

from pyspark.sql import functions as F

from advertlake.operators import reads as R


def test_nulls_are_dealt(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 100 == 0, F.col("id")).alias("copied"))
    tasks = rows.select(R.dealt(F.col("copied"), F.col("id")).alias("k")).repartition(8, "k").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(tasks) == 8 and max(t["count"] for t in tasks) < 4_000


def test_a_made_up_key_matches_nothing(spark):
    """A phone and a handle that look like the made-up key of another advert do not become its seller."""
    import types

    cols = "id long, duplicate_of long, source_id long, seller_phone string, seller_handle string, is_active boolean"
    rows = [(1, None, 1, None, "site:a", True), (2, None, 1, "\x001", None, True), (3, None, 1, "\x001", None, True), (4, 1, 1, "\x001", "site:a", True), (5, None, None, "9", "site:a", True), (6, None, None, None, "site:a", True)]
    got = R.seller_counts(types.SimpleNamespace(listings=spark.createDataFrame(rows, cols))).collect()
    assert {r.id: r.n for r in got} == {1: 0, 2: 1, 3: 1, 4: 2, 5: 0, 6: 0}
