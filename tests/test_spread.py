"""Work that takes long per row is dealt over the cores, also where the table is one small file."""

from advertlake.plans import freetext
from advertlake.sources.shared import spread


def test_posts_of_one_file_are_read_by_many_tasks(spark):
    cores = spark.sparkContext.defaultParallelism
    for query in (freetext.post_prices, freetext.free_posts):
        assert query(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4 * cores
    many = spark.range(100, numPartitions=10 * cores)
    assert spread(many) is many and spread(spark.range(100, numPartitions=1)).count() == 100
