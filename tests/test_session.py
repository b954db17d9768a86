"""What writing a table leaves on disk."""

import os
import time

from pyspark.sql import functions as F

from quantloom.session import RELEASE_KEY, materialize


def shuffle_files(spark) -> set[str]:
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {name for folder in folders for _, _, names in os.walk(folder) for name in names if name.endswith(".data")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    setting = spark.conf.get(RELEASE_KEY, None)
    grouped = spark.range(0, 20_000, 1, 4).groupBy((F.col("id") % 5000).alias("k")).agg(F.sum("id").alias("s"))
    written = [materialize(grouped) for _ in range(2)]  # the second write computes its shuffle again
    for _ in range(50):  # Spark removes files beside the job
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(RELEASE_KEY, None) == setting
    for frame in written:
        assert frame.count() == 5000 and frame.agg(F.sum("s")).first()[0] == sum(range(20_000))
