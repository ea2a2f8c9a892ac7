"""What a stage shuffled is gone when its table stands."""

import time

from pyspark.sql import functions as F

from shockspan.session import stored


def shuffled(spark):
    ids = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (ids.apply(i).getName() for i in range(ids.size())) if n.startswith("shuffle_")}


def test_a_stage_leaves_no_shuffle(spark):
    before = shuffled(spark)
    out = stored(spark.range(1000).withColumn("g", F.col("id") % 7).groupBy("g").count())
    until = time.time() + 10
    while shuffled(spark) - before and time.time() < until:  # deleted in the background
        time.sleep(0.2)
    assert not shuffled(spark) - before
    assert out.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")
