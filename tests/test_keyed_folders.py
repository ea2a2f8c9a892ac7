"""A folder of a keyed table is many tasks."""

import os

from pyspark.sql import functions as F

from shockspan.operators import text


def test_a_large_folder_is_many_tasks(spark, tmp_path):
    advisory = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    kept = spark.conf.get(advisory)
    spark.conf.set(advisory, "20000")
    try:
        rows = spark.range(4000, numPartitions=8).select("id", F.sha2(F.col("id").cast("string"), 512).alias("t"))
        path = str(tmp_path / "k")
        text.create_keyed(rows, path, "id", 2)
        files = [len([f for f in os.listdir(f"{path}/part={p}") if f.startswith("part-")]) for p in (0, 1)]
        assert min(files) > 2
        text.upsert_keyed(spark, path, spark.createDataFrame([(3, "new"), (5000, "more")], "id long, t string"), "id", parts=2)
        assert spark.read.parquet(path).count() == 4001
        assert spark.read.parquet(path).filter("t = 'new'").count() == 1
    finally:
        spark.conf.set(advisory, kept)
