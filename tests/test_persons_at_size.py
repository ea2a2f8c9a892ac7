"""What the nested persons shuffle and write."""

import os

from pyspark.sql import functions as F

from shockspan.plans import catalog
from shockspan.session import shared_folder
from shockspan.sources.tables import Tables

FOLDER = "/root/testdata/sf0.001"


def test_persons_are_written_compressed(spark):
    folder = shared_folder(spark)
    before = set(os.listdir(folder))
    catalog.QUERIES["read_persons"](spark, FOLDER).count()
    written = [f for d in set(os.listdir(folder)) - before if d.startswith("json-") for f in os.listdir(f"{folder}/{d}") if f.startswith("part-")]
    assert written and all(f.endswith(".json.gz") for f in written)


def test_lines_meet_orders_that_have_their_place(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        persons = Tables(spark, FOLDER).persons
        plan = persons._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    # the persons are grouped where the lines met their orders, and customers meet orders only
    assert sum("Exchange hashpartitioning(l_" in line for line in plan.splitlines()) == 3
    assert persons.agg(F.sum(F.size("jobs"))).first()[0] == Tables(spark, FOLDER).jobs.count()
