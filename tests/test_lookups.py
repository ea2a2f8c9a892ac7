"""Look-ups on a sorted layout with Bloom filters, sketches that add up, fields of JSON columns."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from shockspan.operators import export as E
from shockspan.operators import serving as V
from shockspan.operators import sketches as K


def rows_read(df):
    """(rows, rows that the scan of a query without exchanges gave on)."""
    rows = df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return rows, leaves.apply(0).metrics().apply("numOutputRows").value()


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lookups") / "t")
    df = spark.range(200_000).select((F.col("id") * 7 % 200_000 * 2).alias("k"), F.concat(F.lit("name"), F.xxhash64("id")).alias("name"), F.col("id").alias("n"))
    odd = spark.createDataFrame([(None, "null", -1), (10, "again", -2)], "k long, name string, n long")
    V.write_for_lookups(df.unionByName(odd), path, ["k", "name"], group_bytes=1 << 16, distinct=10_000)
    return spark.read.parquet(path)


def test_a_look_up_reads_few_rows(table):
    rows, n = rows_read(V.lookup(table, {"k": "1234"}))
    assert [r.k for r in rows] == [1234] and n < 40_000
    rows, n = rows_read(V.lookup(table, {"k": 1235}))  # between two values, in range
    assert rows == [] and n < 40_000
    rows, _ = rows_read(V.lookup(table, {"k": 10}))
    assert len(rows) == 2
    assert [r.name for r in V.lookup(table, {"k": None}).collect()] == ["null"]
    assert V.lookup(table, {"k": "x"}).count() == 0


def test_bloom_filters_skip_what_ranges_cannot(table):
    """Names are spread over all row groups, so only the filters can tell."""
    known = table.filter("n = 77").first()
    rows, n = rows_read(V.lookup(table, {"name": known.name}))
    assert [r.n for r in rows] == [77] and n < 60_000
    rows, n = rows_read(V.lookup(table, {"name": "name5"}))
    assert rows == [] and n < 20_000


def test_hot_keys_are_spread(spark, tmp_path):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions would become one
    try:
        V.write_for_lookups(df, str(tmp_path / "t"), ["k"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.exceptAll(df).count() == 0 and back.count() == 30_000
    sizes = [r["count"] for r in back.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 4 and max(sizes) < 10_000
    assert V.lookup(back, {"k": 5}).count() == df.filter("k = 5").count()


def test_one_request(spark):
    values = "sector string, job_loss_pct double, job_change_pct double, recovery_months double, peak_month int"
    exact = spark.createDataFrame([("a", "001", "s", 1.0, 1.0, 1.0, 1), ("a", "001", "t", 2.0, 1.0, 1.0, 1)], f"event_type string, county_id string, {values}")
    wider = spark.createDataFrame([("a", "X", "s", 3.0, 1.0, 1.0, 1)], f"event_type string, state string, {values}")
    ask = lambda *r: sorted(((x.source, x.sector, x.job_loss_pct) for x in E.resolve_one(exact, wider, *r).collect()), key=str)
    assert ask("a", "001", "X") == [("county", "s", 1.0), ("county", "t", 2.0)]
    assert ask("a", "002", "X") == [("state", "s", 3.0)]
    assert ask("b", "001", "X") == ask("a", "002", "Y") == [(None, None, None)]


def test_days_add_up(spark):
    start = dt.date(2024, 1, 1)
    rows = [(start + dt.timedelta(days=i % 50), i % 4_000, f"c{i % 9}" if i % 5 else None) for i in range(30_000)] + [(None, -1, "x")]
    df = spark.createDataFrame(rows, "at date, a long, b string")
    days = K.daily_sketches(df, "at", ["a", "b"])
    assert days.count() == 51
    got = K.summary_of_days(days, "2024-01-11", "2024-02-09").first()
    own = [r for r in rows if r[0] and dt.date(2024, 1, 11) <= r[0] <= dt.date(2024, 2, 9)]
    assert (got.n_rows, got.first_time, got.last_time, got.n_years) == (len(own), dt.date(2024, 1, 11), dt.date(2024, 2, 9), 1)
    assert got.nulls_b == sum(r[2] is None for r in own) and got.n_b == 9
    assert abs(got.n_a / len({r[1] for r in own}) - 1) < 4 * K.relative_error()
    whole = K.summary_of_days(days).first()
    assert whole.n_rows == len(rows) and abs(whole.n_a / 4_001 - 1) < 4 * K.relative_error()
    # loads of the same days in two parts count as one load; sketches put together estimate a little differently
    halves = K.daily_sketches(df.filter("a % 2 = 0"), "at", ["a", "b"]).unionByName(K.daily_sketches(df.filter("a % 2 <> 0"), "at", ["a", "b"]))
    both = K.summary_of_days(halves).first().asDict()
    assert abs(both.pop("n_a") / 4_001 - 1) < 4 * K.relative_error()
    assert both == {k: v for k, v in whole.asDict().items() if k != "n_a"}
    empty = K.summary_of_days(days, "2030-01-01").first()
    assert (empty.n_rows, empty.n_a, empty.nulls_a, empty.first_time) == (0, 0, 0, None)


JSON = ['{"k": 1, "s": "1", "o": {"x": [1, "y"]}}', '{"k": "two", "new.field": null}', '{"k": 2.5}', "[1]", "no json", "{}", None, '{"k": null}', '{"it\'s": true}']


def test_fields_of_json(spark):
    df = spark.createDataFrame([(x,) for x in JSON], "props string")
    got = {r.field: (r.n_rows, r.n_null) for r in K.json_fields(df, "props").collect()}
    assert got == {"k": (4, 1), "s": (1, 0), "o": (1, 0), "new.field": (1, 1), "it's": (1, 0)}
    types = {r.field: r.type for r in K.json_fields(df, "props").collect()}
    assert types["s"] == "STRING" and types["k"] == "VARIANT" and types["o"].startswith("OBJECT<x: ARRAY<")


def test_typed_fields_keep_the_rest(spark):
    df = spark.createDataFrame([(x,) for x in JSON], "props string")
    got = {r.props: r for r in K.typed_fields(df, "props", {"k": "bigint", "s": "string"}).collect()}
    assert (got[JSON[0]].k, got[JSON[0]].s, json.loads(got[JSON[0]].rest)) == (1, "1", {"o": {"x": [1, "y"]}})
    assert got[JSON[1]].k is None and json.loads(got[JSON[1]].rest) == {"k": "two", "new.field": None}
    assert [got[x].rest for x in JSON[3:7]] == ["[1]", "no json", "{}", None]
    assert json.loads(got[JSON[7]].rest) == {"k": None} and json.loads(got[JSON[8]].rest) == {"it's": True}
