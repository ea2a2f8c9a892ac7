"""Nothing is lost to a fixed span, a null key, a short list or one task."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shockspan.operators import features as X
from shockspan.operators import forecast as P
from shockspan.operators import impact as I
from shockspan.operators import series as S
from shockspan.operators import serving as V
from shockspan.operators import text as T
from shockspan.plans import series_plans as SP
from shockspan.sources.tables import Tables


@pytest.mark.parametrize("scale", ["0.001", "0.01", "0.1"])
def test_the_calendar_holds_every_order(spark, scale):
    t = Tables(spark, f"/root/testdata/sf{scale}")
    assert SP.filled(t).agg(F.sum("n")).first()[0] == t.table("orders").count()


def test_the_calendar_follows_the_data(spark):
    rows = [("A", "x", dt.date(2012, 5, 1), 3), ("B", "x", dt.date(2013, 2, 1), 1)]
    monthly = spark.createDataFrame(rows, "state string, event_type string, month date, n long")
    got = S.calendar_fill(monthly, *S.calendar_span(monthly)).groupBy("state").agg(F.min("month").alias("a"), F.max("month").alias("b"), F.sum("n").alias("n"))
    assert {tuple(r) for r in got.collect()} == {("A", dt.date(2012, 5, 1), dt.date(2013, 2, 1), 3), ("B", dt.date(2012, 5, 1), dt.date(2013, 2, 1), 1)}


def test_codes_of_many_values_with_one_common_prefix(spark):
    values = [f"Brand#{i:05d}" for i in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(7)
    assert {r.v: r.code for r in X.category_code(df, "v", "code").collect()} == {v: i for i, v in enumerate(values)}


def test_onehot_takes_any_number_of_rows_and_nulls(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), ("c",)], "v string")
    assert [(r.v, r.is_a, r.is_b) for r in X.onehot(df, "v", ["a", "b"], "is").collect()] == [("a", 1, 0), ("b", 0, 1), (None, 0, 0), ("c", 0, 0)]


FACTS = [("i", "s", "t", "A", 1, 2.0, 0), (None, "s", None, None, 2, 4.0, 1), ("i", None, "t", "A", 3, 6.0, 1)]


def test_rows_with_null_keys_stay(spark):
    df = spark.createDataFrame(FACTS, "industry string, sector string, event_type string, state string, event_id long, excess_exits double, fold int")
    got = {r.event_id: r.m for r in X.target_mean(df, "industry", "m").collect()}
    assert got == {1: 4.0, 2: None, 3: 4.0}
    got = {r.event_id: r.m for r in X.target_mean(df, "industry", "m", fold="fold").collect()}
    assert got == {1: 6.0, 2: None, 3: 2.0}
    got = {r.event_id: (r.industry_frequency, r.state_shock_frequency) for r in X.frequency_encode(df).collect()}
    assert got == {1: (2, 2), 2: (None, None), 3: (2, 2)}
    got = {r.event_id: (r.type_sector_avg_displacement, r.sector_frequency, r.type_code) for r in X.type_sector_displacement(df).collect()}
    assert got == {1: (2.0, 2, 0), 2: (None, 2, None), 3: (None, None, 0)}


def test_the_matrix_keeps_facts_with_null_keys(spark):
    schema = "event_id long, county_id string, begin_on date, end_on date, event_type string, title string, area string, state string"
    on = dt.date(2000, 5, 1)
    shocks = spark.createDataFrame([(1, "a", on, on, None, "t", "x", None), (2, "a", on, None, "storm", "t", "x", "A")], schema)
    exits = spark.createDataFrame([("a", "i", dt.date(2000, 6, 1))], "county_id string, industry string, ended_on date")
    facts = I.window_impact(shocks, exits).cache()
    mapping = spark.createDataFrame([("i", "S")], "industry string, sector string")
    got = {r.event_id: r for r in X.feature_matrix(facts, shocks, exits, mapping, types=["storm"], sectors=["S"]).collect()}
    assert set(got) == {1, 2} and got[1].type_storm == 0 and got[2].type_storm == 1 and got[1].sector_S == 1
    assert got[1].type_code is None and got[1].industry_frequency == 2


def test_states_are_given_in_any_case(spark):
    rows = [("FL", "storm", "Tech", 10.0, 6.0, None, None), ("GA", "storm", "Tech", 30.0, 6.0, None, None)]
    df = spark.createDataFrame(rows, "state string, event_type string, sector string, job_loss_pct double, recovery_months double, job_change_pct double, peak_month int")
    assert [r.pct for r in V.sector_ranking(df, "fl", "STORM").collect()] == [10.0]


def test_the_outlook_is_the_winners(spark):
    months = [(dt.date(2000 + i // 12, i % 12 + 1, 1), i) for i in range(48)]
    rows = [("A", "x", i, m, 48, 7 if i > 30 else 1) for m, i in months]
    series = spark.createDataFrame(rows, "state string, event_type string, t int, month date, months int, n long")
    best = spark.createDataFrame([("A", "x", "smoothing", 0.0)], "state string, event_type string, best_model string, best_mae double")
    got = [r.predicted for r in P.winning_forecast(series, best).orderBy("step").collect()]
    level = 1.0
    for *_, n in rows:
        level = 0.3 * n + 0.7 * level
    assert len(got) == 12 and all(abs(x - level) < 1e-5 for x in got)


def test_exits_are_read_once(spark):
    """Their cells are stored; the plan that joins them holds no scan of the line items."""
    t = Tables(spark, "/root/testdata/sf0.001")
    scans = I.window_impact(t.majors, t.exits)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_shipdate" not in scans


def test_hashed_words_of_empty_texts(spark):
    df = spark.createDataFrame([(1, "a b A"), (2, ""), (3, None)], "id long, text string")
    got = {r.id: sum(r.embedding) for r in T.hashed_words(df, "id", "text").collect()}
    assert got == {1: 3.0, 2: 0.0, 3: 0.0}


def test_distinct_counts_exact_and_estimated(spark):
    df = spark.range(3000).select((F.col("id") % 700).alias("a"), F.lit(None).cast("int").alias("b"), F.lit(dt.date(2001, 1, 1)).alias("at"))
    exact = S.dataset_summary(df, "at", ["a", "b"]).first()
    near = S.dataset_summary(df, "at", ["a", "b"], error=0.05).first()
    assert (exact.n_a, exact.n_b, exact.nulls_b) == (700, 0, 3000) and abs(near.n_a - 700) < 90 and near.n_b == 0
