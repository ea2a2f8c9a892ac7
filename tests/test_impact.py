"""Range sums and window impact on hand-made edge cases, against plain loops."""

import datetime as dt

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shockspan.functions.columns import shift
from shockspan.operators import features as X
from shockspan.operators import impact as I
from shockspan.operators import ranges
from shockspan.operators.ranges import range_sums

D = dt.date


def shocks(spark, rows):
    full = [(i, c, b, e, "flood", "t", "a", "s") for i, c, b, e in rows]
    return spark.createDataFrame(full, "event_id long, county_id string, begin_on date, end_on date, event_type string, title string, area string, state string")


def exits(spark, rows):
    return spark.createDataFrame(rows, "county_id string, industry string, ended_on date")


def brute(shock_rows, exit_rows):
    out = {}
    for event, county, begin, _ in shock_rows:
        if begin is None:
            continue
        start = pd.Timestamp(begin)
        for w, lo, hi in I.WINDOWS:
            p1, p2 = start + pd.DateOffset(months=lo), start + pd.DateOffset(months=hi)
            counts = {}
            for c, industry, day in exit_rows:
                if c != county or day is None:
                    continue
                at = pd.Timestamp(day)
                for slot, years in enumerate((0, 2, 3)):
                    if p1 - pd.DateOffset(years=years) <= at < p2 - pd.DateOffset(years=years):
                        counts.setdefault(industry, [0, 0, 0])[slot] += 1
            for industry, n in counts.items():
                out[(event, county, industry, w)] = (*n, (n[1] + n[2]) / 2, n[0] - (n[1] + n[2]) / 2)
    return out


def result(df):
    cols = ["post_exits", "baseline_yr2_exits", "baseline_yr3_exits", "baseline_exits", "excess_exits"]
    return {(r.event_id, r.county_id, r.industry, r.window_num): tuple(r[c] for c in cols) for r in df.collect()}


def test_half_open_edges_and_month_ends(spark):
    s = [(1, "a", D(2000, 2, 29), None), (2, "a", D(1999, 8, 31), None), (3, "b", D(2000, 1, 1), None), (4, "a", None, None)]
    e = []
    for _, c, b, _ in s[:3]:
        start = pd.Timestamp(b)
        for m in range(-40, 22):
            for day in (-1, 0, 1):
                e.append((c, "x" if m % 2 else "y", (start + pd.DateOffset(months=m) + pd.DateOffset(days=day)).date()))
    e += [("a", "only before", D(1997, 3, 1)), ("zz", "x", D(2000, 3, 1)), ("a", "x", None)]
    assert result(I.window_impact(shocks(spark, s), exits(spark, e))) == brute(s, e)


days = st.dates(D(1996, 1, 1), D(2004, 12, 31))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), days), min_size=1, max_size=12), st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from("xyz"), days), max_size=60))
def test_window_impact_equals_loops(spark, begins, ends):
    s = [(i, c, b, None) for i, (c, b) in enumerate(begins)]
    assert result(I.window_impact(shocks(spark, s), exits(spark, ends))) == brute(s, ends)


def test_times_below_a_day_and_split_lanes(spark):
    base = dt.datetime(2000, 6, 1, 12)
    points = [("a", "x", base + dt.timedelta(hours=7 * i)) for i in range(-40, 40)]
    anchors = [("a", base), ("a", base + dt.timedelta(hours=1)), ("a", base + dt.timedelta(days=3, seconds=1))]
    p = spark.createDataFrame(points, "k string, g string, at timestamp_ntz")
    q = spark.createDataFrame(anchors, "k string, t timestamp_ntz")
    got = range_sums(
        p, q, by=["k"], within=["g"], point_time="at", anchor_time="t",
        ranges={"n": (lambda t: t, lambda t: shift(t, 1)), "m": (lambda t: shift(t, -1), lambda t: t)}, reach=(1, 1), cells_per_task=3,
    )
    want = {}
    for _, t in anchors:
        hi, lo = pd.Timestamp(t) + pd.DateOffset(months=1), pd.Timestamp(t) - pd.DateOffset(months=1)
        want[t] = (sum(t <= x < hi for _, _, x in points), sum(lo <= x < t for _, _, x in points))
    assert {r.t: (r.n, r.m) for r in got.collect()} == want


def test_windows_add_up(spark):
    s = [(1, "a", D(2000, 3, 15), None)]
    e = [("a", "x", D(2000, 3, 15) + dt.timedelta(days=9 * i)) for i in range(80)]
    rows = result(I.window_impact(shocks(spark, s), exits(spark, e)))
    inside = sum(D(2000, 3, 15) <= d < D(2001, 9, 15) for _, _, d in e)
    assert sum(v[0] for v in rows.values()) == inside


def test_prior_shocks_and_exposure(spark):
    s = [(1, "a", D(2000, 2, 28), None), (2, "a", D(2002, 2, 28), None), (3, "a", D(2002, 2, 28), None), (4, "a", D(2002, 3, 1), None), (5, "b", D(2002, 3, 1), None)]
    got = {r.event_id: (r.prior_shocks, r.recently_hit) for r in X.prior_shocks(shocks(spark, s)).collect()}
    assert got == {1: (0, 0), 2: (1, 1), 3: (1, 1), 4: (2, 1), 5: (0, 0)}
    weight = {r.event_id: r.exposure_weighted for r in X.decayed_exposure(shocks(spark, s), 100.0).collect()}
    assert abs(weight[4] - 2 * 2.718281828 ** (-1 / 100)) < 1e-6 and weight[1] == weight[5] == 0


def test_duration_fills_median_and_clips(spark):
    s = shocks(spark, [(1, "a", D(2000, 1, 1), D(2000, 1, 11)), (2, "a", D(2000, 1, 1), D(1999, 12, 1)), (3, "a", D(2000, 1, 1), None), (4, "b", D(2000, 1, 1), D(2000, 1, 5))])
    got = {r.event_id: r.duration_days for r in X.duration_days(s.select("event_id", "county_id"), s).collect()}
    assert got == {1: 10.0, 2: 0.0, 3: 4.0, 4: 4.0}


def test_dedup_keeps_the_earliest(spark):
    s = shocks(spark, [(1, "a", D(2001, 1, 1), None), (1, "a", D(2000, 1, 1), None), (1, "a", None, None), (1, "b", D(2002, 1, 1), None)])
    got = {(r.event_id, r.county_id): r.begin_on for r in I.dedup_shocks(s).collect()}
    assert got == {(1, "a"): D(2000, 1, 1), (1, "b"): D(2002, 1, 1)}


def test_county_key_does_not_cut(spark):
    df = spark.createDataFrame([("6", "37"), ("12", "086"), ("123", "4567")], "a string, b string")
    assert [r[0] for r in df.select(I.county_key(F.col("a"), F.col("b"))).collect()] == ["06037", "12086", "1234567"]


def test_flatten_skips_what_has_no_place_end_or_company(spark):
    schema = "jobs array<struct<title string, started_at string, ended_at string, location_details struct<county_id string, locality string, region string>, company struct<name string, industry string>>>"
    place, firm = ("06037", "LA", "CA"), ("Acme", "Retail")
    jobs = [
        ("ok", "2000-01-01", "2001-02-03", place, firm), ("active", "2000-01-01", None, place, firm), ("blank", "2000-01-01", "", place, firm),
        ("no place", "2000-01-01", "2001-01-01", None, firm), ("no firm", "2000-01-01", "2001-01-01", place, None),
        ("no industry", "2000-01-01", "2001-01-01", place, ("Acme", None)), ("second", "2000-01-01", "2002-02-03", place, firm),
    ]
    df = spark.createDataFrame([(jobs,), (None,), ([],)], schema)
    assert sorted(r.title for r in I.flatten_exits(df).collect()) == ["ok", "second"]


def test_months_count_from_the_calendar_month(spark):
    s = [(1, "a", D(2000, 1, 31), None)]
    e = [("a", "x", D(2000, 1, 2)), ("a", "x", D(2000, 2, 1)), ("a", "x", D(2000, 6, 30)), ("a", "x", D(2000, 7, 1)), ("a", "x", D(1999, 12, 31))]
    keys = I.impact_keys(shocks(spark, s), exits(spark, e))
    row = I.exits_by_month_offset(keys, exits(spark, e)).collect()[0]
    assert [row[f"exits_month_{i}"] for i in range(1, 7)] == [1, 1, 0, 0, 0, 1]


def test_hot_county_stays_whole(spark):
    """Two thirds of the exits on one day of one county."""
    s = [(i, "a" if i % 3 else "b", D(2000, 1, 1) + dt.timedelta(days=i), None) for i in range(40)]
    e = [("a", "x", D(2000, 3, 1))] * 400 + [("b", "y", D(2000, 2, 1) + dt.timedelta(days=i)) for i in range(200)]
    assert result(I.window_impact(shocks(spark, s), exits(spark, e))) == brute(s, e)
