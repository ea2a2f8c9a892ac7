"""Scenario export, roll-ups, folds and models on hand-made cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shockspan.functions import places
from shockspan.operators import dashboard as D
from shockspan.operators import export as E
from shockspan.operators import features as X
from shockspan.operators import models as M
from shockspan.operators import serving as V


def facts(spark, rows):
    """rows: event, type, county, sector, window, baseline, excess"""
    full = [(e, t, c, "S", s, w, float(b), float(x), dt.date(2000, 1, 1), "Area (County)") for e, t, c, s, w, b, x in rows]
    return spark.createDataFrame(full, "event_id long, event_type string, county_id string, state string, sector string, window_num int, baseline_exits double, excess_exits double, begin_on date, area string")


def test_scenario_rules(spark):
    rows = []
    for sector, base, xs in [
        ("capped", 1, (10, 10, 10)), ("thin", 0.9, (5, 5, 5)), ("small", 100, (0.5, 0.5, 0.5)), ("missing", 10, (5, 5)),
        ("gain", 10, (-1, -3, -2)), ("fast", 10, (4, 0.4, 3)), ("even", 8, (2, 1, 0)),
    ]:
        rows += [(1, "Severe Storm", "06037", sector, w, base, x) for w, x in enumerate(xs, 1)]
    got = {r.sector: r for r in E.scenario_impact(facts(spark, rows)).collect()}
    assert set(got) == {"capped", "gain", "fast", "even"}
    assert got["capped"].job_loss_pct == 95 and got["capped"].window_1_pct == 95 and got["capped"].event_type == "severe_storm"
    assert got["gain"].job_change_pct == 20 and got["gain"].peak_month == 9 and got["gain"].job_loss_pct is None
    assert got["fast"].recovery_months == 12 and got["even"].recovery_months == 18
    assert got["even"].job_loss_pct == 12  # 12.5 goes to the even number
    assert [s for s, r in sorted(got.items(), key=lambda x: x[1].sector_rank)] == ["capped", "fast", "gain", "even"]


def test_only_eight_sectors(spark):
    rows = [(1, "Fire", "06037", f"s{i}", w, 10, i + 1) for i in range(12) for w in (1, 2, 3)]
    got = E.scenario_impact(facts(spark, rows)).collect()
    assert sorted(int(r.sector[1:]) for r in got) == list(range(4, 12))


def scenarios(spark, rows):
    return spark.createDataFrame(rows, "event_type string, county_id string, state string, sector string, job_loss_pct double, job_change_pct double, recovery_months double, peak_month int, sector_rank int")


def test_rollup_direction_and_defaults(spark):
    df = scenarios(spark, [
        ("fire", "1", "CA", "tie", 10.0, None, None, None, 1), ("fire", "2", "CA", "tie", None, 30.0, None, 9, 1),
        ("fire", "1", "CA", "gains", None, 10.0, None, None, 2), ("fire", "2", "CA", "gains", None, 21.0, None, None, 2),
    ])
    got = {r.sector: r for r in E.rollup_state(df).collect()}
    assert (got["tie"].job_loss_pct, got["tie"].recovery_months, got["tie"].job_change_pct) == (10.0, 12.0, None)
    assert (got["gains"].job_change_pct, got["gains"].peak_month, got["gains"].job_loss_pct) == (15.5, 3, None)
    assert got["tie"].n_counties == 2
    assert E.choose_rollup(df, event_type="fire", county_id="1").count() == 2
    assert set(E.choose_rollup(df, event_type="fire").columns) >= {"n_states"} and "n_types" in E.choose_rollup(df, state="CA").columns
    with pytest.raises(ValueError):
        E.choose_rollup(df)


def test_ranking_without_filters_and_limits(spark):
    df = scenarios(spark, [("fire", "1", "CA", "a", 10.0, None, 6.0, None, 1), ("fire", "1", "CA", "b", None, 5.0, None, 9, 2)])
    assert [(r.kind, r.sector) for r in V.sector_ranking(df).collect()] == [("loss", "a"), ("surge", "b")]
    assert V.sector_ranking(df, "NV").count() == 0
    with pytest.raises(ValueError):
        V.list_limit(df, "sector", 0)


def test_curves_bands_and_pivots(spark):
    df = scenarios(spark, [("fire", "1", "CA", "Retail & Hospitality", 26.0, None, 12.0, None, 1), ("fire", "1", "CA", "Legal", None, 12.0, None, 3, 2)])
    rows = {(r.sector, r.month): r.value for r in D.displacement_curve(df).collect()}
    assert [rows[("Retail & Hospitality", m)] for m in (-6, 0, 6, 12, 18)] == [0, -26, -13, 0, 0]
    assert [rows[("Legal", m)] for m in (-3, 0, 1, 3, 6, 12, 15)] == [0, 0, 4, 12, 8, 0, 0]
    wide = D.displacement_curve(df, ["Legal"]).columns
    assert wide == ["event_type", "county_id", "month", "Legal"]
    bands = {r.sector: (r.risk_score, r.recovery_time) for r in D.risk_band(df).collect()}
    assert bands == {"Retail & Hospitality": ("High", "~12 months"), "Legal": ("Low", "Peaks month 3")}
    pivots = {(r.sector, r.position): r.suggestion for r in D.pivot_suggestions(df.select("sector")).collect()}
    assert pivots[("Retail & Hospitality", 0)] == "Food Delivery" and pivots[("Legal", 2)] == "Adjacent Sectors"


def test_slider_prefers_the_forecast(spark):
    past = spark.createDataFrame([("A", "x", dt.date(2000, 1, 1), 3)], "state string, event_type string, month date, n long")
    ahead = spark.createDataFrame([("A", "x", dt.date(2000, 1, 1), 7.5), ("B", "x", dt.date(2000, 1, 1), 1.0)], "state string, event_type string, month date, predicted double")
    states = D.slider_table(past, ahead).collect()[0].states
    assert states["A"]["count"] == 7.5 and states["A"]["kind"] == "forecast" and set(states) == {"A", "B"}


def test_unknown_industries_are_other(spark):
    df = spark.createDataFrame([("Banking",), ("Basket Weaving",)], "industry string")
    got = {r.industry: r.sector for r in X.map_lookup(df, places.sector_dimension(spark), "industry", "sector", places.OTHER_SECTOR).collect()}
    assert got == {"Banking": "Finance", "Basket Weaving": "Other"}
    assert places.state_dimension(spark).count() == 51


def test_codes_are_alphabetical_across_first_letters(spark):
    values = ["b", "Brand#10", "Brand#2", "a", "Brand#1", "", "aa"]
    df = spark.createDataFrame([(v,) for v in values * 2 + [None]], "v string")
    assert {r.v: r.code for r in X.category_code(df, "v", "code").collect()} == {v: i for i, v in enumerate(sorted(values))}


def test_peak_ties_zero_and_scale(spark):
    df = spark.createDataFrame([(0, 0, 0, 0, 0, 0), (1, 3, 3, 0, 0, 0), (0, 0, 0, 0, 0, 2)], ", ".join(f"exits_month_{i} int" for i in range(1, 7)))
    assert [(r.peak_exit_month, r.peak_exits, r.immediate_impact) for r in X.peak_features(df).collect()] == [(0, 0, 0), (2, 3, 1), (6, 2, 0)]
    s = spark.createDataFrame([(4, 0.0), (6, 2.0), (1, 4.0)], "post_exits int, baseline_exits double")
    assert [(r.exit_ratio, r.high_turnover) for r in X.scale_features(s).collect()] == [(4.0, 0), (3.0, 0), (0.25, 1)]


def test_folds_are_disjoint_and_balanced(spark):
    rows = [(g,) for g in range(60) for _ in range(1 + g % 9)]
    df = spark.createDataFrame(rows, "event_id long")
    folds = M.group_folds(df, "event_id").collect()
    assert len(folds) == 60 and {r.fold for r in folds} == set(range(5))
    sizes = {}
    for r in folds:
        sizes[r.fold] = sizes.get(r.fold, 0) + r.group_rows
    assert max(sizes.values()) - min(sizes.values()) <= 9
    assert M.with_folds(df, "event_id").count() == len(rows)


@pytest.mark.parametrize("n", [1, 2, 5])
def test_groups_go_to_the_lightest_fold(spark, n):
    rng = random.Random(n)
    sizes = {g: rng.choice([1, 1, 1, 2, 2, 3, 7, 7, 40]) for g in range(150)} | {900: 300, 901: 299, None: 4}
    df = spark.createDataFrame([(g,) for g, k in sizes.items() for _ in range(k)], "event_id long")
    loads, want = [0] * n, {}
    for g, k in sorted(sizes.items(), key=lambda x: (-x[1], x[0] is not None, x[0] or 0)):
        want[g] = loads.index(min(loads))
        loads[want[g]] += k
    assert {r.event_id: (r.group_rows, r.fold) for r in M.group_folds(df, "event_id", n).collect()} == {g: (sizes[g], f) for g, f in want.items()}
    if n == 5:
        assert max(loads) - min(loads) <= max(sizes.values())


def test_turns_of_many_equal_groups():
    assert M.turns([(5, 10**12)], 3) == [(5, [(0, [0, 1, 2])])]
    assert M.turns([(100, 1), (10, 15)], 2) == [(100, [(0, [0, 1])]), (10, [(1, [1]), (11, [0, 1])])]


def test_boosted_trees_beat_the_mean(spark):
    df = spark.range(600).select(
        F.col("id"), (F.col("id") % 40).alias("event_id"), (F.col("id") % 7).cast("double").alias("a"), (F.rand(1) * 3).alias("b")
    ).withColumn("y", F.col("a") * 2 + F.col("b"))
    rows = M.with_folds(df, "event_id").cache()
    out = M.cross_validate(rows, ["a", "b"], "y", ["id"], rounds=25)
    assert out.count() == 600
    r = M.baseline_error(out, "y", "prediction").collect()[0]
    assert r.winner == "model" and r.improvement_pct > 40
    model = M.train_boosted(rows, ["a", "b"], "y", rounds=5)
    top = M.feature_importance(model, rows).collect()
    assert top[0].feature == "a" and abs(sum(r.importance for r in top) - 1) < 1e-6


def test_standardise_uses_training_rows_only(spark):
    df = spark.createDataFrame([(0, 1.0, 5.0), (1, 2.0, 5.0), (1, 4.0, 5.0)], "fold int, x double, c double")
    got = M.standardise(df, ["x", "c"], F.col("fold") == 1).orderBy("x").collect()
    assert [r.x for r in got] == [-2.0, -1.0, 1.0] and [r.c for r in got] == [0.0, 0.0, 0.0]
