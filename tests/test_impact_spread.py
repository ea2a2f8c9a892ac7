"""Windows are spread after what joins the facts, and wide rows are compiled."""

from shockspan.operators import impact as I
from shockspan.plans.impact_plans import counts_stage, impact_of, impact_stage
from shockspan.session import compiled
from shockspan.sources.tables import Tables

FOLDER = "/root/testdata/sf0.001"


def test_impact_is_stored_before_the_windows_are_spread(spark):
    t = Tables(spark, FOLDER)
    facts, whole = impact_stage(t), impact_of(t)
    assert facts.columns == whole.columns
    assert facts.exceptAll(whole).count() == whole.exceptAll(facts).count() == 0
    assert counts_stage(t).count() < facts.count()


def test_spread_windows_keeps_nulls_and_copies(spark):
    names = [f"{k}_{n}" for n, _, _ in I.WINDOWS for k in ("post", "base2", "base3")]
    schema = "event_id long, county_id string, begin_on date, industry string, x int, " + ", ".join(f"{c} long" for c in names)
    rows = [(1, None, None, None, 7, 1, 0, 0, 0, 0, 0, 0, 0, 3)] * 2
    got = I.spread_windows(spark.createDataFrame(rows, schema), (), ("x",)).select("window_num", "post_exits", "excess_exits", "x").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1.0, 7)] * 2 + [(3, 0, -1.5, 7)] * 2


def test_the_size_of_methods_is_set_unless_the_session_has_its_own(spark):
    name = "spark.sql.codegen.hugeMethodLimit"
    kept = spark.conf.get(name)
    try:
        for given, want in (("65535", "8000"), ("9000", "9000")):
            spark.conf.set(name, given)
            compiled(spark)
            assert spark.conf.get(name) == want
    finally:
        spark.conf.set(name, kept)
