"""Every registered query against its SQL, on the smallest tables."""

import compare
import pytest

import __spark_entry__ as entry
from shockspan.plans import catalog

FOLDER = "/root/testdata/sf0.001"
QUERIES = catalog.QUERIES
CHECKS = catalog.checks()
# Fits whose result SQL cannot repeat; test_models, test_boosting, test_index and test_latent cover them.
FITS = {
    "negbin_forecast", "additive_forecast", "compare_models", "cross_validate", "train_boosted", "feature_importance", "predicted_scenarios",
    "topk_index", "topk_latent",
}


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_sql(spark, con, name):
    assert compare.difference(QUERIES[name](spark, FOLDER), con, CHECKS[name]) is None


def test_everything_is_checked():
    assert set(QUERIES) - set(CHECKS) == FITS


def test_checks_give_plain_types(con):
    kinds = {row[1] for sql in CHECKS.values() for row in con.execute("DESCRIBE " + sql).fetchall()}
    assert kinds <= {"VARCHAR", "BIGINT", "INTEGER", "DOUBLE", "BOOLEAN", "TIMESTAMP"}


def test_entry_is_stable(spark):
    out = entry.entry(spark)
    assert out.columns == ["window_num", "event_type", "mean_excess", "n_rows"]
    assert out.count() > 0
