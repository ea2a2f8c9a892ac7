"""The vector index against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shockspan.operators import index as IX
from shockspan.operators import retrieval as R


def chunks(spark, n=600, dims=12, seed=1):
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(20, dims))
    x = heads[rng.integers(0, 20, n)] + 0.4 * rng.normal(size=(n, dims))
    x[:200] = x[0]  # a third of all rows is one vector
    rows = [(i, "general" if i % 3 else "cobra", ["CA", "TX", None][i % 3], ["fire", None][i % 2], list(map(float, v))) for i, v in enumerate(x)]
    rows += [(9000, "general", "CA", "fire", None), (9001, "general", "CA", "fire", [0.0] * dims)]
    return spark.createDataFrame(rows, "id long, category string, state string, event_type string, embedding array<double>").repartition(4)


def asked(df):
    i = F.col("id")
    return df.select(i.alias("query_id"), F.when(i % 2 == 0, F.lit("CA")).alias("state"), F.when(i % 5 == 0, F.lit("fire")).alias("event_type"), "embedding")


def test_every_row_is_indexed_once(spark):
    df = chunks(spark)
    index = IX.built(df, 15)
    assert sorted(r.id for r in index.rows.select("id").collect()) == sorted(r.id for r in df.filter("embedding IS NOT NULL").select("id").collect())


def test_all_probes_are_the_exact_search(spark, monkeypatch):
    df = chunks(spark)
    exact = sorted(map(tuple, R.topk_cosine(df, asked(df), 4).collect()))
    monkeypatch.setattr(IX, "SHARE", 37)  # the hot cell is many shares
    monkeypatch.setattr(IX, "LOT", 29)
    index = IX.built(df, 15)
    assert index.shares.agg(F.max("shares")).first()[0] > 4
    assert sorted(map(tuple, IX.search(index, asked(df), 4, 15).collect())) == exact


def test_few_probes_find_most(spark):
    df = chunks(spark, 800)
    index = IX.built(df, 24)
    exact = R.topk_cosine(df, asked(df), 4)
    probes = IX.probes_for(index, asked(df), 4)
    assert probes < 15
    got = IX.recall(IX.search(index, asked(df), 4, probes), exact).first()
    assert 0.9 <= got.recall <= 1 and got.n_exact == exact.count()


def test_small_and_empty_tables(spark):
    df = chunks(spark).filter("id < 2")
    assert IX.search(IX.built(df), asked(df), 3).count() == R.topk_cosine(df, asked(df), 3).count()
    none = df.filter("id < 0")
    assert IX.search(IX.built(none), asked(df), 3).count() == 0
    assert IX.recall(IX.search(IX.built(none), asked(none), 3), R.topk_cosine(none, asked(none), 3)).first().recall is None
