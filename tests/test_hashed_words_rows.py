"""Counts of words are made where a row is; only numbers meet by key."""

import hashlib

from shockspan.operators import text as X


def slots(*words):
    out = [0.0] * 8
    for w in words:
        out[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 8] += 1
    return out


def test_repeated_and_null_keys_add_up_without_a_row_per_word(spark):
    rows = [("k", "A a"), ("k", " É\tstorm\x0b"), ("k", None), (None, "x\u00a0y"), (None, "a"), ("n", None), ("e", " \n"), ("m", "")]
    df = spark.createDataFrame(rows, "id string, body string").repartition(3)
    out = X.hashed_words(df, "id", "body", size=8)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = [(r.id, list(r.embedding)) for r in out.collect()]
    assert len(got) == 5
    assert dict(got) == {"k": slots("a", "a", "é", "storm"), None: slots("x\u00a0y", "a"), "n": slots(), "e": slots(), "m": slots()}
    assert dict(out.dtypes)["embedding"] == "array<float>"
    assert X.hashed_words(df.filter("id = 'zz'"), "id", "body").count() == 0
