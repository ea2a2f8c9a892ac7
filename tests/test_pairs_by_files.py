"""All pairs are compared in tasks that read files: no side is copied per block of the other."""

import numpy as np
from pyspark.sql import functions as F

from shockspan.operators import index, retrieval


def test_all_pairs_are_compared_without_copies_per_block(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERIES", 16)
    monkeypatch.setattr(retrieval, "CHUNKS", 32)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 8))
    rows = [(i, "general", "CA" if i % 2 else "TX", "fire", x[i].tolist()) for i in range(200)]
    chunks = spark.createDataFrame(rows, "id long, category string, state string, event_type string, embedding array<double>")
    asked = chunks.select(F.col("id").alias("query_id"), F.lit(None).cast("string").alias("state"), F.lit(None).cast("string").alias("event_type"), "embedding")
    got = retrieval.topk_cosine(chunks, asked, 3)
    assert "FlatMapCoGroups" not in got._jdf.queryExecution().executedPlan().toString()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 9)
    want = {(q, int(i), n + 1) for q in range(200) for n, i in enumerate(np.lexsort((np.arange(200), -sims[q]))[:3])}
    assert {(r.query_id, r.id, r["rank"]) for r in got.collect()} == want


def test_probed_cells_are_read_and_questions_not_copied(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "general", "CA", "fire", v) for i, v in enumerate(rng.normal(size=(120, 4)).tolist())]
    chunks = spark.createDataFrame(rows, "id long, category string, state string, event_type string, embedding array<double>")
    none = F.lit(None).cast("string")
    asked = chunks.select(F.col("id").alias("query_id"), none.alias("state"), none.alias("event_type"), "embedding")
    found = index.search(index.built(chunks, 5), asked, 3, 5)  # every cell
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" not in plan and "Generate" not in plan
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, retrieval.topk_cosine(chunks, asked, 3).collect()))
