"""Chunking, metadata, routing, retrieval and sources on hand-made cases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from shockspan.functions.columns import WHITESPACE
from shockspan.operators import narrative as N
from shockspan.operators import retrieval as R
from shockspan.operators import routing as Q
from shockspan.operators import text as X
from shockspan.sources import readers


def loop_chunks(text, size=800, overlap=100):
    text = text.strip()
    if len(text) <= size:
        return [text] if text else []
    out, start = [], 0
    while True:
        end = min(start + size, len(text))
        out.append(text[start:end])
        if end == len(text):
            return out
        start = end - overlap


def test_chunks_equal_the_loop(spark):
    body = "x𝔘ü\nabc " * 1000
    texts = ["", " \n", "short", WHITESPACE + body[:2000] + "." + WHITESPACE]
    texts += [body[: n - 1] + "." for n in (799, 800, 801, 900, 901, 1500, 1501, 2200, 6000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    got = {}
    for r in X.chunk_text(df, "doc", "text").orderBy("doc", "chunk").collect():
        assert r.id == f"{r.doc}_chunk_{r.chunk}"
        got.setdefault(r.doc, []).append(r.text)
    assert got == {i: loop_chunks(t) for i, t in enumerate(texts) if loop_chunks(t)}


def test_metadata_rules_first_match(spark):
    names = ["CA_unemployment.md", "fema_wildfire.md", "warn_act.md", "or_notes.md", "flood_recovery.md", "az_fema_tx_.md"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.name: (r.category, r.event_type, r.state) for r in X.infer_metadata(df, "name").collect()}
    assert got == {
        "CA_unemployment.md": ("unemployment", None, "CA"), "fema_wildfire.md": ("fema", "wildfire", None), "warn_act.md": ("warn_act", None, None),
        "or_notes.md": ("general", None, "OR"), "flood_recovery.md": ("recovery_timelines", "flood", None), "az_fema_tx_.md": ("fema", None, "AZ"),
    }


def test_upsert_last_write_wins(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, text string, seq int")
    assert {(r.id, r.text) for r in X.upsert_chunks(old, new, "id", "seq").collect()} == {(1, "a"), (2, "d"), (3, "e")}


@pytest.mark.parametrize("message,state,kind,intent,states,asked,asked_type", [
    ("Top 10 most at risk states", None, None, "top_risk", None, None, None),
    ("Where should we deploy resources?", None, None, "preposition", None, None, None),
    ("Our portfolio in the Gulf Coast after a flood", None, None, "portfolio", ["FL", "LA", "TX", "MS", "AL"], None, "flood"),
    ("portfolio of TX and FL, TX", None, None, "portfolio", ["TX", "FL"], None, "hurricane"),
    ("portfolio confidence?", None, None, "recovery_variance", None, None, None),
    ("Who benefits from disaster hiring", None, "flood", "demand_surge", None, None, "flood"),
    ("Which sector is hardest hit by wildfire near TX", None, None, "sector_ranking", None, "TX", "fire"),
    ("ranked, CA", "TX", None, "sector_ranking", None, "TX", None),
    ("Hello", None, None, "none", None, None, None),
])
def test_routing(spark, message, state, kind, intent, states, asked, asked_type):
    df = spark.createDataFrame([(message, state, kind)], "message string, state string, event_type string")
    r = Q.route_question(df).collect()[0]
    assert (r.intent, r.asked_states, r.asked_state, r.asked_type) == (intent, states, asked, asked_type)


def test_small_words_count_as_states_unless_case_matters(spark):
    df = spark.createDataFrame([("ok, help me in TX or fl",)], "m string")
    r = df.select(Q.states_in(F.col("m")).alias("a"), Q.states_in(F.col("m"), case_sensitive=True).alias("b")).collect()[0]
    assert r.a == ["OK", "ME", "IN", "TX", "OR", "FL"] and r.b == ["TX"]


@pytest.mark.parametrize("job,question,given,want", [
    ("", "", None, "unknown"), (None, None, None, "unknown"), ("Actuary", "x", None, "insurer"), ("", "our portfolio", None, "investor"),
    ("city planner", "", None, "policymaker"), ("HR lead", "", None, "employer"), ("cook", "help", None, "worker"),
    ("cook", "", "investor", "investor"), ("cook", "", "pirate", "worker"),
])
def test_audience(spark, job, question, given, want):
    df = spark.createDataFrame([(job, question, given)], "j string, q string, g string")
    assert df.select(Q.audience(F.col("j"), F.col("q"), F.col("g"))).collect()[0][0] == want


def test_topk_equals_brute_force_with_copies(spark, monkeypatch):
    monkeypatch.setattr(R, "QUERIES", 3)
    rng = np.random.default_rng(7)
    base = rng.normal(size=(60, 8)).astype(np.float32)
    vectors = np.vstack([base, np.repeat(base[:1], 40, axis=0)])  # a third are copies
    cats = ["general", "fema", "cobra", "unemployment"]
    chunks = [(i, cats[i % 4], ["CA", "TX", None][i % 3], ["fire", "flood"][i % 2], v.tolist()) for i, v in enumerate(vectors)]
    queries = [(q, *scope, base[q].tolist()) for q, scope in enumerate([("CA", "fire"), ("TX", None), (None, "flood"), (None, None), ("", ""), ("CA", None), (None, None)])]
    c = spark.createDataFrame(chunks, "id int, category string, state string, event_type string, embedding array<float>").repartition(5)
    q = spark.createDataFrame(queries, "query_id int, state string, event_type string, embedding array<float>")
    got = {(r.query_id, r["rank"]): (r.id, r.similarity) for r in R.topk_cosine(c, q, 4).collect()}
    want = {}
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    for qid, state, kind, v in queries:
        general = R.STATE_AND_TYPE if state and kind else R.STATE_ONLY if state else R.TYPE_ONLY
        v = np.asarray(v) / np.linalg.norm(v)
        rows = [
            (-round(float(unit[i] @ v), 9), i) for i, cat, s, e, _ in chunks
            if not (state or kind) or cat in general or (state and s == state) or (kind and e == kind)
        ]
        for rank, (sim, i) in enumerate(sorted(rows)[:4], 1):
            want[(qid, rank)] = (i, round(-sim, 4))
    assert got == want


def test_read_nested_files(spark, tmp_path):
    people = [{"jobs": [{"title": "a", "ended_at": "2001-01-01", "location_details": None}]}, {}]
    (tmp_path / "p.json").write_text(json.dumps(people))
    assert readers.read_persons(spark, str(tmp_path / "p.json"), one_array=True).count() == 2
    preds = [{"id": "x", "event_type": "fire", "county_id": "06037", "predictions": {"Tech": {"job_loss_pct": 5}, "Legal": {"job_change_pct": 2, "peak_month": 9}}}]
    (tmp_path / "m.json").write_text(json.dumps(preds))
    states = spark.createDataFrame([("06", "CA")], "prefix string, state string")
    rows = readers.read_predictions(spark, str(tmp_path / "m.json"), states, one_array=True).orderBy("sector").collect()
    assert [(r.sector, r.state, r.region, r.job_loss_pct, r.peak_month) for r in rows] == [("Legal", "CA", "06037", None, 9), ("Tech", "CA", "06037", 5.0, None)]
    fc = {"OK_Severe_Storm": {"forecast": {"predicted_counts": [1.0] * 12 + [99.0]}, "model_info": {"total_historical": 7, "peak_months": ["May"]}}, "bad": {}, "FL_Fire": {}}
    (tmp_path / "f.json").write_text(json.dumps(fc, indent=1))
    rows = {r.event_type: r for r in readers.read_forecasts(spark, str(tmp_path / "f.json"), one_object=True).collect()}
    assert rows["severe_storm"].avg_next_12 == 1.0 and rows["severe_storm"].state == "OK" and rows["fire"].total_historical == 0 and len(rows) == 2


def test_read_documents_and_optional(spark, tmp_path):
    (tmp_path / "a.md").write_text("\n text é \n")
    (tmp_path / "b.md").write_text("  \n")
    (tmp_path / "c.txt").write_text("no")
    assert [(r.name, r.text) for r in readers.read_documents(spark, str(tmp_path)).collect()] == [("a.md", "text é")]
    schema = spark.range(1).schema
    spark.range(3).write.parquet(str(tmp_path / "t"))
    assert readers.read_optional(spark, [str(tmp_path / "no"), str(tmp_path / "t")], schema).count() == 3
    assert readers.read_optional(spark, [str(tmp_path / "no")], schema).count() == 0


def test_risk_windows(spark):
    df = spark.createDataFrame([(["December", "January"],), (["May"],), ([],), (["August", "June", "July"],)], "p array<string>")
    rows = df.select(N.risk_window(F.col("p")).alias("a"), N.circular_window(F.col("p")).alias("b"), N.season_sentence(F.col("p")).alias("c")).collect()
    assert [r.a for r in rows] == ["January–December", "May", "year-round with no strong seasonal peak", "June–August"]
    assert [r.b for r in rows] == ["December–January", "May", "year-round with no strong seasonal peak", "June–August"]
    assert rows[0].c == "Activity peaks in December and January" and rows[3].c == "Activity peaks in August, June, and July"
