"""Classifiers: constructed cases, defined edge cases, held-out accuracy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shockspan.llm import language, quality, queries, toxicity
from shockspan.llm.common import sampled
from tests.llm.conftest import prose

FOLDER = "/root/testdata/sf0.01"


def joined(spark, out, label):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", label)
    return out.join(labels, "doc_id").toPandas()


def test_trees_separate_what_no_single_cut_does():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.3)).astype(float)
    model = quality.grown(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95


def test_flat_trees_equal_walking_them_one_by_one():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    model = quality.grown(x, (x.sum(1) > 0).astype(float), trees=7, depth=3)
    for row in range(20):
        raw = model.base
        for t in range(7):
            node = 0
            while node < model.feature.shape[1]:
                node = 2 * node + 1 + bool(x[row, model.feature[t, node]] > model.threshold[t, node])
            raw += model.value[t, node - model.feature.shape[1]]
        assert abs(model.score(x[row : row + 1])[0] - 1 / (1 + np.exp(-raw))) < 1e-12


def test_trees_of_one_class_or_none():
    x = np.zeros((3, 2))
    assert (quality.grown(x, np.ones(3)).score(x) > 0.99).all()
    assert (quality.grown(x, np.zeros(3)).score(x) < 0.01).all()
    assert (quality.grown(x[:0], np.zeros(0)).score(x) == 0.5).all()


def test_quality_of_held_out_documents(spark):
    got = joined(spark, queries.op2_quality(spark, FOLDER), "quality")
    held = got[got.held_out]
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.94
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    got = queries.op4_language(spark, FOLDER).join(docs, "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 150 and (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_toxicity_of_held_out_documents(spark):
    got = joined(spark, queries.op5_toxicity(spark, FOLDER), "toxic")
    held = got[got.held_out]
    assert len(held) > 90 and (held.predicted == held.toxic).mean() > 0.92
    assert (got.predicted == (got.score >= 0.7)).all()


def test_held_out_labels_are_never_learnt(spark):
    """Turning them round changes no score."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").limit(300)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    for op, name, folds, held in ((quality, "quality", 5, 0), (toxicity, "toxic", 3, 1)):
        own = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held
        turned = labels.withColumn(name, F.when(own, 1 - F.col(name)).otherwise(F.col(name)))
        a, b = (sorted((r.doc_id, r.score) for r in op.scored(docs, x).collect()) for x in (labels, turned))
        assert a == b


CASES = [(1, None, "x"), (2, "", "y"), (None, "!!! 123 --", "z"), (2, "ein Wort und noch eines", "y"), (3, "w " * 40_000, "q")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(CASES, "doc_id long, text string, score string")


def test_classifiers_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.scored(odd, none).collect()
    assert {r.score for r in rows} == {0.5} and len(rows) == len(CASES)
    rows = toxicity.scored(odd, none).collect()
    assert len(rows) == len(CASES) and all(r.score < 0.5 and r.predicted == 0 for r in rows)
    rows = language.identified(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}


def test_classifiers_with_null_and_repeated_labels(spark, odd):
    labels = spark.createDataFrame([(1, 1, None), (2, None, 1), (2, 0, 0), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.scored(odd, labels).count() == len(CASES)
    assert toxicity.scored(odd, labels).count() == len(CASES)


def test_empty_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.scored(none, labels).count() == toxicity.scored(none, labels).count() == language.identified(none).count() == 0


def test_texts_without_letters_are_undetermined(spark, odd):
    got = {(r.doc_id, r.text and r.text[:5]): r for r in language.identified(odd.withColumn("lang", F.when(F.col("doc_id") == 2, "de"))).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in [(1, None), (2, ""), (None, "!!! 1")])


def test_two_steps_of_language():
    rng = random.Random(4)
    alphabets = {"en": "abcdef", "de": "abcdeg", "fr": "uvwxyz", "es": "uvwxys", "xx": "mnopqr"}

    def text(code):
        return " ".join("".join(rng.choice(alphabets[code]) for _ in range(5)) for _ in range(40))

    train = [(c, text(c)) for c in alphabets for _ in range(30)]
    model = language.trained(np.stack([language.grams(t) for _, t in train]), [c for c, _ in train])
    assert sorted(map(sorted, model.families)) == [["de", "en"], ["es", "fr"], ["xx"]]
    test = [(c, text(c)) for c in alphabets for _ in range(20)]
    got = model.predict(np.stack([language.grams(t) for _, t in test]))
    assert np.mean([c == g for (c, _), (g, _) in zip(test, got, strict=True)]) > 0.95


def summed(x, label):
    """The label model's counts over rows held here."""

    def measure(beliefs):
        share = beliefs.share(x, label) if beliefs else np.where(label == 1, toxicity.SURE, 1 - toxicity.SURE)
        known = label >= (-1 if beliefs else 0)
        rows, s = x[known], share[known]
        return toxicity.Sums(np.array([len(rows), s.sum(), (s * s).sum()]), np.stack([rows.sum(0), rows.T @ s], 1))

    return measure


def made_votes(seed=3, n=4000):
    rng = np.random.default_rng(seed)
    y = rng.random(n) < 0.3
    good = np.where(y, rng.random(n) < 0.8, rng.random(n) < 0.05)
    other = np.where(y, rng.random(n) < 0.7, rng.random(n) < 0.1)
    noise = rng.random(n) < 0.3
    x = np.stack([good, good, other, noise], 1).astype(float)
    return x, y, np.where(rng.random(n) < 0.1, y, -1)


PRIOR = np.array([[0.05] * 4, [0.5] * 4])


def test_label_model_finds_accuracies_and_ties():
    x, y, label = made_votes()
    got = toxicity.label_model(summed(x, label), x.T @ x, PRIOR, label[label >= 0].mean())
    assert ((got.share(x, label) > 0.5) == y).mean() > 0.9
    assert got.discount[0] < 0.7 and got.discount[1] < 0.7 and got.discount[2] > 0.6
    assert np.abs(got.chance[:, 2] - [0.1, 0.7]).max() < 0.1
    alone = toxicity.label_model(summed(x, label * 0 - 1), x.T @ x, PRIOR, None)
    assert ((alone.share(x, label * 0 - 1) > 0.5) == y).mean() > 0.85


def test_label_model_counts_every_document_in_spark(spark):
    x, _, label = made_votes(n=1500)
    rows = [(np.flatnonzero(v)[::-1].tolist(), int(k) if k >= 0 else None) for v, k in zip(x, label, strict=True)]
    patterns = toxicity.vote_patterns(spark.createDataFrame(rows, "fired array<int>, label int")).cache()
    together = toxicity.fired_together(patterns, 4)
    assert (together == x.T @ x).all()
    base = label[label >= 0].mean()
    want = toxicity.label_model(summed(x, label), x.T @ x, PRIOR, base, rounds=4)
    got = toxicity.label_model(toxicity.pattern_sums(patterns, 4), together, PRIOR, base, rounds=4)
    assert np.allclose(got.chance, want.chance, atol=1e-7) and np.allclose(got.discount, want.discount, atol=1e-6)


def test_sampled_classes_weigh_what_they_stand_for():
    label = np.array([0] * 50 + [1] * 50)
    weight = toxicity.class_weights(label, {0: 900, 1: 100})
    assert np.isclose(weight.mean(), 1) and np.isclose(weight[0] / weight[-1], 9)
    assert (toxicity.class_weights(np.array([1, 1]), {1: 2}) == 1).all() and not len(toxicity.class_weights(np.zeros(0), {}))
    offset = toxicity.classifier(np.zeros((100, 1)), label.astype(float), weight)[-1]
    assert np.isclose(1 / (1 + np.exp(-offset)), 0.1, atol=0.01)


def test_a_smaller_sample_keeps_the_level_of_scores(spark):
    """The bound of the sample cuts one class more than the other; scores of clean texts stay near."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    shares = []
    for most in (8_000, 90):
        model = toxicity.fitted(docs, labels, toxicity.learnable(), labelled=most)
        shares.append(docs.select(toxicity.score(model, F.col("text")).alias("s")).agg(F.avg((F.col("s") >= 0.7).cast("int"))).first()[0])
    assert abs(shares[0] - shares[1]) < 0.04


def test_mined_voters_need_little_overlap():
    fired = [[10, 11, 12]] * 6 + [[10]] * 4 + [[0, 13]] * 9 + [[14]] * 5
    got = toxicity.chosen_voters(fired, 10)
    assert got[0] == 10 and 14 in got and 13 not in got


def test_insults_count_wherever_they_stand(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, 60) + (" idiot" if i % 2 else "")) for i in range(200)]
    rows += [(1000, prose(rng, 3000) + " You are an IDIOT*** " + prose(rng, 3000)), (1001, prose(rng, 6000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.scored(docs, labels).collect()}
    assert got == {i: (i % 2 if i < 200 else 1 if i == 1000 else 0) for i, _ in rows}


def test_samples_are_bounded_and_fair(spark):
    rows = spark.range(20000).withColumn("g", F.when(F.col("id") < 100, "few").when(F.col("id") < 110, None).otherwise("many"))
    got = {r.g: r["count"] for r in sampled(rows, F.col("id"), 1000, F.col("g")).groupBy("g").count().collect()}
    assert got["few"] == 100 and got[None] == 10 and 750 < got["many"] < 1050
