"""TF-IDF and the truncated SVD against NumPy."""

import math
from collections import Counter

import numpy as np
import pytest

from shockspan.operators import latent as L

TOPICS = ["storm flood water rain wind", "bank loan credit rate money", "goal match team ball coach"]


def texts():
    rng = np.random.default_rng(4)
    rows = []
    for i in range(90):
        own, other = TOPICS[i % 3].split(), [w for t in TOPICS for w in t.split()]
        words = [*rng.choice(own, 12), *rng.choice(other, 2), "the", "the", f"w{rng.integers(0, 40)}"]
        rows.append((i, " ".join(words)))
    return [*rows, (90, None), (91, ""), (92, " \t"), (93, "THE the\x0bThe")]


def matrix(rows):
    counts = {i: Counter((t or "").lower().split()) for i, t in rows}
    counts = {i: c for i, c in counts.items() if c}
    held = Counter(w for c in counts.values() for w in c)
    names, ids = sorted(held), sorted(counts)
    a = np.array([[counts[i][w] * (math.log((1 + len(ids)) / (1 + held[w])) + 1) for w in names] for i in ids])
    return ids, names, a / np.linalg.norm(a, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def weights(spark):
    return L.tfidf(spark.createDataFrame(texts(), "id long, body string").repartition(3), "id", "body").cache()


def test_weights_equal_numpy(weights):
    ids, names, a = matrix(texts())
    got = {(r.key, r.word): r.w for r in weights.collect()}
    want = {(i, w): a[r, c] for r, i in enumerate(ids) for c, w in enumerate(names) if a[r, c]}
    assert got.keys() == want.keys() and [got[k] for k in want] == pytest.approx(list(want.values()))


def test_space_equals_numpy(weights):
    ids, names, a = matrix(texts())
    _, values, v = np.linalg.svd(a, full_matrices=False)
    space = L.fitted(weights, 3, rounds=6)
    assert space.values == pytest.approx(values[:3], rel=1e-6)
    got = {r.word: [r.c0, r.c1, r.c2] for r in space.words.collect()}
    mine = np.array([got[w] for w in names])
    assert mine @ mine.T == pytest.approx(v[:3].T @ v[:3], abs=1e-4)
    rows = {r.key: np.array(r.embedding) for r in space.embedded(weights).collect()}
    assert set(rows) == set(ids)
    x = np.array([rows[i] for i in range(90)])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.argsort(-(x @ x.T), axis=1)[:, 1]
    assert np.mean(near % 3 == np.arange(90) % 3) > 0.9  # texts of a topic lie together


def test_small_rank_and_no_texts(spark):
    few = L.tfidf(spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "id long, t string"), "id", "t")
    assert L.fitted(few, 5).size == 2
    none = L.tfidf(spark.createDataFrame([(1, None)], "id long, t string"), "id", "t")
    assert L.fitted(none, 5).size == 0 and none.count() == 0
