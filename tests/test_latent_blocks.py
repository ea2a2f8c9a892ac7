"""A fit is a pass per round over blocks of words, never a join by word, and any number of blocks gives the same space."""

import numpy as np
import pytest

from shockspan.operators import latent as L


def rows():
    rng = np.random.default_rng(8)
    return [(f"k{i}", f"w{j}", float(rng.random() + 0.1)) for i in range(60) for j in rng.choice(150, 12, replace=False)]


HELD = len({word for _, word, _ in rows()})


def space(spark):
    found = L.fitted(spark.createDataFrame(rows(), "key string, word string, w double"), 4)
    at = {r.word: [r.c0, r.c1, r.c2, r.c3] for r in found.words.collect()}
    return found.values, np.array([at[w] for w in sorted(at)])


def test_any_number_of_blocks_gives_the_same_space(spark, monkeypatch):
    values, words = space(spark)
    monkeypatch.setattr(L, "WEIGHTS", 40)
    monkeypatch.setattr(L, "AT_ONCE", 7)
    values_again, words_again = space(spark)
    assert values_again == pytest.approx(values) and words.shape == (HELD, 4)
    assert words_again @ words_again.T == pytest.approx(words @ words.T, abs=1e-9)


def test_the_fit_joins_texts_and_never_words(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("a product by a join of weights and vectors")

    monkeypatch.setattr(L, "times", refuse)
    assert space(spark)[1].shape == (HELD, 4)


def test_rows_without_key_or_word_take_no_part(spark):
    odd = [(None, "w1", 1.0), ("k1", None, 1.0)]
    schema = "key string, word string, w double"
    plain, more = (L.fitted(spark.createDataFrame(x, schema), 4) for x in (rows(), rows() + odd))
    assert more.values == pytest.approx(plain.values) and more.words.count() == plain.words.count() == HELD
