"""The small sides of TF-IDF are stored, so their size is known where they join."""

import os

from shockspan.operators import latent
from shockspan.session import shared_folder


def test_small_sides_are_stored(spark):
    folder = shared_folder(spark)
    before = set(os.listdir(folder))
    rows = latent.tfidf(spark.createDataFrame([(1, "a b b"), (2, "a"), (2, "c"), (3, None)], "id long, t string"), "id", "t").collect()
    new = {d.rsplit("-", 1)[0] for d in set(os.listdir(folder)) - before}
    assert {"idf", "norm"} <= new
    assert sorted((r.key, r.word) for r in rows) == [(1, "a"), (1, "b"), (2, "a"), (2, "c")]
