"""Cells of the index are found in pieces of bounded size."""

import numpy as np
import pytest

from shockspan.operators import index


@pytest.mark.parametrize("products", [1, 50, 1 << 19])
def test_nearest_cells_in_pieces(spark, monkeypatch, products):
    monkeypatch.setattr(index, "PRODUCTS", products)
    rng = np.random.default_rng(3)
    x, centres = rng.normal(size=(40, 4)), rng.normal(size=(7, 4))
    df = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, embedding array<double>")
    got = {r.id: r.c for r in index.nearest_cells(df, "embedding", centres, 3, "c").collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got == {i: list(np.argsort(-np.round(unit[i] @ centres.T, 12), kind="stable")[:3]) for i in range(40)}
