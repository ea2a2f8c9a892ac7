"""Dimension-sharded clustering against plain integers."""

import hashlib
import math
import random

import pytest

from shockspan.llm import centroids, queries


def brute(rows, dims=64, k=8, rounds=10, scale=1024, seed=3):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * x) for x in v]))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]

    def nearest(v):
        far = [sum((a - b) ** 2 for a, b in zip(v, row, strict=True)) for row in c]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        near = [nearest(v)[0] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), n in zip(kept, near, strict=True) if n == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [nearest(v) for _, v in kept]
    told = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c]
    total = sum(d for _, d in last)
    long = lambda x: x if x < 2**63 else None
    own = [sum(d for n, d in last if n == j) for j in range(len(c))]
    return sorted(((i, n, long(d), long(own[n]) if all(e < 2**63 for m, e in last if m == n) else None, long(total) if all(e < 2**63 for _, e in last) else None, told[n]) for (i, _), (n, d) in zip(kept, last, strict=True)), key=str)


def vectors(n, dims=64, spread=1.0):
    rng = random.Random(9)
    heads = [[rng.uniform(-spread, spread) for _ in range(dims)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.3 * spread) for x in rng.choice(heads)]) for i in range(n)]
    bad = list(rows[0][1])
    rows += [(500 + j, rows[3][1]) for j in range(40)]  # one vector many times
    rows += [(None, rows[2][1]), (7, rows[7][1]), (7, rows[8][1]), (900, None), (901, []), (902, bad[:-1]), (903, bad + [0.0])]
    rows += [(904, [None, *bad[1:]]), (905, [math.nan, *bad[1:]]), (906, [math.inf, *bad[1:]]), (907, [-math.inf, *bad[1:]])]
    return rows


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def frame(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int, block string").repartition(4)


@pytest.mark.parametrize("width", [1, 16, 24, 64])
def test_equal_to_plain_integers(spark, width):
    rows = vectors(120)
    assert result(centroids.clustered(frame(spark, rows), width=width)) == brute(rows)


def test_chunks_do_not_matter(spark, monkeypatch):
    rows = vectors(60)
    monkeypatch.setattr(centroids, "CHUNK", 7)
    assert result(centroids.clustered(frame(spark, rows), k=3, rounds=4, seed=8)) == brute(rows, k=3, rounds=4, seed=8)


@pytest.mark.parametrize("spread", [1e5, 1e7, 1e17, 1e300])
def test_numbers_beyond_longs(spark, spread):
    rows = vectors(20, dims=4, spread=spread)
    got = result(centroids.clustered(frame(spark, rows), dims=4, k=3, rounds=3, width=3))
    assert got == brute(rows, dims=4, k=3, rounds=3)


def test_few_and_no_vectors(spark, tmp_path):
    few = [(1, [0.5] * 64), (2, [-0.5] * 64), (2, [-0.5] * 64), (3, None)]
    assert result(centroids.clustered(frame(spark, few))) == brute(few)
    assert result(centroids.clustered(frame(spark, [(3, None)]))) == []
    frame(spark, []).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.op12_centroids(spark, str(tmp_path)).count() == 0


def test_ties_go_to_the_smaller_centroid(spark):
    rows = [(i, [float(i % 3)]) for i in range(30)]
    assert result(centroids.clustered(frame(spark, rows), dims=1, k=8, rounds=2, scale=1)) == brute(rows, dims=1, k=8, rounds=2, scale=1)
