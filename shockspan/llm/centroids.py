"""Lloyd's clustering with the dimensions dealt out to shards, in exact integers.

Vectors become integers, ``floor(scale * x)``, and are written once as chunks of rows
times blocks of columns. In every round a task that holds a block of a chunk computes
the exact partial squared distances of its rows to that block of every centroid; the
partial sums of a chunk are added by key, the nearest centroid taken, and the
assignments go back to the chunk's blocks, where every shard sums its own columns per
cluster and so renews its own slice of the centroids. Chunks are cut as rows are read,
not by value, so a vector that stands a million times overloads no task. What the driver
holds and sends is the centroids, clusters times dimensions numbers. Every round reads
the written blocks, so a lost executor costs a part of one round.

Numbers are 64-bit where the largest component leaves no squared distance above 2^62,
and Python's own integers beyond, with the same results. A distance or sum that no long
holds is null.

Defined cases: a vector that is null, has another number of components, or a null or
non-finite one is not clustered; a null id is kept, its hash is that of the empty text
after the colon; repeated rows count each; equal hashes go to the smaller vector; fewer
vectors than clusters give as many clusters as vectors; no vectors give no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockspan.llm.common import named
from shockspan.session import scratch_path, stored

#: Rows of a chunk; a chunk's block has this many rows times ``width`` columns.
CHUNK = 2048


def to_bytes(a: np.ndarray) -> bytes:
    """Integers in the narrowest form that holds them all; the first byte tells which."""
    if a.dtype == object:
        return b"\0" + pickle.dumps(a.tolist())
    most = max(-int(a.min()), int(a.max())) if a.size else 0
    kind = next(t for t in ("<i2", "<i4", "<i8") if most <= np.iinfo(t).max)
    return np.dtype(kind).itemsize.to_bytes(1, "little") + a.astype(kind).tobytes()


def from_bytes(raw: bytes, width: int) -> np.ndarray:
    """Rows of ``width`` integers."""
    if raw[0] == 0:
        return np.array(pickle.loads(raw[1:]), object).reshape(-1, width)
    return np.frombuffer(raw, f"<i{raw[0]}", offset=1).astype(np.int64).reshape(-1, width)


def integers(x: np.ndarray, scale: float, wide: bool) -> np.ndarray:
    floors = np.floor(x * scale)
    return np.array([int(v) for v in floors.ravel()], object).reshape(x.shape) if wide else floors.astype(np.int64)


def _cut(dims: int, width: int, scale: float, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
                x = integers(flat.reshape(-1, dims), scale, wide)
                ids = pa.array([batch.column("id").to_pylist()] + [None] * (len(range(0, dims, width)) - 1), pa.list_(pa.int64()))
                raw = [to_bytes(x[:, a : a + width]) for a in range(0, dims, width)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * len(raw)), pa.array(range(len(raw)), pa.int32()), ids, pa.array(raw, pa.binary())],
                    names=["chunk", "block", "ids", "x"],
                )
                chunk += 1

    return run


def _partial(centroids: np.ndarray, width: int):
    """Squared distances of a block's rows to the same columns of every centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, block, raw in zip(*(batch.column(c).to_pylist() for c in ("chunk", "block", "x")), strict=True):
                c = centroids[:, block * width : (block + 1) * width]
                x = from_bytes(raw, c.shape[1])
                out = np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([to_bytes(out)], pa.binary())], names=["chunk", "part"])

    return run


def _nearest(k: int):
    def run(group: pa.Table) -> pa.Table:
        total = sum(from_bytes(raw, k) for raw in group.column("part").to_pylist())
        near = np.argmin(total, axis=1)  # the first of equal ones
        least = total[np.arange(len(near)), near][:, None]
        return pa.table(
            {
                "chunk": group.column("chunk").slice(0, 1).combine_chunks(),
                "near": pa.array([near.astype(np.int32).tolist()], pa.list_(pa.int32())), "least": pa.array([to_bytes(least)], pa.binary()),
            }
        )

    return run


def _sums(k: int, dims: int, width: int, wide: bool):
    """One row per block that the task holds: sums of its columns per cluster, and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw, near in zip(*(batch.column(c).to_pylist() for c in ("block", "x", "near")), strict=True):
                w = min(width, dims - block * width)
                x = np.concatenate([from_bytes(raw, w), np.ones((len(near), 1), object if wide else np.int64)], axis=1)
                mine = held.setdefault(block, np.zeros((k, w + 1), x.dtype))
                np.add.at(mine, np.array(near), x)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([to_bytes(s) for s in held.values()], pa.binary())], names=["block", "sums"])

    return run


def _renewed(centroids: np.ndarray, width: int):
    """The new slice of a block's centroids; an empty cluster keeps its own."""

    def run(group: pa.Table) -> pa.Table:
        block = group.column("block")[0].as_py()
        slice_ = centroids[:, block * width : (block + 1) * width].astype(object)
        total = sum(from_bytes(raw, slice_.shape[1] + 1).astype(object) for raw in group.column("sums").to_pylist())
        for c, row in enumerate(total):
            if row[-1]:
                slice_[c] = [s // row[-1] for s in row[:-1]]
        return pa.table({"block": pa.array([block], pa.int32()), "slice": pa.array([b"\0" + pickle.dumps(slice_.tolist())], pa.binary())})

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, near, least in zip(*(batch.column(c).to_pylist() for c in ("ids", "near", "least")), strict=True):
            far = [d if d < 2**63 else None for d in from_bytes(least, 1)[:, 0].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(near, pa.int32()), pa.array(far, pa.int64())], names=["id", "cluster", "distance"])


def clustered(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, k: int = 8, rounds: int = 10,
    scale: float = 1024.0, seed: int = 3, width: int = 16,
) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector.

    The first centroids are the ``k`` vectors with the smallest sha256 of ``seed:id``;
    ``width`` columns make a shard.
    """
    v = named(vector_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.select(named(id_col).cast("long").alias("id"), v.alias("v")).filter((F.size("v") == dims) & ~bad)
    most = kept.select(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = kept.select("v").orderBy(key, "v").limit(k).collect() if most is not None else []
    wide = bool(most is not None and (most * scale + 1) * 2 > math.isqrt(2**62 // dims))
    centroids = np.concatenate([integers(np.array([r.v]), scale, wide) for r in first]) if first else np.zeros((0, dims), np.int64)
    k = len(centroids)
    path = scratch_path(vectors.sparkSession, "blocks")
    schema = "chunk long, block int, ids array<long>, x binary"
    # a folder of files per block of columns: its readers are the shard
    kept.filter(F.lit(bool(k))).mapInArrow(_cut(dims, width, scale, wide), schema).write.partitionBy("block").parquet(path)
    blocks = vectors.sparkSession.read.schema(schema).parquet(path)

    def assigned(now: np.ndarray) -> DataFrame:
        partial = blocks.select("chunk", "block", "x").mapInArrow(_partial(now, width), "chunk long, part binary")
        return partial.groupBy("chunk").applyInArrow(_nearest(k), "chunk long, near array<int>, least binary")

    for _ in range(rounds if k else 0):
        back = assigned(centroids).select("chunk", "near").join(blocks.select("chunk", "block", "x"), "chunk")
        sums = back.mapInArrow(_sums(k, dims, width, wide), "block int, sums binary")
        slices = sums.groupBy("block").applyInArrow(_renewed(centroids, width), "block int, slice binary").collect()
        new = [from_bytes(r.slice, min(width, dims - r.block * width)) for r in sorted(slices, key=lambda r: r.block)]
        centroids = np.concatenate(new, axis=1).astype(centroids.dtype)

    own = blocks.filter("block = 0").select("chunk", "ids")
    rows = stored(assigned(centroids).join(own, "chunk").mapInArrow(_rows, "id long, cluster int, distance long"), "assigned")
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count_if(F.col("distance").isNull()).alias("n")).collect()
    unknown = {r.cluster for r in sums if r.n}

    def text(total: int, known: bool) -> str | None:
        return str(total) if known and total < 2**63 else None

    inertia = text(sum(int(r.s or 0) for r in sums), not unknown)
    # one row per cluster, however many vectors there are
    told = [
        (r.cluster, text(int(r.s or 0), not r.n), hashlib.sha256(",".join(map(str, centroids[r.cluster].tolist())).encode()).hexdigest())
        for r in sums
    ]
    per_cluster = vectors.sparkSession.createDataFrame(told, "cluster int, s string, centroid_sha256 string")
    out = rows.join(F.broadcast(per_cluster), "cluster")
    return out.select(
        F.col("id").alias(id_col), "cluster", "distance", F.col("s").cast("long").alias("cluster_inertia"),
        F.lit(inertia).cast("long").alias("inertia"), "centroid_sha256",
    )
