"""Approximate top-k by cosine similarity through coarse cells, re-ranked exactly.

Centres of cells are fitted by k-means over unit vectors on a bounded sample; every row
of the table is in the index, in the cell of its nearest centre. A question looks into
its ``probes`` nearest cells only and compares itself exactly with what passes its
filter there. Rows of a cell are dealt into shares of about ``SHARE`` rows, so a cell
with a third of all rows is many files of bounded size; questions with the same nearest
cell come in lots of about ``LOT``. Rows are written once, a file per share; a lot's task
reads the shares of the cells it probes one by one, so vectors are copied for no cell and
no task holds more than a lot and a share. The driver holds the centres, cells times
dimensions numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from shockspan.operators.retrieval import best_of, compare, read_file, topk_cosine
from shockspan.session import folder_address, scratch_path, shared_folder, shuffles_go, stored

#: Vectors that the centres are fitted on, at most, about; every row is indexed.
SAMPLE = 100_000
SHARE, LOT = 32_768, 4096
#: Products of rows and centres that a task holds at a time, whatever the number of cells.
PRODUCTS = 1 << 19


@dataclass
class Index:
    """``rows`` with their ``cell`` and ``share``, and the centres, one unit row each."""

    rows: DataFrame
    shares: DataFrame
    centres: np.ndarray
    vector: str


def unit(vector: str) -> Column:
    """The vector at length 1; a zero vector stays."""
    v = F.col(vector).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def nearest_cells(df: DataFrame, vector: str, centres: np.ndarray, n: int, out: str) -> DataFrame:
    """The ``n`` nearest centres of every row, nearest first; ties go to the lower cell."""
    names = [f.name for f in df.schema]
    step = max(1, PRODUCTS // max(1, len(centres)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(vector).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = flat.reshape(batch.num_rows, -1)
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            near = np.empty((len(x), min(n, len(centres))), np.int32)
            for i in range(0, len(x), step):
                near[i : i + step] = np.argsort(-np.round(x[i : i + step] @ centres.T, 12), axis=1, kind="stable")[:, :n]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, near.shape[1]), pa.int32()), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], lists], names=[*names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def built(chunks: DataFrame, cells: int | None = None, vector: str = "embedding", seed: int = 42) -> Index:
    """An index over every chunk that has a vector: id, category, state, event_type and the vector.

    ``cells`` is the square root of the rows where it is not given.
    """
    rows = stored(chunks.select("id", "category", "state", "event_type", vector).filter(F.col(vector).isNotNull()), "vectors")
    n = rows.count()
    cells = cells or max(1, int(n**0.5))
    sample = rows.select(array_to_vector(unit(vector)).alias("features"))
    if n > SAMPLE:
        sample = sample.sample(SAMPLE / n, seed)
    sample = stored(sample.distinct(), "sample")
    cells = min(cells, sample.count())
    centres = np.zeros((cells, 1))
    if cells > 1:
        centres = np.array(KMeans(k=cells, seed=seed, maxIter=15).fit(sample).clusterCenters())
        centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
    elif cells:
        centres = np.array([sample.first()["features"].toArray()])
    placed = nearest_cells(rows, vector, centres, 1, "_cells") if n else rows.withColumn("_cells", F.array().cast("array<int>"))
    placed = stored(placed.withColumn("cell", F.try_element_at("_cells", F.lit(1))).drop("_cells"), "placed")
    shares = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("shares"))
    shares = stored(shares, "shares")
    dealt = placed.join(shares, "cell").withColumn("share", F.pmod(F.xxhash64("id"), "shares").cast("int")).drop("shares")
    return Index(dealt, shares, centres, vector)


def probes_for(index: Index, queries: DataFrame, k: int = 6, target: float = 0.95, sample: int = 256) -> int:
    """How many cells a question has to look into to find ``target`` of its exact hits.

    Measured on about ``sample`` of the questions, each against all rows: how far down
    the question's list of cells its hits' cells stand.
    """
    if not len(index.centres):
        return 1
    asked = queries.select("query_id", "state", "event_type", index.vector).filter(F.col(index.vector).isNotNull())
    asked = stored(asked.orderBy(F.xxhash64("query_id")).limit(sample), "calibration")
    hits = topk_cosine(index.rows, asked, k, index.vector).select("query_id", "id")
    order = nearest_cells(asked.select("query_id", index.vector), index.vector, index.centres, len(index.centres), "_cells")
    found = hits.join(index.rows.select("id", "cell"), "id").join(order.select("query_id", "_cells"), "query_id")
    places = found.groupBy(F.array_position("_cells", F.col("cell")).alias("p")).count().orderBy("p").collect()  # a row per cell at most
    whole, seen = sum(r["count"] for r in places), 0
    for r in places:
        seen += r["count"]
        if seen >= target * whole:
            return int(r["p"])
    return 1


def _probed(index: Index, asked: DataFrame, k: int, schema: str) -> DataFrame:
    """Questions of a nearest cell, in lots, read the files of the cells they probe; no vector is copied per cell."""
    spark = asked.sparkSession
    path = scratch_path(spark, "cells")
    with shuffles_go(spark):
        index.rows.repartition("cell", "share").write.partitionBy("cell", "share").parquet(path)
    address = folder_address(spark, path)
    asked = asked.withColumn("home", F.try_element_at("_cells", F.lit(1)))
    lots = stored(asked.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / LOT).cast("int").alias("lots")), "lots")
    dealt = asked.join(lots, "home").withColumn("lot", F.pmod(F.xxhash64("query_id"), "lots").cast("int")).drop("lots")
    met = compare(index.vector, k)

    def run(own: pa.Table) -> pa.Table:
        fs, root = FileSystem.from_uri(address)
        cells = own.column("_cells").combine_chunks()
        row, cell = cells.value_parent_indices().to_numpy(zero_copy_only=False), cells.flatten().to_numpy(zero_copy_only=False)
        best = None
        for c in np.unique(cell).tolist():
            mine = own.take(pa.array(row[cell == c]))
            for part in fs.get_file_info(FileSelector(f"{root}/cell={c}", allow_not_found=True, recursive=True)):
                if part.base_name.endswith(".parquet"):
                    found = met(mine, read_file(fs, part.path))
                    best = best_of(found if best is None else pa.concat_tables([best, found]), k)
        if best is None:
            best = pa.table({"query_id": own.column("query_id").slice(0, 0), "id": pa.array([], id_type), "sim": pa.array([], pa.float64())})
        return best

    id_type = to_arrow_type(index.rows.schema["id"].dataType)
    return dealt.groupBy("home", "lot").applyInArrow(run, schema)


def _copied(index: Index, asked: DataFrame, k: int, schema: str) -> DataFrame:
    """The same where tasks can't read the shared folder: questions go to each share that they probe."""
    asked = asked.withColumn("cell", F.explode("_cells")).drop("_cells")
    lots = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / LOT).cast("int").alias("lots"))
    lots = stored(lots, "lots")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(lots, "cell").join(index.shares, "cell").withColumn("lot", F.pmod(F.xxhash64("query_id"), "lots").cast("int"))
    left = left.withColumn("share", every("shares")).drop("lots", "shares")
    right = index.rows.join(lots, "cell").withColumn("lot", every("lots")).drop("lots")
    key = ["cell", "share", "lot"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare(index.vector, k), schema)


def search(index: Index, queries: DataFrame, k: int = 6, probes: int = 8) -> DataFrame:
    """query_id, id, similarity, rank: the k best chunks in the probed cells under each query's filter."""
    asked = queries.select("query_id", "state", "event_type", index.vector).filter(F.col(index.vector).isNotNull())
    types = {f.name: f.dataType.simpleString() for f in (*index.rows.schema, *asked.schema)}
    schema = f"query_id {types['query_id']}, id {types['id']}, sim double"
    if not len(index.centres):
        return queries.sparkSession.createDataFrame([], schema.replace("sim", "similarity") + ", rank int")
    asked = stored(nearest_cells(asked, index.vector, index.centres, probes, "_cells"), "probes")  # vectors once, not once per cell
    found = _probed(index, asked, k, schema) if folder_address(queries.sparkSession, shared_folder(queries.sparkSession)) else _copied(index, asked, k, schema)
    order = W.partitionBy("query_id").orderBy(F.desc("sim"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "id", F.round("sim", 4).alias("similarity"), "rank")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """n_exact, n_found and recall: the share of the exact hits that were found."""
    both = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return both.agg(F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("n_found")).withColumn("recall", F.try_divide("n_found", "n_exact"))
