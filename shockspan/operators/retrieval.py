"""Filtered top-k by cosine similarity, and the text of the hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shockspan.functions import phrases as T
from shockspan.session import folder_address, scratch_path, shared_folder, shuffles_go, stored

# Categories that pass whatever the state or type, per filter mode.
STATE_AND_TYPE = ["model_output", "forecast", "fema", "warn_act", "cobra", "retraining", "recovery_timelines", "transferable_skills"]
STATE_ONLY = ["warn_act", "cobra", "retraining", "recovery_timelines", "transferable_skills"]
TYPE_ONLY = ["model_output", "forecast", "fema", "recovery_timelines", "transferable_skills"]

#: Questions and chunks that meet in one task, about, and questions compared at a time.
QUERIES, CHUNKS, AT_ONCE = 4096, 32_768, 128


def allowed(chunk: dict[str, np.ndarray], state: str | None, event_type: str | None) -> np.ndarray | None:
    """Rows a query may see: its state, its type, or a general category."""
    if not state and not event_type:
        return None
    general = STATE_AND_TYPE if state and event_type else STATE_ONLY if state else TYPE_ONLY
    ok = np.isin(chunk["category"], general)
    if state:
        ok |= chunk["state"] == state
    if event_type:
        ok |= chunk["event_type"] == event_type
    return ok


def best_rows(sims: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k most similar rows; ties go to the smaller id."""
    if len(sims) > k:
        cut = np.partition(sims, len(sims) - k)[len(sims) - k]
        near = np.flatnonzero(sims >= cut)
    else:
        near = np.arange(len(sims))
    return near[np.lexsort((ids[near], -sims[near]))][:k]


def topk_cosine(chunks: DataFrame, queries: DataFrame, k: int = 6, vector: str = "embedding") -> DataFrame:
    """The k most similar chunks per query, exactly, under the query's filter.

    ``chunks`` need id, category, state, event_type and a vector; ``queries`` need
    query_id, state, event_type and a vector. Both sides are written once, the queries
    in blocks by hash, the chunks in files of about ``CHUNKS``. A task takes a block of
    queries and reads file after file of the chunks, or of a share of them where blocks
    are fewer than cores, and keeps the k best per query: all pairs are compared, and
    what is written and shuffled grows with the rows, not with the pairs.
    """
    spark = queries.sparkSession
    asked = queries.select("query_id", "state", "event_type", vector).filter(F.col(vector).isNotNull())
    rows = chunks.select("id", "category", "state", "event_type", vector).filter(F.col(vector).isNotNull())
    types = {f.name: f.dataType.simpleString() for f in (*rows.schema, *asked.schema)}
    schema = f"query_id {types['query_id']}, id {types['id']}, sim double"
    asked, rows = stored(asked, "queries"), stored(rows, "vectors")
    across, down = max(1, -(-asked.count() // QUERIES)), max(1, -(-rows.count() // CHUNKS))
    asked = asked.withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(across)).cast("int"))
    found = _met(asked, rows, across, down, compare(vector, k), k, schema) if folder_address(spark, shared_folder(spark)) else None
    if found is None:  # tasks can't read the shared folder: copies of both sides meet
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = asked.withColumn("_c", every(down))
        right = rows.withColumn("_c", F.pmod(F.xxhash64("id"), F.lit(down)).cast("int")).withColumn("_q", every(across))
        found = left.groupBy("_q", "_c").cogroup(right.groupBy("_q", "_c")).applyInArrow(compare(vector, k), schema)
    order = W.partitionBy("query_id").orderBy(F.desc("sim"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "id", F.round("sim", 4).alias("similarity"), "rank")


def _met(asked: DataFrame, rows: DataFrame, across: int, down: int, met, k: int, schema: str) -> DataFrame:
    """The k best of every query in each share of the chunks' files, read by the task of its block."""
    spark = asked.sparkSession
    blocks, files = scratch_path(spark, "query-blocks"), scratch_path(spark, "vector-blocks")
    with shuffles_go(spark):
        asked.repartition(across, "_q").write.partitionBy("_q").parquet(blocks)
        rows.repartition(down).write.parquet(files)
    blocks, files = folder_address(spark, blocks), folder_address(spark, files)
    shares = min(down, -(-2 * spark.sparkContext.defaultParallelism // across))

    def parts(fs: FileSystem, folder: str) -> list[str]:
        return sorted(f.path for f in fs.get_file_info(FileSelector(folder, allow_not_found=True)) if f.base_name.endswith(".parquet"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(blocks)
        of = parts(fs, FileSystem.from_uri(files)[1])
        for batch in batches:
            for task in batch.column(0).to_pylist():
                block, share = divmod(task, shares)
                own = [read_file(fs, path) for path in parts(fs, f"{root}/_q={block}")]
                if not own:
                    continue
                own, best = pa.concat_tables(own), None
                for path in of[share::shares]:
                    found = met(own, read_file(fs, path))
                    best = best_of(found if best is None else pa.concat_tables([best, found]), k)
                if best is not None:
                    yield from best.to_batches()

    return spark.range(0, across * shares, 1, across * shares).mapInArrow(run, schema)


def read_file(fs: FileSystem, path: str) -> pa.Table:
    with fs.open_input_file(path) as f:
        return pq.ParquetFile(f).read()


def best_of(found: pa.Table, k: int) -> pa.Table:
    """The k most similar rows of every query; ties go to the smaller id."""
    if not found.num_rows:
        return found
    query = found.column("query_id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    order = np.lexsort((found.column("id").to_numpy(), -found.column("sim").to_numpy(), query))
    query = query[order]
    first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
    return found.take(pa.array(order[place < k])).combine_chunks()


def unit_rows(table: pa.Table, vector: str) -> np.ndarray:
    flat = table.column(vector).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    flat = flat.reshape(table.num_rows, -1)
    return flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-300)


def compare(vector: str, k: int):
    """Task function: the k best chunks of a block for every query of a block."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        query, found, similar = [], [], []
        if asked.num_rows and rows.num_rows:
            q, c = unit_rows(asked, vector), unit_rows(rows, vector)
            ids = rows.column("id").to_numpy()
            meta = {m: rows.column(m).to_pandas().to_numpy() for m in ("category", "state", "event_type")}
            modes: dict[tuple, list[int]] = {}
            for i, mode in enumerate(zip(asked.column("state").to_pylist(), asked.column("event_type").to_pylist(), strict=True)):
                modes.setdefault((mode[0] or None, mode[1] or None), []).append(i)
            for mode, members in modes.items():
                mask = allowed(meta, *mode)
                near, near_ids = (c, ids) if mask is None else (c[mask], ids[mask])
                for i in range(0, len(members), AT_ONCE):
                    part = members[i : i + AT_ONCE]
                    for row, sims in zip(part, np.round(q[part] @ near.T, 9), strict=True):
                        top = best_rows(sims, near_ids, k)
                        query += [row] * len(top)
                        found.append(near_ids[top])
                        similar.append(sims[top])
        empty = [np.empty(0)]
        return pa.table(
            {
                "query_id": asked.column("query_id").take(pa.array(query, pa.int64())),
                "id": pa.array(np.concatenate(found) if found else [], type=rows.schema.field("id").type),
                "sim": pa.array(np.concatenate(similar or empty), pa.float64()),
            }
        )

    return run


def format_hits(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Numbered source labels and texts per query.

    The hits are stored first: being few, they travel to the chunks' texts instead of
    the texts being shuffled.
    """
    label = F.concat(
        F.format_string("[Source %d — %s]", "rank", F.coalesce("category", F.lit("unknown"))),
        F.when(F.coalesce("source", F.lit("")) != "", F.format_string(" (%s)", "source")).otherwise(""),
    )
    rows = stored(hits, "hits").join(chunks.select("id", "category", "source", "text"), "id")
    part = F.struct("rank", F.concat_ws("\n", label, "text").alias("s"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda r: r["s"]), "\n\n")
    return rows.groupBy("query_id").agg(joined.alias("retrieved"))


def retrieved_or_default(queries: DataFrame, formatted: DataFrame) -> DataFrame:
    return queries.join(formatted, "query_id", "left").withColumn("retrieved", F.coalesce("retrieved", F.lit(T.NO_DOCUMENTS)))
