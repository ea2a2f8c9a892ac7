"""Chunking, metadata rules, corpus assembly and word-count vectors of texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shockspan.functions.columns import first_match, strip
from shockspan.session import stored

# Chunk length and overlap in characters.
CHUNK_SIZE = 800
CHUNK_OVERLAP = 100

# File name part -> category, first match wins.
CATEGORIES = {
    "fema": "fema",
    "ca_": "unemployment",
    "fl_": "unemployment",
    "tx_": "unemployment",
    "nc_": "unemployment",
    "unemployment": "unemployment",
    "warn": "warn_act",
    "retraining": "retraining",
    "transferable": "transferable_skills",
    "cobra": "cobra",
    "recovery": "recovery_timelines",
    "disaster_financial": "financial_aid",
}

# File name part -> event type, first match wins.
EVENT_TYPES = {
    "wildfire": "wildfire",
    "hurricane": "hurricane",
    "flood": "flood",
    "earthquake": "earthquake",
    "tornado": "tornado",
}

# Start of a file name -> state.
STATES = {
    "ca_": "CA", "fl_": "FL", "tx_": "TX", "nc_": "NC", "la_": "LA", "az_": "AZ", "co_": "CO",
    "ct_": "CT", "dc_": "DC", "ga_": "GA", "il_": "IL", "in_": "IN", "ma_": "MA", "md_": "MD",
    "mi_": "MI", "mn_": "MN", "mo_": "MO", "nv_": "NV", "ny_": "NY", "oh_": "OH", "ok_": "OK",
    "or_": "OR", "pa_": "PA", "ri_": "RI", "tn_": "TN", "ut_": "UT", "va_": "VA", "wa_": "WA",
    "wi_": "WI",
}

CORPUS = ["id", "text", "category", "state", "event_type", "source", "county_id", "region"]


def chunk_text(docs: DataFrame, doc_id: str, text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Overlapping chunks of the stripped text; empty texts give none.

    The text is cut once into steps of ``size - overlap`` characters, and each chunk
    is a step with the head of the next one. Cutting each chunk out of the whole
    text would walk it from the start every time.
    """
    step = size - overlap
    rows = docs.withColumn(text, strip(F.col(text))).filter(F.length(text) > 0)
    rows = rows.withColumn("_steps", F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)))
    n = F.length(text)
    count = F.when(n <= size, 1).otherwise(F.ceil((n - overlap) / step)).cast("int")
    rows = rows.withColumn("_n", count).drop(text)
    cut = F.transform(
        F.sequence(F.lit(0), F.col("_n") - 1),
        lambda i: F.concat(F.get("_steps", i), F.coalesce(F.substring(F.get("_steps", i + 1), 1, overlap), F.lit(""))),
    )
    rest = [c for c in docs.columns if c != text]
    return rows.select(*rest, F.posexplode(cut).alias("chunk", "text")).withColumn(
        "id", F.concat_ws("_", F.col(doc_id).cast("string"), F.lit("chunk"), "chunk")
    )


def infer_metadata(
    docs: DataFrame,
    name: str,
    categories: dict[str, str] = CATEGORIES,
    event_types: dict[str, str] = EVENT_TYPES,
    states: dict[str, str] = STATES,
) -> DataFrame:
    """Category, event type and state from the file name, by ordered rules."""
    low = F.lower(name)
    none = F.lit(None).cast("string")

    def rules(table, test):
        return [(test(low, F.lit(k)), F.lit(v)) for k, v in table.items()]

    return docs.select(
        "*",
        first_match(rules(categories, F.contains), F.lit("general")).alias("category"),
        first_match(rules(event_types, F.contains), none).alias("event_type"),
        first_match(rules(states, F.startswith), none).alias("state"),
    )


def build_corpus(documents: DataFrame, predictions: DataFrame, profiles: DataFrame) -> DataFrame:
    """One table of chunks from documents, scenario texts and forecast profiles.

    Documents carry ``name``, ``text`` and their metadata; scenario texts stay whole;
    profiles are chunked. Missing ids are built from type and place.
    """
    docs = chunk_text(documents, "name", "text").withColumn("source", F.col("name"))
    preds = predictions.withColumn("text", strip("text")).filter(F.length("text") > 0).select(
        F.coalesce("id", F.concat_ws("_", F.lit("pred"), "event_type", "county_id")).alias("id"), "text",
        F.lit("model_output").alias("category"), "event_type", "county_id", "region", F.lit("model_predictions").alias("source"),
    )
    profile_id = F.coalesce("id", F.concat_ws("_", F.lit("forecast"), "state", "event_type"))
    profs = chunk_text(profiles.select(profile_id.alias("pid"), "state", "event_type", "text"), "pid", "text").select(
        "id", "text", F.lit("forecast").alias("category"), "state", F.lower("event_type").alias("event_type"),
        F.lit("forecast_profiles").alias("source"),
    )
    parts = docs.unionByName(preds, allowMissingColumns=True).unionByName(profs, allowMissingColumns=True)
    return parts.select(*[F.col(c) if c in parts.columns else F.lit(None).cast("string").alias(c) for c in CORPUS])


def upsert_chunks(target: DataFrame, batch: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """Target with the batch's rows inserted or replaced.

    Within the batch the row with the largest ``order`` wins. The batch is stored, so
    its keys are broadcast as long as they are few and the target stays in place. The
    result has to go to a new path, since it still reads the target.
    """
    if order is not None:
        rest = [c for c in batch.columns if c not in (key, order)]
        last = F.max(F.struct(order, *rest)).alias("_r")
        batch = batch.groupBy(key).agg(last).select(key, *[f"_r.{c}" for c in rest])
    batch = stored(batch, "batch")
    return target.join(batch.select(key), key, "left_anti").unionByName(batch, allowMissingColumns=True)


def parted(df: DataFrame, key: str, parts: int) -> DataFrame:
    """The rows with ``part``, the folder of a keyed table that a key lies in."""
    return df.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))


def create_keyed(df: DataFrame, path: str, key: str, parts: int = 64) -> None:
    """Write a table by folders of its key's hash, for ``upsert_keyed``.

    Adaptive execution cuts a large folder into tasks and files of its advisory size.
    """
    rows = parted(df, key, parts)
    rows.hint("rebalance", "part").write.partitionBy("part").parquet(path)


def upsert_keyed(spark: SparkSession, path: str, batch: DataFrame, key: str, order: str | None = None, parts: int = 64) -> None:
    """Insert or replace the batch's rows in a table of ``create_keyed``, in place.

    Only folders that the batch's keys fall into are read and rewritten, by a dynamic
    partition overwrite, which replaces a folder when its new files are complete; all
    others keep their files. Of a key's rows within the batch the one with the largest
    ``order`` wins (then the largest row). A rerun of the same batch changes no row. The
    new folders' rows are written aside first, since a folder cannot be read while it is
    replaced. One job may write a table at a time.
    """
    target = spark.read.parquet(path)
    columns = [c for c in target.columns if c != "part"]
    rest = [c for c in columns if c != key]
    last = F.max(F.struct(*([order] if order else []), F.struct(*rest).alias("_row"))).alias("_r")
    new = batch.groupBy(key).agg(last).select(key, "_r._row.*")
    new = stored(parted(new, key, parts), "batch")
    touched = [r.part for r in new.select("part").distinct().collect()]  # folder numbers only
    if not touched:
        return
    keys = new.select(F.col(key).alias("_key"))
    old = target.filter(F.col("part").isin(touched)).join(keys, F.col(key).eqNullSafe(F.col("_key")), "left_anti")
    merged = stored(old.select(*columns, "part").unionByName(new.select(*columns, "part")), "merged")
    merged.hint("rebalance", "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def hashed_words(df: DataFrame, key: str, text: str, size: int = 64, out: str = "embedding") -> DataFrame:
    """A vector without a model per ``key``: counts of words by a stable hash of the word.

    A sentence encoder is the caller's own (an Arrow function over ``text``); this one
    needs none. Each row's words become its ``size`` counts where the row is, so rows of
    numbers meet by key and never the words; rows of a key add up before the shuffle.
    """
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    slots = [f"_s{i}" for i in range(size)]
    schema = T.StructType([df.schema[key], *[T.StructField(s, T.IntegerType()) for s in slots]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_w")
            coded = lists.flatten().dictionary_encode()
            slot = np.array([int.from_bytes(hashlib.md5(w).digest()[:4]) % size for w in coded.dictionary.cast(pa.binary()).to_pylist()], np.int64)
            row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            place = row * size + slot[coded.indices.to_numpy(zero_copy_only=False)]
            counts = np.bincount(place, minlength=len(lists) * size).astype(np.int32).reshape(-1, size)
            yield pa.RecordBatch.from_arrays([batch.column(key), *map(pa.array, np.ascontiguousarray(counts.T))], names=[key, *slots])

    counted = df.select(key, words.alias("_w")).mapInArrow(run, schema)
    sums = counted.groupBy(key).agg(*[F.sum(s).alias(s) for s in slots])
    return sums.select(key, F.array(*[F.col(s).cast("float") for s in slots]).alias(out))
