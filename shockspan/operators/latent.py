"""Vectors for texts, fitted on the texts themselves: TF-IDF and a truncated SVD.

A weight is (key, word, w). The singular vectors come from a randomised range finder:
the words' random signs are a hash of the word, so the first product needs no table of
words; power rounds multiply by the matrix and its transpose in turn. The matrix is dealt
once into blocks of words by hash, each of about ``WEIGHTS`` weights. A block goes into one
task, which takes its words' vectors from the texts' and gives each of its texts a part of
the next ones; the words' vectors stay in the task, so what is shuffled is a row of numbers
per text and block, and parts of a text add up by key. A task holds its block's weights and
words, never all texts. What stands between two products is made orthogonal through its Gram
matrix, ``width`` squared numbers and all that the driver ever sees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shockspan.session import stored

#: Directions beyond the wanted ones that the range finder follows.
EXTRA = 10
#: Weights and different words that a task of the fit holds, about, and weights or texts worked through at a time.
WEIGHTS, WORDS, AT_ONCE = 1 << 22, 1 << 19, 1 << 20


def tfidf(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, word, w: ``count * (ln((1 + N) / (1 + texts with the word)) + 1)``, each text at length 1.

    Words are lower-cased and stand between ASCII white space; texts without words have no rows.
    Both small sides are stored before they join, so that their size is known and the counts
    stay where they are as long as it is below the broadcast threshold.
    """
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    counts = stored(df.select(F.col(key).alias("key"), F.explode(words).alias("word")).groupBy("key", "word").agg(F.count(F.lit(1)).alias("n")), "counts")
    n = counts.select("key").distinct().count()
    idf = counts.groupBy("word").agg((F.log((n + F.lit(1.0)) / (F.count(F.lit(1)) + 1)) + 1).alias("idf"))
    raw = stored(counts.join(stored(idf, "idf"), "word").select("key", "word", (F.col("n") * F.col("idf")).alias("w")), "weights")
    norm = raw.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(stored(norm, "norm"), "key").select("key", "word", (F.col("w") / F.col("norm")).alias("w"))


def _names(width: int) -> list[str]:
    return [f"c{i}" for i in range(width)]


def times(weights: DataFrame, on: str, to: str, vectors: DataFrame, width: int) -> DataFrame:
    """``to`` and the sums over ``on`` of weight times vector, as columns c0, c1, ..."""
    rows = weights.join(vectors, on)
    return rows.groupBy(to).agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in _names(width)])


def _array(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c not in ("key", "word")], axis=1)


def gram(vectors: DataFrame, width: int) -> np.ndarray:
    """Products of the columns, summed over all rows; a task sends one small matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros((width, width))
        for batch in batches:
            x = _array(batch)
            whole += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(width * width), pa.int32()), pa.array(whole.ravel())], names=["at", "s"])

    parts = vectors.select(*_names(width)).mapInArrow(run, "at int, s double")
    sums = {r["at"]: r["s"] for r in parts.groupBy("at").agg(F.sum("s").alias("s")).collect()}
    return np.array([sums.get(i, 0.0) for i in range(width * width)]).reshape(width, width)


def combined(vectors: DataFrame, key: str, by: np.ndarray) -> DataFrame:
    """Every row's vector times the small matrix ``by``."""
    names = _names(by.shape[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _array(batch) @ by
            yield pa.RecordBatch.from_arrays([batch.column(key), *map(pa.array, x.T)], names=[key, *names])

    return vectors.mapInArrow(run, f"{key} {dict(vectors.dtypes)[key]}, " + ", ".join(f"{c} double" for c in names))


def orthogonal(vectors: DataFrame, key: str, width: int) -> tuple[DataFrame, int]:
    """The rows with orthonormal columns that span the same, and how many are left."""
    values, axes = np.linalg.eigh(gram(vectors, width))
    kept = values > max(values.max(), 0) * 1e-14
    if not kept.any():
        return vectors.limit(0), 0
    return stored(combined(vectors, key, axes[:, kept] / np.sqrt(values[kept])), "basis"), int(kept.sum())


@dataclass
class Space:
    """``words``: word and its coordinates c0, c1, ...; ``values``: the singular values, largest first."""

    words: DataFrame
    values: np.ndarray

    @property
    def size(self) -> int:
        return len(self.values)

    def embedded(self, weights: DataFrame, out: str = "embedding") -> DataFrame:
        """key and the text's vector, words outside the space ignored."""
        rows = times(weights, "word", "key", self.words, self.size)
        return rows.select("key", F.array(*_names(self.size)).alias(out))


def as_bytes(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A string of bytes for every stretch of the values."""
    offsets = pa.py_buffer((bounds * values.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(values))])


def from_bytes(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values again, in one copy, and how many each row has."""
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    values = np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].copy().view(kind)
    return values, np.diff(bounds) // values.itemsize


def packed(weights: DataFrame) -> tuple[DataFrame, int]:
    """The matrix as a row per block of words and text of it, and the number of blocks.

    ``codes`` number the ``size`` words of the block and go with the weights ``w``, both as
    bytes of one string, which pass between Spark and a task uncopied; ``own`` are the words
    that this row is the first to hold, ``first`` the number of the first of them. How many
    different words there are is told by a 64th of their hashes, for the number of blocks only.
    """
    words = weights.filter(F.pmod(F.xxhash64("word"), F.lit(64)) == 0).select("word").distinct().count() * 64
    cores = weights.sparkSession.sparkContext.defaultParallelism
    n = -(-max(1, -(-weights.count() // WEIGHTS), -(-words // WORDS)) // cores) * cores  # whole turns of all cores
    weights = weights.dropna(subset=["key", "word"])
    schema = T.StructType([
        T.StructField("block", T.IntegerType()), T.StructField("size", T.IntegerType()), weights.schema["key"],
        T.StructField("codes", T.BinaryType()), T.StructField("w", T.BinaryType()),
        T.StructField("first", T.IntegerType()), T.StructField("own", T.ArrayType(T.StringType())),
    ])

    def coded(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
        whole = column.dictionary_encode().unify_dictionaries().combine_chunks()
        return whole.indices.to_numpy(zero_copy_only=False), whole.dictionary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        del batches
        block, w = table.column("block")[0].as_py(), table.column("w").to_numpy()
        (text, keys), (code, words) = coded(table.column("key")), coded(table.column("word"))
        del table
        order = np.argsort(text, kind="stable")
        text, code, w = text[order], code[order], w[order]
        starts = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        at = np.sort(np.unique(code, return_index=True)[1])  # where each word comes first
        words, rank = words.take(pa.array(code[at])), np.empty(len(at), np.int32)
        rank[code[at]] = np.arange(len(at), dtype=np.int32)
        code, held, bounds = rank[code], np.searchsorted(at, np.r_[starts, len(text)]), np.r_[starts, len(text)]
        step = max(1, AT_ONCE // max(1, len(text) // len(starts)))
        for i in range(0, len(starts), step):
            j = min(i + step, len(starts))
            cut, own = bounds[i : j + 1], held[i : j + 1]
            fixed = [pa.array(np.full(j - i, x, np.int32)) for x in (block, len(at))]
            new = pa.ListArray.from_arrays(pa.array(own - own[0], pa.int32()), words[own[0] : own[-1]])
            numbers = [as_bytes(x[cut[0] : cut[-1]], cut - cut[0]) for x in (code, w)]
            arrays = [*fixed, keys.take(pa.array(text[starts[i:j]])), *numbers, pa.array(own[:-1], pa.int32()), new]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    dealt = weights.select(F.pmod(F.xxhash64("word"), F.lit(n)).cast("int").alias("block"), "key", "word", F.col("w").cast("double").alias("w"))
    return stored(dealt.repartitionById(n, "block").mapInArrow(run, schema), "packed"), n


def signed(width: int) -> Column:
    """``width`` random signs of every word in ``own``, one after the other, by a hash of the word."""
    sign = lambda x, i: F.when(F.pmod(F.xxhash64(x, F.lit(i)), F.lit(2)) == 0, F.lit(1).cast("byte")).otherwise(F.lit(-1).cast("byte"))
    return F.flatten(F.transform("own", lambda x: F.array(*[sign(x, i) for i in range(width)])))


def through(rows: DataFrame, n: int, width: int, to: str) -> DataFrame:
    """The vectors of a block's words, and what its texts get from them, as columns c0, c1, ...

    ``rows`` are of ``packed``, with the texts' vectors or the words' own ``signs``. By ``to``
    come either each word of ``own`` with its vector, which is the sum of weight times text, or
    each key once per block, with the sum of weight times word.
    """
    names = _names(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, held, waiting, wait = None, [], [], 0

        def settle() -> None:
            code, w, lengths = (np.concatenate(part) for part in zip(*(x[:3] for x in waiting), strict=True))
            for c in range(width):
                x = np.concatenate([part[3][c] for part in waiting])
                vectors[c] += np.bincount(code, w * np.repeat(x, lengths), vectors.shape[1])

        for batch in batches:
            if not batch.num_rows:
                continue
            if vectors is None:
                vectors = np.zeros((width, batch.column("size")[0].as_py()))
            (code, lengths), (w, _) = from_bytes(batch.column("codes"), np.int32), from_bytes(batch.column("w"), np.float64)
            every = pa.array(np.arange(batch.num_rows))  # copies, so that the batch can go
            if to == "key":
                held.append((batch.column("key").take(every), code, w, np.cumsum(lengths) - lengths))
            else:
                held.append((batch.column("own").take(every), batch.column("first").to_numpy().copy()))
            if "signs" in batch.schema.names:
                signs = batch.column("signs").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                new = batch.column("signs").value_lengths().to_numpy(zero_copy_only=False) // width
                at = np.repeat(batch.column("first").to_numpy() - (np.cumsum(new) - new), new) + np.arange(len(signs))
                vectors[:, at] = signs.T
                continue
            waiting.append((code, w, lengths, [batch.column(c).to_numpy(zero_copy_only=False) for c in names]))
            wait += len(code)
            if wait >= AT_ONCE:
                settle()
                waiting, wait = [], 0
        if waiting:
            settle()
        for found, *part in held:
            if to == "key":
                code, w, starts = part
                yield pa.RecordBatch.from_arrays([found, *[pa.array(np.add.reduceat(w * v[code], starts)) for v in vectors]], names=[to, *names])
            else:
                new = found.value_lengths().to_numpy(zero_copy_only=False)
                at = np.repeat(part[0] - (np.cumsum(new) - new), new) + np.arange(new.sum())
                yield pa.RecordBatch.from_arrays([found.flatten(), *[pa.array(v[at]) for v in vectors]], names=[to, *names])

    schema = T.StructType([rows.schema["key"] if to == "key" else T.StructField("word", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in names]])
    return rows.repartitionById(n, "block").mapInArrow(run, schema)


def fitted(weights: DataFrame, size: int = 32, rounds: int = 4) -> Space:
    """The ``size`` leading right singular vectors of the matrix of weights (fewer if its rank is).

    The weights are read twice, so they should be stored.
    """
    matrix, n = packed(weights)
    width = size + EXTRA
    rows = matrix.select("block", "size", "key", "codes", "w", "first", signed(width).alias("signs"))
    for _ in range(rounds):
        sums = through(rows, n, width, "key").groupBy("key").agg(*[F.sum(c).alias(c) for c in _names(width)])
        texts, width = orthogonal(stored(sums, "texts"), "key", width)
        if not width:
            return Space(weights.select("word", *[F.lit(0.0).alias(c) for c in _names(size)]).limit(0), np.zeros(0))
        rows = matrix.select("block", "size", "key", "codes", "w").join(texts, "key")
    words = stored(through(matrix.join(texts, "key"), n, width, "word"), "words")
    values, axes = np.linalg.eigh(gram(words, width))
    lead = np.argsort(-values)[:size]
    lead = lead[values[lead] > max(values.max(), 0) * 1e-14]
    singular = np.sqrt(values[lead])
    return Space(stored(combined(words, "word", axes[:, lead] / singular), "space"), singular)
