"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_ID = 2**63 - 1
#: Bytes of text that a Python worker takes from a record batch at a time.
SLICE_BYTES = 8 << 20


def named(name: str) -> Column:
    """A column by its plain name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row`` holds every input column, so no name of theirs can clash with ours.

    ``id`` is a long; a null id becomes NO_ID, the last in any order. A null text
    stays null.
    """
    return df.select(
        F.struct(*[named(c) for c in df.columns]).alias("row"),
        F.coalesce(named(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
        named(text_col).cast("string").alias("text"),
    )


def unpacked(df: DataFrame, columns: list[str], new: dict[str, Column]) -> DataFrame:
    """The input columns again, with ``new`` ones in place of those of equal names."""
    kept = [F.col("row")[c].alias(c) for c in columns if c not in new]
    return df.select(*kept, *[v.alias(k) for k, v in new.items()])


def replaced(df: DataFrame, columns: list[str], new: dict[str, Column]) -> DataFrame:
    """The input columns in their order, some of them with new values."""
    return df.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in columns])


def id_or_null(column: str = "id") -> Column:
    return F.when(F.col(column) != NO_ID, F.col(column))


def fold(id_column: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; null ids fall in no fold."""
    return F.crc32(id_column.cast("string").cast("binary")) % folds


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a slice stay below ``most`` bytes (one text at least)."""
    column = batch.column(batch.schema.get_field_index(text))
    lengths = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += int(n)
    if begin < batch.num_rows:
        yield batch.slice(begin)


def text_parts(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts of an Arrow column, a slice at a time."""
    for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"])):
        yield part.column(0).to_pylist()


#: Tables that workers of this process keep from task to task.
kept_tables: list[dict] = []


def give_back(keep: bool = False) -> None:
    """Hand unused memory back to the system, for workers outlive their tasks; ``keep`` spares the kept tables."""
    if not keep:
        for table in kept_tables:
            table.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def trimmed(run: Callable[[Iterator], Iterator], keep: bool = False) -> Callable[[Iterator], Iterator]:
    """A task function that gives its memory back when the task ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back(keep)

    return wrapped


def sampled(rows: DataFrame, id_column: Column, most: int, by: Column | None = None) -> DataFrame:
    """About ``most`` rows at most, chosen by a hash of the id; all rows where they are fewer.

    ``by`` shares the number equally between its values (few ones: classes, languages).
    """
    group = F.lit(1) if by is None else by
    counts = {r[0]: r[1] for r in rows.groupBy(group.alias("g")).count().collect()}
    place = F.pmod(F.xxhash64(id_column, F.lit("sample")), F.lit(1 << 30))
    taken, rest, left = F.lit(False), most, len(counts)
    for value, n in sorted(counts.items(), key=lambda x: x[1]):  # what small groups leave goes to the larger
        share = rest // left
        taken = taken | (group.eqNullSafe(F.lit(value)) & (place < int(min(1.0, share / n) * (1 << 30))))
        rest, left = rest - min(share, n), left - 1
    return rows.filter(taken)
