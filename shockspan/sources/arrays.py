"""Files that are one large JSON array, read in parallel by byte ranges.

Spark reads such a file as one value in one task. Here the text source cuts it at every
``}`` (an escape never stands before one), so its usual splits apply on any file system,
and the missing knowledge, whether a split starts inside a string or a record, comes from
a first pass: each split reports, for both cases of starting inside and outside a string,
whether it changes the case, by how much the nesting deepens and how low it gets. These
few numbers per split add up, in the order of the splits of a file, to the state each of
them starts in. A second pass cuts out the records; those that reach over a border are
put together from their parts, a group of the size of one record each. Both passes work
on the bytes of whole batches at a time.

Defined cases: rows are the objects that stand in the array itself, elements of other
kinds are left out; an empty array or file gives no row; brackets and quotes in strings
are text; a value that does not fit the schema is null, as is every field of an object that
is no JSON; a record that ends with the file before its last brace is closed there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPLIT = ["file", "start"]
#: Bytes that can matter: quotes, brackets, escapes.
MARKS = np.isin(np.arange(256), np.frombuffer(b'"\\{}[]', np.uint8))
#: By how much a bracket deepens the nesting.
STEP = np.zeros(256, np.int64)
STEP[[ord("{"), ord("[")]], STEP[[ord("}"), ord("]")]] = 1, -1


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Buffer, int, int]]:
    """(file, start, bytes, first, end): the pieces of a batch by splits, with their braces, as one range of bytes."""
    if not batch.num_rows:
        return
    whole = pc.binary_join_element_wise(batch.column(2), "", "}")
    offsets = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset : whole.offset + len(whole) + 1]
    files, starts = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
    at = files.indices.to_numpy()
    cuts = [0, *(np.flatnonzero((np.diff(at) != 0) | (np.diff(starts) != 0)) + 1).tolist(), len(starts)]
    for i, j in zip(cuts, cuts[1:], strict=False):
        yield files.dictionary[int(at[i])].as_py(), int(starts[i]), whole.buffers()[2], int(offsets[i]), int(offsets[j])


def _tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places and bytes of brackets, the quotes before each, and the number of quotes.

    A byte after an odd number of backslashes is none of them, but for a closing brace.
    """
    at = np.flatnonzero(MARKS[data])
    kind = data[at]
    slash = at[kind == ord("\\")]
    if len(slash):
        first = np.flatnonzero(np.diff(slash, prepend=-2) != 1)
        length = np.diff(first, append=len(slash))
        escaped = (slash[first] + length)[length % 2 == 1]
        keep = (kind != ord("\\")) & ((kind == ord("}")) | ~np.isin(at, escaped))
        at, kind = at[keep], kind[keep]
    quote = kind == ord('"')
    quotes = np.cumsum(quote)
    return at[~quote], kind[~quote], quotes[~quote], int(quotes[-1]) if len(quotes) else 0


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split: quotes odd or even; change and lowest point of the nesting for a start outside and inside a string."""
    names = ["file", "start", "odd", "change_0", "change_1", "low_0", "low_1"]
    out = []
    for batch in batches:
        for file, start, data, begin, end in _runs(batch):
            if not out or out[-1][:2] != [file, start]:
                out.append([file, start, 0, 0, 0, 0, 0])
            row = out[-1]
            _, kind, quotes, n = _tokens(np.frombuffer(data, np.uint8)[begin:end])
            # a quote turns the case round, so a token is outside a string in exactly one of them
            case = (quotes + row[2]) % 2
            for k in (0, 1):
                depth = row[3 + k] + np.cumsum(STEP[kind] * (case == k))
                if len(depth):
                    row[3 + k], row[5 + k] = int(depth[-1]), min(row[5 + k], int(depth.min()))
            row[2] = (row[2] + n) % 2
    yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for row in out], schema=pa.schema([("file", pa.string()), *[(n, pa.int64()) for n in names[1:]]]))


class _Cutter:
    """The records of one split, and its parts of records that reach over its borders."""

    def __init__(self, file, start, quoted, depth, owner):
        self.file, self.start, self.quoted, self.depth, self.owner = file, start, int(quoted), depth, owner
        self.open, self.continued, self.parts = depth > 1, True, []

    def whole(self, data: pa.Buffer, begin: int, end: int) -> tuple[pa.Array | None, list[tuple]]:
        """The records that begin and end in a range of bytes, and those that end here and began before."""
        raw = np.frombuffer(data, np.uint8)[begin:end]
        at, kind, quotes, n = _tokens(raw)
        outside = (quotes + self.quoted) % 2 == 0
        at, kind = at[outside], kind[outside]
        depth = self.depth + np.cumsum(STEP[kind])
        opens = (kind == ord("{")) & (depth == 2)
        ends = (kind == ord("}")) & (depth == 1)
        event = opens | ends | ((kind == ord("]")) & (depth < 2))  # at the last, what was open is an array, no object
        opens, ends, at = opens[event], ends[event], at[event]
        self.quoted = (self.quoted + n) % 2
        self.depth = int(depth[-1]) if len(depth) else self.depth
        done = []
        if self.open:
            self.parts.append(raw[: at[0] + 1 if len(at) else None].tobytes())
            if len(at) and ends[0]:
                done.append(self.part())
            if len(at):
                self.open, self.parts = False, []
        records = None
        pairs = np.flatnonzero(opens[:-1] & ends[1:])
        if len(pairs):
            borders = (np.stack([at[pairs], at[pairs + 1] + 1], axis=1).ravel() + begin).astype(np.int32)
            slices = pa.StringArray.from_buffers(len(borders) - 1, pa.py_buffer(borders), data)
            records = slices.take(pa.array(np.arange(0, len(slices), 2)))  # what lies between is none
        if len(at) and opens[-1]:
            self.open, self.continued, self.parts = True, False, [raw[at[-1] :].tobytes()]
        return records, done

    def part(self) -> tuple:
        text, self.parts, self.open = b"".join(self.parts).decode(errors="replace"), [], False
        return self.file, self.start if not self.continued else self.owner, self.start, not self.continued, text

    def rest(self) -> list[tuple]:
        return [self.part()] if self.open and self.parts else []


PART = "file string, owner long, start long, first boolean, text string"


def _cut(states: dict[tuple[str, int], tuple], spread: bool):
    """Task function: ``text`` of the records inside a split, or, with ``spread``, the parts of those over its borders."""
    schema = pa.schema([("file", pa.string()), ("owner", pa.int64()), ("start", pa.int64()), ("first", pa.bool_()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, parts = None, []
        for batch in batches:
            for file, start, data, begin, end in _runs(batch):
                if split is None or (file, start) != (split.file, split.start):
                    parts += split.rest() if split else []
                    if (file, start) not in states:
                        raise ValueError("the splits of the files changed between the two passes")
                    split = _Cutter(file, start, *states[file, start])
                records, done = split.whole(data, begin, end)
                # a record over two batches of a split is whole as well
                inside = [p[-1] for p in done if p[3]]
                parts += [p for p in done if not p[3]]
                if not spread:
                    parts = []
                    for texts in (records, pa.array(inside, pa.string()) if inside else None):
                        if texts is not None:
                            yield pa.RecordBatch.from_arrays([texts], names=["text"])
        parts += split.rest() if split else []
        if spread and parts:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*parts, strict=True), schema, strict=True)], schema=schema)

    return run


def split_states(pieces: DataFrame) -> DataFrame:
    """A row per split: the state it starts in and the split in which its first record began.

    The window holds one short row per split of a file, what the scheduler holds as well.
    """
    effects = pieces.mapInArrow(_effects, "file string, start long, odd long, change_0 long, change_1 long, low_0 long, low_1 long")
    order = Window.partitionBy("file").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.col("quoted") == 1
    rows = effects.withColumn("quoted", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    rows = rows.withColumn("change", F.when(inside, F.col("change_1")).otherwise(F.col("change_0")))
    rows = rows.withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
    low = F.col("depth") + F.when(inside, F.col("low_1")).otherwise(F.col("low_0"))
    begins = (F.col("depth") + F.col("change") > 1) & ((F.col("depth") <= 1) | (low <= 1))
    owner = F.last(F.when(begins, F.col("start")), ignorenulls=True).over(before)
    return rows.select(*SPLIT, inside.alias("quoted"), "depth", owner.alias("owner"))


def array_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``text``: the objects of the arrays in the files of a path, one per row.

    The states are read here, a short row per split, and go to the tasks with their code:
    the pieces stay in the order of the scan, without a shuffle or a sort.
    """
    lines = spark.read.option("lineSep", "}").text(path)
    pieces = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    states = {(r.file, r.start): (r.quoted, r.depth, r.owner) for r in split_states(pieces).collect()}
    parts = F.array_sort(F.collect_list(F.struct("start", "first", "text")))
    # splits are the same as long as the session's cores are; a change in between does not go unseen
    spread = pieces.mapInArrow(_cut(states, spread=True), PART)
    spread = spread.groupBy("file", "owner").agg(parts.alias("p"), F.bool_or("first").alias("begun"))
    joined = spread.filter("begun").select(F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))
    return pieces.mapInArrow(_cut(states, spread=False), "text string").unionByName(joined)


def read_json_array(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """The objects of a large JSON array by a schema, in no order."""
    return array_records(spark, path).select(F.from_json("text", schema).alias("r")).select("r.*")
