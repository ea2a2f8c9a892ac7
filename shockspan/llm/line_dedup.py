"""Lines that many documents share are kept in one document only.

Every document is exploded into its normalised lines; a line is known by a 128-bit
hash. Distinct documents are counted per hash, with partial counts before the
shuffle, so a line that a third of all documents hold is a few rows per task. Hashes
over the threshold are a table; joined with the lines (an equi-join whose hot keys
adaptive execution splits) it gives each document the hashes it loses, and each
document is put together again from its other lines, in their order.

Defined cases: a null or empty text is one empty line and stays so; lines whose key
is shorter than ``min_chars`` always stay; repeats inside one document count once;
rows of equal id are one document; a null id sorts after all others and rows with a
null id are one document; extra columns are carried along, and columns named like
the counts are replaced by them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockspan.llm.common import packed, replaced, slices, unpacked
from shockspan.session import stored

BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: str) -> str:
    """White space off both ends; A-Z to lower case, other letters as they are."""
    return line.strip(BLANKS).encode().lower().decode()


def _digest(line: str, min_chars: int) -> bytes | None:
    key = line.strip(BLANKS)
    return xxhash.xxh3_128_digest(key.encode().lower()) if len(key) >= min_chars else None


def _keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                ids, counts, digests = batch.column("id").to_numpy(zero_copy_only=False), [], []
                for text in batch.column("text").to_pylist():
                    own = {_digest(line, min_chars) for line in (text or "").split("\n")} - {None}
                    counts.append(len(own))
                    digests.extend(own)
                pairs = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1])), pa.array(np.repeat(ids, counts))],
                    names=["h1", "h2", "id"],
                )

    return run


def _reassembled(min_chars: int):
    @F.pandas_udf("n_lines long, n_dropped long, kept string")
    def run(texts: pd.Series, first: pd.Series, second: pd.Series) -> pd.DataFrame:
        out = []
        for text, h1, h2 in zip(texts, first, second, strict=True):
            lines = (text or "").split("\n")
            if h1 is None or not len(h1):
                out.append((len(lines), 0, text))
                continue
            gone = np.stack([h1, h2], 1).astype("<i8").tobytes()
            gone = {gone[i : i + 16] for i in range(0, len(gone), 16)}
            kept = [line for line in lines if _digest(line, min_chars) not in gone]
            dropped = len(lines) - len(kept)
            out.append((len(lines), dropped, "\n".join(kept) if dropped else text))
        return pd.DataFrame(out, columns=["n_lines", "n_dropped", "kept"])

    return run


def _joined(docs: DataFrame, id_col: str, text_col: str, min_chars: int, max_docs: int) -> DataFrame:
    base = packed(docs, id_col, text_col)
    keys = stored(base.select("id", "text").mapInArrow(_keys(min_chars), "h1 long, h2 long, id long"), "line-keys")
    if max_docs == 1:  # two distinct holders are a smallest and another largest
        held = keys.groupBy("h1", "h2").agg(F.min("id").alias("keep"), F.max("id").alias("last")).filter("last <> keep")
    else:
        held = keys.groupBy("h1", "h2").agg(F.min("id").alias("keep"), F.count_distinct("id").alias("n")).filter(F.col("n") > max_docs)
    held = stored(held.select("h1", "h2", "keep"), "line-holders")
    gone = (
        keys.join(held, ["h1", "h2"])
        .filter("id <> keep")
        .select("id", "h1", "h2")
        .groupBy("id")
        .agg(F.collect_list("h1").alias("g1"), F.collect_list("h2").alias("g2"))
    )
    out = base.join(gone, "id", "left")
    return out.withColumn("made", _reassembled(min_chars)("text", "g1", "g2"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, max_docs: int = 1) -> DataFrame:
    """All input columns with the text that is kept, and n_lines and n_dropped.

    Lines that more than ``max_docs`` documents hold stay in the smallest id only.
    """
    out = _joined(docs, id_col, text_col, min_chars, max_docs)
    new = {text_col: F.col("made.kept"), "n_lines": F.col("made.n_lines"), "n_dropped": F.col("made.n_dropped")}
    return unpacked(out, docs.columns, new)


def without_shared_lines(docs: DataFrame, min_chars: int = 10, max_docs: int = 1) -> DataFrame:
    """The columns of ``documents`` with shorter texts and their lengths."""
    out = _joined(docs, "doc_id", "text", min_chars, max_docs)
    return replaced(out, docs.columns, {"text": F.col("made.kept"), "n_chars": F.length("made.kept").cast("long")})
