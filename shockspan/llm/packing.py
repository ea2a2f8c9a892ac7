"""Documents are tokenised and packed into sequences by vector best fit.

A text is cut before each blank that a non-blank follows. The byte-level tokenizer's
own first split always cuts there as well, so the parts can be encoded apart and the
ids joined; every distinct part goes through the tokenizer once, later ones come from a
table of bounded size. Documents longer than a sequence are cut into full pieces, the
first piece taking the remainder.

Pieces are dealt by hash into groups of about ``group`` pieces, each packed by one task.
Within a group pieces go longest first into the open sequence that is left fullest: every
sequence has a residual capacity of tokens, of documents and of attention cost (the sum
of squared lengths); only sequences with room in all three are candidates, and the one
with the least weighted norm of what would remain (or the largest weighted dot product
of demand and residual) is taken. A group leaves a handful of sequences unfilled, a few
per thousand, however large the corpus is.

Defined cases: a null or empty text is the end token alone; repeated rows are packed
each; a null id stays null; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockspan.llm.common import id_or_null, kept_tables, packed, slices, trimmed
from shockspan.session import stored

CAPACITY, END, GROUP = 1024, 2, 16384
#: Parts and their ids that a worker keeps; about 200 bytes each.
KEPT_PARTS = 450_000
#: A blank before a character that is no white space, neither here nor for the tokenizer.
CUT = re.compile(r" (?=[^\s\x1c-\x1f])")
#: What follows any other blank.
BLANK = re.compile(r"[\s\x1c-\x1f]|$")

_loaded: dict[str, Tokens] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Tokens:
    """A byte-level tokenizer with the parts it has seen."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        # a token is written with one character for each of its bytes
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.n_bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.known: dict[str, bytes] = {}
        kept_tables.append(self.known)  # other operators' tasks empty it

    def encoded(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def learn(self, parts: list[str]) -> dict[str, bytes]:
        """Parts -> ids of a blank and the part; all are encoded as one text and cut by bytes."""
        ids = self.encoded(" " + " ".join(parts))
        ends = np.cumsum([len(p.encode()) + 1 for p in parts])
        cuts = np.searchsorted(np.cumsum(self.n_bytes[ids]), ends) + 1
        raw, cuts = ids.tobytes(), (4 * cuts).tolist()
        return {p: raw[a:b] for p, a, b in zip(parts, [0, *cuts], cuts, strict=False)}

    def ids_of(self, texts: list[str | None]) -> list[bytes]:
        """The ids of every text and the end token, as little-endian unsigned 32-bit."""
        get, split, found, new = self.known.get, [], [], set()
        for text in texts:
            parts = (text or "").split(" ")
            head = parts.pop(0)
            ids = list(map(get, parts))
            if None in ids:
                missing = {p for p, i in zip(parts, ids, strict=True) if i is None}
                if any(BLANK.match(p) for p in missing):  # a part that is none: cut with care
                    head, *parts = CUT.split(text)
                    ids = list(map(get, parts))
                    missing = {p for p, i in zip(parts, ids, strict=True) if i is None}
                new |= missing
            split.append((head, parts))
            found.append(ids)
        new = list(new)
        fresh = self.learn(new) if new else {}
        if len(self.known) + len(fresh) <= KEPT_PARTS:
            self.known.update(fresh)
        out = []
        for (head, parts), ids in zip(split, found, strict=True):
            if None in ids:
                ids = [fresh[p] if i is None else i for p, i in zip(parts, ids, strict=True)]
            out.append((self.encoded(head).tobytes() if head else b"") + b"".join(ids) + END.to_bytes(4, "little"))
        return out


def tokens(path: str) -> Tokens:
    if path not in _loaded:
        _loaded[path] = Tokens(path)
    return _loaded[path]


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, most=2 << 20):
                rows: list[tuple] = []
                for k, ids in enumerate(tokens(path).ids_of(batch.column("text").to_pylist())):
                    n = len(ids) // 4
                    first = n % capacity or capacity
                    bounds = [0, *range(first, n + 1, capacity)]
                    rows += [(k, i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
                k, piece, start, length, crc = map(list, zip(*rows, strict=True)) if rows else ([], [], [], [], [])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(k, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def vector_best_fit(
    lengths: np.ndarray, capacity: int, max_docs: int, max_cost: float, measure: str = "norm", weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)
) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every piece; pieces are taken in the given order."""
    n = len(lengths)
    limit = np.array([capacity, max_docs, max_cost], float)
    rest, weight = np.zeros((n, 3)), np.array(weights)
    where, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    bins, opened, shortest = np.zeros(n, np.int64), 0, np.minimum.accumulate(lengths[::-1])[::-1]
    live = 0
    for i, length in enumerate(lengths.tolist()):
        need = np.array([length, 1.0, float(length) ** 2])
        fits = np.flatnonzero((rest[:live] >= need).all(axis=1))
        if len(fits):
            after = (rest[fits] - need) / limit
            if measure == "dot":
                k = fits[np.argmax((rest[fits] / limit * (need / limit)) @ weight)]
            else:
                k = fits[np.argmin((after * after) @ weight)]
        else:
            k, rest[live], bins[live] = live, limit, opened
            opened, live = opened + 1, live + 1
        where[i], offset[i] = bins[k], capacity - rest[k, 0]
        rest[k] -= need
        if rest[k, 0] < shortest[i] or rest[k, 1] < 1:  # closed: the last open one takes its place
            live -= 1
            rest[k], bins[k] = rest[live], bins[live]
    return where, offset


def _packed(capacity: int, max_docs: int, max_cost: float, measure: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], kind="stable")
        where, offset = vector_best_fit(rows["length"].to_numpy(), capacity, max_docs, max_cost, measure)
        rows = rows.assign(sequence_id=rows["lot"].to_numpy() * (1 << 32) + where, offset=offset)
        return rows.drop(columns="lot")

    return run


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY,
    max_docs: int | None = None, max_cost: float | None = None, measure: str = "norm", group: int = GROUP,
) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    At most ``capacity`` tokens, ``max_docs`` pieces and ``max_cost`` squared tokens go
    into a sequence; left out, the last two bind no more than the first does.
    """
    schema = "id long, piece int, start long, length long, ids_crc32 long"
    max_docs, max_cost = max_docs or capacity, max_cost or float(capacity) ** 2
    if max_docs < 1 or max_cost < float(capacity) ** 2:
        raise ValueError("a full piece must fit into an empty sequence")
    found = packed(docs, id_col, text_col).select("id", "text").mapInArrow(trimmed(_pieces(tokenizer or default_tokenizer(), capacity), keep=True), schema)
    found = stored(found, "pieces")
    lots = max(1, -(-found.count() // group))
    lot = F.pmod(F.xxhash64("id", "piece", "start", F.monotonically_increasing_id()), F.lit(lots))
    out = found.withColumn("lot", lot).groupBy("lot").applyInPandas(_packed(capacity, max_docs, max_cost, measure), schema + ", sequence_id long, offset long")
    return out.withColumn("id", id_or_null("id")).withColumnRenamed("id", id_col)
