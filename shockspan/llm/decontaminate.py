"""Documents that hold a benchmark item, verbatim or with a few edited words.

Texts and items are compared as sequences of words (letters and digits, lower case), so
layout and punctuation make no difference. An item of n words may differ by
k = floor(n * ``rate``) inserted, deleted or replaced words. Cut into k + 1 pieces, one
of its pieces must stand in the document unchanged; the pieces' hashes are looked up at
every word of every document, hits are compared word by word, and each hit's
surroundings are verified with Myers' bit-parallel edit distance (one bit per word of
the item, free ends in the document).

Items are a query set: they are taken in blocks of at most ``BLOCK_WORDS`` words, each
block against all documents, so what travels with the tasks has a fixed bound. Nothing
is shuffled and documents need no partner, so hot items cost their hits only.

Defined cases: null or wordless texts and items match nothing; items of fewer than
1 / rate words must occur word for word; repeated items and repeated documents each
give their rows; an item that occurs several times in a document gives one row, the
least distance first, then the first place; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockspan.llm.common import id_or_null, named, packed, slices, text_parts

RATE, BLOCK_WORDS = 0.2, 400_000
WORD = re.compile(r"[^\W_]+")
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def pieces(n: int, rate: float = RATE) -> list[tuple[int, int]]:
    """(first, length) of the floor(n * rate) + 1 pieces of n words, lengths as equal as can be."""
    parts = int(n * rate + 1e-9) + 1
    cuts = [n * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(masks: dict[int, int], m: int, text: list[int], most: int) -> tuple[int, int] | None:
    """(least distance, end) of the pattern in ``text`` with free ends, if at most ``most``.

    ``masks``: symbol -> bits of the pattern's places that hold it.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, None
    for end, symbol in enumerate(text, 1):
        eq = masks.get(symbol, 0)
        down = eq | minus
        across = ((((eq & plus) + plus) ^ plus) | eq) & full
        h_plus, h_minus = minus | (full & ~(across | plus)), plus & across
        if h_plus & top:
            score += 1
        elif h_minus & top:
            score -= 1
        h_plus, h_minus = (h_plus << 1) & full, (h_minus << 1) & full
        plus, minus = h_minus | (full & ~(down | h_plus)), h_plus & down
        if score <= most and (best is None or score < best[0]):
            best = score, end
    return best


class Block:
    """The look-up tables of some items; small, and sent with the tasks."""

    def __init__(self, items: list[tuple[int | None, list[str]]], rate: float):
        self.vocabulary: dict[str, int] = {}
        self.items, at = [], {}
        for item, words in items:
            codes = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            masks: dict[int, int] = {}
            for i, c in enumerate(codes):
                masks[c] = masks.get(c, 0) | 1 << i
            parts = pieces(len(codes), rate)
            for first, n in parts:
                at.setdefault(tuple(codes[first : first + n]), []).append((len(self.items), first))
            self.items.append((item, len(codes), len(parts) - 1, masks))
        self.at = at
        self.lengths = sorted({len(p) for p in at})
        self.bits = max(16, (16 * len(at)).bit_length())
        self.seen = {n: np.zeros(1 << self.bits, bool) for n in self.lengths}
        for n in self.lengths:
            grams = np.array([p for p in at if len(p) == n], np.uint64)
            self.seen[n][self._slots(self._rolled(grams.ravel(), n)[::n])] = True

    @staticmethod
    def _rolled(codes: np.ndarray, n: int) -> np.ndarray:
        """A hash of the n codes from each place on."""
        count = max(0, len(codes) - n + 1)
        out = np.zeros(count, np.uint64)
        for i in range(n):
            out = (out ^ codes[i : i + count]) * MIX
            out ^= out >> np.uint64(29)
        return out

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes * MIX >> np.uint64(64 - self.bits)).astype(np.int64)

    def matches(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(row of ``texts``, row of the items, distance, word after the match), one for each pair."""
        get, codes, starts, total = self.vocabulary.get, [], [], 0
        for text in texts:
            own = [get(w, 0) for w in words_of(text)]
            starts.append(total)
            codes += own
            codes.append(0)  # no word of an item: no piece reaches into the next text
            total += len(own) + 1
        flat = np.array(codes, np.uint64)
        first = np.array(starts + [total], np.int64)
        hits: dict[tuple[int, int], list[int]] = {}
        for n in self.lengths:
            for p in np.flatnonzero(self.seen[n][self._slots(self._rolled(flat, n))]).tolist():
                for item, offset in self.at.get(tuple(codes[p : p + n]), ()):
                    row = int(np.searchsorted(first, p, "right")) - 1
                    hits.setdefault((row, item), []).append(p - offset)
        out = []
        for (row, item), places in hits.items():
            _, m, k, masks = self.items[item]
            low, high, best, until = int(first[row]), int(first[row + 1]) - 1, None, -1
            for place in sorted(set(places)):
                begin, end = max(low, place - k, until - m - 2 * k), min(high, place + m + 2 * k)
                if end <= until:
                    continue
                found = myers(masks, m, codes[begin:end], k)
                until = end
                if found and (best is None or found[0] < best[0]):
                    best = found[0], begin + found[1] - low
            if best:
                out.append((row, item, *best))
        return out


def blocks(items: DataFrame, id_col: str, text_col: str, rate: float = RATE) -> Iterator[Block]:
    """The items, read one after another and cut into blocks of a fixed size."""
    held, size = [], 0
    for item, text in items.select(named(id_col).cast("long"), named(text_col).cast("string")).toLocalIterator():
        words = words_of(text)
        if not words:
            continue
        if held and size + len(words) > BLOCK_WORDS:
            yield Block(held, rate)
            held, size = [], 0
        held.append((item, words))
        size += len(words)
    if held:
        yield Block(held, rate)


def _found_in(block: Block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                found = block.matches(batch.column("text").to_pylist())
                columns = [pa.array([f[i] for f in found], pa.int64()) for i in range(4)]
                ids = batch.column("id").take(columns[0])
                item = [block.items[f[1]] for f in found]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([i[0] for i in item], pa.int64()), pa.array([i[1] for i in item], pa.int64()), columns[2], columns[3]],
                    names=["id", "item_id", "item_words", "distance", "end_word"],
                )

    return run


def contaminations(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE) -> DataFrame:
    """id, item_id, item_words, distance, end_word: a row for each document and item it holds."""
    texts = packed(docs, id_col, text_col).select("id", "text")
    schema = "id long, item_id long, item_words long, distance long, end_word long"
    parts = [texts.mapInArrow(_found_in(b), schema) for b in blocks(items, item_col, item_text_col, rate)]
    out = reduce(DataFrame.union, parts) if parts else docs.sparkSession.createDataFrame([], schema)
    return out.select(id_or_null("id").alias(id_col), "item_id", "item_words", "distance", "end_word")


def _holds(block: Block):
    def run(texts: pa.Array) -> pa.Array:
        marks = []
        for part in text_parts(texts):
            held = {f[0] for f in block.matches(part)}
            marks += [i in held for i in range(len(part))]
        return pa.array(marks, pa.bool_())

    return F.arrow_udf(run, "boolean")


def clean_of(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    for block in blocks(items, item_col, item_text_col, rate):
        docs = docs.filter(~_holds(block)(named(text_col)))
    return docs
