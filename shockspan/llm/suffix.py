"""Long byte strings that occur more than once are cut out of all documents.

Every byte covered by a string of ``length`` bytes that also starts anywhere else goes,
the first occurrence included.

1. Windows meet where they can match. In every window of ``length`` bytes the least
   hash of a 64-byte string (leftmost of equals) is its anchor; it depends on the
   window's bytes only, so equal windows have equal anchors at equal places. One pass
   over the texts gives, per anchor, the run of windows it stands for: a segment. Only
   hashes are shuffled. Anchors that occur once are dropped.
2. Equal segments are one variant with a count. Variants that occur twice or more are
   repeated in full, so copies are never compared, however many there are.
3. Where an anchor has several variants and some occur once, those variants' bytes are
   fetched, cut into 16-byte blocks counted from the anchor, and sorted by a suffix
   array over the blocks of many anchors at a time. Suffixes that share their first 24
   blocks form an interval; the 16 windows around those blocks are equal exactly where
   the 16 remaining bytes before and after them are, which is checked byte for byte.
4. An anchor with more than ``crowd`` variants (a passage that very many documents
   share in different surroundings; some 600,000 symbols for one task) has its windows
   hashed and counted by a grouped aggregate instead, with partial counts before the
   shuffle, so no task sorts more than that and no result is left out.

The suffix array is built by linear grouping (Baier, 2016). Suffixes start in groups by
first symbol. Groups are processed in descending order: each member's previous smaller
suffix is found along the pointers known so far, and those suffixes are moved, by how
many members point to them, into new groups right above their old ones; groups are then
ordered by Lyndon prefix. The second pass walks the array from its front and puts every
suffix at the next free place of its group, following the same pointers. No symbols are
renamed and nothing recurses.

Defined cases: a null text is empty; texts shorter than ``length`` keep everything;
rows of equal id and text are separate occurrences of each other; equal ids with other
texts are kept apart; a null id stays null; matches never cross documents; texts of
any length are worked through in parts that overlap by a window; extra columns are
carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockspan.llm.common import id_or_null, packed, slices, unpacked
from shockspan.session import stored

LENGTH, MARK, BLOCK, CROWD = 400, 64, 16, 16_384
#: Bytes of a text that are worked on at a time, and symbols sorted at a time.
PART, SYMBOLS = 1 << 22, 60_000
_rng = np.random.default_rng(20)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mark_hashes(octets: np.ndarray, mark: int = MARK) -> np.ndarray:
    """A hash of the ``mark`` bytes from every place on."""
    n = len(octets)
    up, down = _powers(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[octets] * up, dtype=np.uint64)])
    out = (sums[mark:] - sums[:-mark]) * down[: n - mark + 1]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def segments(octets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first, last) of every anchor; its windows start from first to last."""
    hashes = mark_hashes(octets)
    wide, m = length - MARK + 1, len(octets) - MARK + 1
    low = np.uint64((1 << 24) - 1)
    keys = np.full(-(-m // wide) * wide, ~np.uint64(0))
    keys[:m] = (hashes & ~low) | np.arange(m, dtype=np.uint64)
    rows = keys.reshape(-1, wide)
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    before = np.minimum.accumulate(rows, axis=1).ravel()
    count = m - wide + 1
    place = (np.minimum(after[:count], before[wide - 1 : wide - 1 + count]) & low).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
    last = np.concatenate([first[1:] - 1, [count - 1]])
    place = place[first]
    return hashes[place].view(np.int64), place, first, last


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                rows, keys, variants, places, firsts, lasts = [], [], [], [], [], []
                for k, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                    n = len(text or b"")
                    for at in range(0, n - length + 1, PART):
                        data = text[at : at + PART + length - 1]
                        if len(data) < length:
                            continue
                        key, place, first, last = segments(np.frombuffer(data, np.uint8), length)
                        rows.append(np.full(len(key), k))
                        keys.append(key)
                        places.append(place + at)
                        firsts.append(first + at)
                        lasts.append(last + at)
                        variants += [
                            xxhash.xxh3_64_intdigest(data[a : b + length], p - a)
                            for p, a, b in zip(place.tolist(), first.tolist(), last.tolist(), strict=True)
                        ]
                if rows:
                    row = pa.array(np.concatenate(rows))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate(keys)), pa.array(np.array(variants, np.uint64).view(np.int64)),
                            batch.column("id").take(row), batch.column("th").take(row),
                            *[pa.array(np.concatenate(x)) for x in (places, firsts, lasts)],
                        ],
                        names=["anchor", "variant", "id", "th", "place", "first", "last"],
                    )

    return run


def suffix_array(text: list[int]) -> list[int]:
    """Suffixes in order. ``text`` ends with a symbol below all others that occurs once."""
    n = len(text)
    order = np.argsort(np.array(text), kind="stable")
    ranked = np.array(text)[order]
    heads = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    group = np.repeat(heads, np.diff(np.append(heads, n)))
    start, at = np.empty(n, np.int64), np.empty(n, np.int64)
    start[order], at[order] = group, np.arange(n)
    order, start, at = order.tolist(), start.tolist(), at.tolist()
    end = dict(zip(heads.tolist(), [*heads[1:].tolist(), n], strict=True))
    smaller, high = [-1] * n, n
    while high > 0:
        g = start[order[high - 1]]
        members = order[g:high]
        members.sort()
        pointed: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and start[j] >= g:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for j, times in pointed.items():
            moved.setdefault((times, start[j]), []).append(j)
        for key in sorted(moved, reverse=True):
            old, those = key[1], moved[key]
            stop = e = end[old]
            if stop - old == len(those):
                continue
            for j in those:
                e -= 1
                k, other = at[j], order[e]
                order[k], at[other] = other, k
                order[e], at[j] = j, e
            for j in those:
                start[j] = e
            end[old], end[e] = e, stop
        high = g
    out, free, done = [0] * n, list(range(n)), [False] * n
    out[0], done[n - 1] = n - 1, True
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not done[j]:
            s = start[j]
            out[free[s]] = j
            free[s] += 1
            done[j] = True
            j = smaller[j]
    return out


def _ranks(*columns: np.ndarray) -> np.ndarray:
    """Dense ranks of rows in lexicographic order of their columns."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        own = c[order]
        new[1:] |= own[1:] != own[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def shared_windows(groups: list[int], parts: list[bytes], marks: list[int], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(row, start in its part) of the windows that another part of the same group holds, at the same distance from its mark.

    ``marks``: place of the anchor in each part.
    """
    flat = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts])
    begin, mark, wide = np.cumsum(sizes) - sizes, np.array(marks), length // BLOCK - 1
    lead = mark % BLOCK
    blocks = (sizes - lead) // BLOCK
    row = np.repeat(np.arange(len(parts)), blocks)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = begin[row] + lead[row] + BLOCK * nth
    words = np.ascontiguousarray(flat[at[:, None] + np.arange(BLOCK)]).view("<u8")
    symbols = _ranks(np.array(groups)[row], nth - mark[row] // BLOCK, words[:, 0], words[:, 1]) + 2
    # the blocks of a part, then a mark of its end; last the least symbol
    to = np.arange(len(row)) + row
    text = np.ones(len(row) + len(parts) + 1, np.int64)
    text[to], text[-1] = symbols, 0
    of = np.full(len(text), -1)
    of[to] = np.arange(len(row))
    order = of[np.array(suffix_array(text.tolist()))]
    order = order[order >= 0]
    order = order[nth[order] + wide <= blocks[row[order]]]
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    seen = symbols[order[:, None] + np.arange(wide)]
    interval = np.concatenate([[0], np.cumsum((seen[1:] != seen[:-1]).any(axis=1))])
    many = np.bincount(interval)[interval] > 1
    order, interval = order[many], interval[many]
    found = []
    for part, within in _batches(order, interval):
        # a window starts e bytes before its first whole block
        e, j = np.arange(BLOCK)[None, :, None], np.arange(BLOCK)[None, None, :]
        where = at[part][:, None, None] - e + j + np.where(j >= e, wide * BLOCK, 0)
        starts = (at[part] - begin[row[part]])[:, None] - np.arange(BLOCK)
        fits = (starts >= 0) & (starts + length <= sizes[row[part]][:, None])
        edge = flat[np.clip(where, 0, len(flat) - 1, out=where)].view("<u8")
        k, shift = np.nonzero(fits)
        rank = _ranks(within[k], shift, edge[k, shift, 0], edge[k, shift, 1])
        twice = np.bincount(rank)[rank] > 1 if len(rank) else np.zeros(0, bool)
        found.append((row[part[k[twice]]], starts[k[twice], shift[twice]]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _batches(order: np.ndarray, interval: np.ndarray, most: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Whole intervals, about ``most`` suffixes at a time, so the checks take little memory."""
    heads = np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]])) if len(order) else []
    begin = 0
    for stop in [*heads[1:], len(order)]:
        if stop - begin >= most or stop == len(order):
            if stop > begin:
                yield order[begin:stop], interval[begin:stop]
            begin = stop


SPAN = "id long, th long, a long, b long"


def _compared(length: int):
    """Rows in the order of their anchor -> spans of repeated windows of the variants that occur once."""

    def spans(rows: list[tuple]) -> pa.RecordBatch:
        anchor = np.array([r[0] for r in rows])
        row, start = shared_windows(anchor.tolist(), [r[5] for r in rows], [r[4] for r in rows], length)
        single = np.array([r[1] == 1 for r in rows])
        row, start = row[single[row]], start[single[row]]
        order = np.lexsort((start, row))
        row, start = row[order], start[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
        first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(row)) - 1
        base = np.array([r[6] for r in rows], np.int64)[row[first]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[k][2] for k in row[first].tolist()], pa.int64()), pa.array([rows[k][3] for k in row[first].tolist()], pa.int64()),
                pa.array(base + start[first]), pa.array(base + start[last[: len(first)]] + length),
            ],
            names=["id", "th", "a", "b"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("anchor", "n", "id", "th", "mark", "part", "first")]
            for row in zip(*columns, strict=True):
                if size > SYMBOLS and held[-1][0] != row[0]:
                    yield spans(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5]) // BLOCK + 1
        if held:
            yield spans(held)

    return run


def _cut(length: int):
    """Texts with the places of their variants -> the variants' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "n", "place", "first", "last", "crowded"]
        for whole in batches:
            for batch in slices(whole):
                texts = batch.column("text").cast(pa.binary()).to_pylist()
                wanted = batch.column("wanted")
                row = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(wanted).to_numpy(zero_copy_only=False))
                flat = pa.compute.list_flatten(wanted)
                anchor, n, place, first, last, crowded = (flat.field(i) for i in range(len(names)))
                parts = [texts[k][a : b + length] for k, a, b in zip(row.tolist(), first.to_pylist(), last.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        anchor, n, batch.column("id").take(pa.array(row)), batch.column("th").take(pa.array(row)),
                        pa.compute.subtract(place, first), pa.array(parts, pa.binary()), first, crowded,
                    ],
                    names=["anchor", "n", "id", "th", "mark", "part", "first", "crowded"],
                )

    return run


def _hashed(length: int):
    """Variants -> a hash of each of their windows, with its distance from the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (mark, part) in enumerate(zip(batch.column("mark").to_pylist(), batch.column("part").to_pylist(), strict=True)):
                count = len(part) - length + 1
                hashes = [xxhash.xxh3_64_intdigest(part[i : i + length]) for i in range(count)]
                same = pa.array(np.full(count, k))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("anchor").take(same), pa.array(np.arange(count) - mark), pa.array(np.array(hashes, np.uint64).view(np.int64)),
                        *[batch.column(c).take(same) for c in ("n", "id", "th")],
                        pa.array(np.arange(count) + batch.column("first")[k].as_py()),
                    ],
                    names=["anchor", "shift", "hash", "n", "id", "th", "a"],
                )

    return run


def repeated_spans(base: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """id, th, a, b: byte ranges that repeated strings cover; they may overlap. ``base``: id, th, text."""
    marks = "anchor long, variant long, id long, th long, place long, first long, last long"
    found = stored(base.mapInArrow(_anchors(length), marks), "anchors")
    again = stored(found.groupBy("anchor").count().filter("count > 1").select("anchor"), "again")
    found = stored(found.join(again, "anchor", "left_semi"), "met")
    one = F.min(F.struct("id", "th", "place", "first", "last")).alias("one")
    variants = stored(found.groupBy("anchor", "variant").agg(F.count(F.lit(1)).alias("n"), one), "variants")
    whole = stored(variants.filter("n > 1").select("anchor", "variant"), "whole")
    spans = found.join(whole, ["anchor", "variant"], "left_semi").select("id", "th", F.col("first").alias("a"), (F.col("last") + length).alias("b"))
    mixed = variants.groupBy("anchor").agg(F.count(F.lit(1)).alias("v"), F.min("n").alias("least")).filter("v > 1 and least = 1")
    mixed = stored(mixed.select("anchor", (F.col("v") > crowd).alias("crowded")), "mixed")
    wanted = variants.join(mixed, "anchor").select("one.id", "one.th", F.struct("anchor", "n", "one.place", "one.first", "one.last", "crowded").alias("w"))
    wanted = stored(wanted.groupBy("id", "th").agg(F.collect_list("w").alias("wanted")), "wanted")
    cut = "anchor long, n long, id long, th long, mark long, part binary, first long, crowded boolean"
    parts = stored(base.join(wanted, ["id", "th"]).select("id", "th", "text", "wanted").mapInArrow(_cut(length), cut), "parts")
    quiet = parts.filter("not crowded").repartition("anchor").sortWithinPartitions("anchor")
    spans = spans.union(quiet.mapInArrow(_compared(length), SPAN))
    crowds = parts.filter("crowded").repartition(F.xxhash64("anchor", "id", "first"))
    windows = crowds.mapInArrow(_hashed(length), "anchor long, shift long, hash long, n long, id long, th long, a long")
    shared = windows.groupBy("anchor", "shift", "hash").agg(F.count(F.lit(1)).alias("v")).filter("v > 1").drop("v")
    shared = stored(shared, "shared-windows")
    single = windows.filter("n = 1").join(shared, ["anchor", "shift", "hash"], "left_semi")
    return spans.union(single.select("id", "th", "a", (F.col("a") + length).alias("b")))


def _without(texts: pd.Series, firsts: pd.Series, lasts: pd.Series) -> pd.DataFrame:
    out = []
    for text, a, b in zip(texts, firsts, lasts, strict=True):
        if text is None or a is None:
            out.append((None, None, None))
            continue
        order = np.argsort(a, kind="stable")
        a, b = np.asarray(a)[order], np.maximum.accumulate(np.asarray(b)[order])
        head = np.concatenate([[True], a[1:] > b[:-1]])
        begin, stop = a[head], b[np.append(np.flatnonzero(head)[1:] - 1, len(b) - 1)]
        edges = [0, *np.stack([begin, stop], 1).ravel().tolist(), len(text)]
        kept = b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
        out.append((kept, int((stop - begin).sum()), len(begin)))
    frame = pd.DataFrame(out, columns=["kept", "n_removed", "n_spans"])
    return frame.astype({"n_removed": "Int64", "n_spans": "Int64"})


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """All input columns with ``kept`` (the bytes that stay), n_bytes, n_removed and n_spans (maximal removed runs)."""
    if length < 2 * MARK or length % BLOCK:
        raise ValueError(f"length must be a multiple of {BLOCK}, {2 * MARK} at least")
    base = packed(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
    spans = repeated_spans(base.filter(F.octet_length("text") >= length).select("id", "th", "text"), length, crowd)
    spans = stored(spans.distinct().groupBy("id", "th").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b")), "spans")
    out = base.join(spans, ["id", "th"], "left")
    out = out.withColumn("octets", F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    cut_out = F.pandas_udf(_without, "kept binary, n_removed long, n_spans long")
    out = out.withColumn("made", cut_out(F.when(F.col("a").isNotNull(), F.col("octets")), "a", "b"))
    return unpacked(
        out, docs.columns,
        {
            id_col: id_or_null("id"),
            "kept": F.coalesce("made.kept", "octets"),
            "n_bytes": F.octet_length("octets").cast("long"),
            "n_removed": F.coalesce("made.n_removed", F.lit(0).cast("long")),
            "n_spans": F.coalesce("made.n_spans", F.lit(0).cast("long")),
        },
    )
