"""Near-duplicate documents by SimHash fingerprints, found with anchor points.

A fingerprint has 64 bits; bit j is 1 if it is set in over half of the XXH64 hashes of
the text's 3-word shingles. Equal fingerprints are one class, so copies are never
compared. Classes at most two bits apart are linked and links make components.

Links are searched with a covering code as anchors: the product of two perfect binary
Golay codes over 23 bits each, the low and the next 23 bits of a fingerprint. Every
23-bit word lies within 3 bits of exactly one codeword, so a fingerprint has one home
anchor within the covering radius. A fingerprint two bits away from it is, in each
block, at most 3 plus its differing bits away from that anchor; every fingerprint is
therefore replicated to all anchors within covering radius plus threshold (61 of 2^24
on average) and compared at each with the fingerprints at home there. This finds
every link, whatever the remaining 18 bits are, for the full distance is checked.

An anchor that is home to over ``crowd`` distinct fingerprints is not compared pair by
pair: two fingerprints are two bits apart at most exactly if they share a word at most
one bit from both, so the 65 such words of every fingerprint replicated to a crowded
anchor are grouped (at most 65 fingerprints can meet at a word) and each is linked to
the least fingerprint there. This is exact as well.

Defined cases: a null, empty or blank text has fingerprint 0 and is linked like any
other; fewer than three words are one shingle; a null id sorts after all others;
repeated rows share their class; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockspan.llm.common import NO_ID, id_or_null, packed, slices, trimmed
from shockspan.llm.components import roots
from shockspan.session import stored

SEED, SHINGLE, DISTANCE, CROWD = 42, 3, 2, 64
BLOCK, RADIUS = 23, 3
#: Generator polynomial of the perfect Golay code.
GOLAY = 0b110001110101


def fingerprint(text: str | None) -> int:
    """Words between ASCII white space, A-Z lower-cased, in shingles with repeats."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - SHINGLE + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[-n:].tolist() if len(words) >= SHINGLE else [len(joined)]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, n, 1 << 16):
        part = [digest(joined[a:b], SEED) for a, b in zip(begins[i : i + (1 << 16)], ends[i : i + (1 << 16)], strict=True)]
        octets = np.array(part, "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole):
            prints = pa.array([fingerprint(t) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), prints], names=["id", "th", "fp"])


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial; 0 for codewords."""
    left = words.astype(np.int64)
    for bit in range(BLOCK - 1, 10, -1):
        left = np.where(left >> bit & 1, left ^ (GOLAY << (bit - 11)), left)
    return left


@cache
def _offsets() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By bits beyond the covering radius (0, 1, 2): error patterns, first and count by syndrome."""
    patterns = [[0], [], []]
    for weight in range(1, RADIUS + DISTANCE + 1):
        patterns[max(0, weight - RADIUS)] += [sum(1 << b for b in bits) for bits in combinations(range(BLOCK), weight)]
    out = []
    for found in patterns:
        errors = np.array(found, np.int64)
        syndromes = _syndromes(errors)
        order, count = np.argsort(syndromes, kind="stable"), np.bincount(syndromes, minlength=2048)
        out.append((errors[order], np.cumsum(count) - count, count))
    return out


def anchors(prints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All anchors within the covering radius plus ``most`` bits: (row of ``prints``, anchor)."""
    blocks = [prints & ((1 << BLOCK) - 1), prints >> BLOCK & ((1 << BLOCK) - 1)]
    syndromes = [_syndromes(b) for b in blocks]
    rows, found = [], []
    for over in range(most + 1):
        for more in range(most - over + 1):
            (e1, f1, c1), (e2, f2, c2) = _offsets()[over], _offsets()[more]
            n1, n2 = c1[syndromes[0]], c2[syndromes[1]]
            total = n1 * n2
            row = np.repeat(np.arange(len(prints)), total)
            k = np.arange(len(row)) - np.repeat(np.cumsum(total) - total, total)
            i, j = np.divmod(k, np.maximum(n2[row], 1))
            low = blocks[0][row] ^ e1[f1[syndromes[0][row]] + i]
            high = blocks[1][row] ^ e2[f2[syndromes[1][row]] + j]
            rows.append(row)
            found.append(high << BLOCK | low)
    return np.concatenate(rows), np.concatenate(found)


def _anchored(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("fp").to_numpy()
            for i in range(0, len(prints), 8192):
                part = prints[i : i + 8192]
                row, found = anchors(part, most)
                yield pa.RecordBatch.from_arrays([pa.array(part[row]), pa.array(found)], names=["fp", "anchor"])

    return run


def near_links(classes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """a, b: links between distinct fingerprints that hold all of their components together.

    ``classes``: distinct fingerprints fp. Spark takes the replicas for as few as the
    fingerprints they are made of and would broadcast them, so their join is a merge.
    """
    prints = classes.select("fp")
    home = prints.mapInArrow(trimmed(_anchored(0)), "fp long, anchor long")
    reached = prints.mapInArrow(trimmed(_anchored(DISTANCE)), "fp long, anchor long")
    crowded = stored(home.groupBy("anchor").count().filter(F.col("count") > crowd).select("anchor"), "crowded")
    quiet = home.join(crowded, "anchor", "left_anti").select("anchor", F.col("fp").alias("a"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= DISTANCE
    links = quiet.join(reached.hint("merge"), "anchor").filter(near & (F.col("a") != F.col("fp"))).select("a", F.col("fp").alias("b"))
    members = reached.join(crowded, "anchor", "left_semi").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << b) if b < 63 else -(1 << 63)).cast("long") for b in range(64)])
    words = stored(members.select("fp", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("word")), "words")
    least = stored(words.groupBy("word").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).filter("a <> z").select("word", "a"), "least-at-word")
    met = words.join(least, "word").filter("a <> fp").select("a", F.col("fp").alias("b"))
    return links.union(met)


def _classified(docs: DataFrame, id_col: str, text_col: str, crowd: int) -> DataFrame:
    """id, th (a hash of the text), fp and component, the least id of the component, of every row."""
    base = packed(docs, id_col, text_col).select("id", "text", F.xxhash64("text").alias("th"))
    prints = stored(base.mapInArrow(trimmed(_fingerprints), "id long, th long, fp long"), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    root = roots(near_links(classes, crowd))
    rooted = classes.join(root, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted, "rooted")
    heads = stored(rooted.groupBy("root").agg(F.min("first").alias("component")), "heads")
    of = stored(rooted.join(heads, "root").select("fp", "component"), "component-of")
    return prints.join(of, "fp")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """id, fingerprint (16 hex digits), component_id for every row of ``docs``."""
    return _classified(docs, id_col, text_col, crowd).select(
        id_or_null("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        id_or_null("component").alias("component_id"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """The rows of ``docs`` whose id is the least of its component, all columns.

    Of rows equal in id and text one stays; rows of that id with other texts all stay.
    """
    kept = _classified(docs, id_col, text_col, crowd).filter("id = component").select("id", "th").distinct()
    rows = packed(docs, id_col, text_col).withColumn("th", F.xxhash64("text")).drop("text")
    rows = rows.join(stored(kept, "kept"), ["id", "th"], "left_semi")
    rows = rows.groupBy("id", "th").agg(F.any_value("row").alias("row"))
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])
