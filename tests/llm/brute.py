"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

BLANKS = " \t\n\x0b\x0c\r"


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def line_dedup(docs, min_chars=10, max_docs=1):
    """docs: (id, text) pairs -> list of (id, n_lines, n_dropped, kept)."""
    keyed = [(i, [(line, ascii_lower(line.strip(BLANKS))) for line in (t or "").split("\n")]) for i, t in docs]
    holders = defaultdict(set)
    for i, lines in keyed:
        for _, key in lines:
            if len(key) >= min_chars:
                holders[key].add(i)
    out = []
    for i, lines in keyed:
        kept = [line for line, key in lines if len(holders.get(key, ())) <= max_docs or min(holders[key]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", ascii_lower(text or "").encode())
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes)) if hashes else 0


def components(prints):
    """{id: fingerprint} -> {id: smallest id reachable by links of at most 2 bits}."""
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def least_edits(item, text):
    """Least edit distance of ``item`` to any run of words of ``text``."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (w != x)))
        row = new
    return min(row)


def contaminations(docs, items, rate=0.2):
    """Set of (doc id, item id, distance)."""
    out = set()
    for i, t in docs:
        text = words(t)
        for k, s in items:
            item = words(s)
            if item and (d := least_edits(item, text)) <= int(len(item) * rate + 1e-9):
                out.add((i, k, d))
    return out


def without_repeats(docs, length=400):
    """list of (id, n_bytes, n_removed, n_spans, kept) with every repeated byte string cut out."""
    octets = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(b[a : a + length] for _, b in octets for a in range(len(b) - length + 1))
    out = []
    for i, b in octets:
        covered = bytearray(len(b))
        for a in range(len(b) - length + 1):
            if seen[b[a : a + length]] > 1:
                covered[a : a + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, covered, strict=True) if not c)
        out.append((i, len(b), sum(covered), len(re.findall(b"\1+", bytes(covered))), kept))
    return out
