"""The language of documents, in two steps: the family first, then the language in it.

A text becomes the square roots of its shares of hashed byte 1-, 2- and 3-grams over
letters. One linear machine per family, each against the rest, chooses the family; in
it, linear support vector machines for each pair of languages vote. All machines are
trained on a bounded sample (``ROWS`` documents, shared equally between languages) with
squared hinge loss by accelerated gradient steps; their weights, a fixed number of
kilobytes each, travel with the tasks. Scoring is one pass without a shuffle.

Defined cases: a null text or one without a letter is "und" with score 0; documents
without a language teach nothing; with no language to learn all are "und"; languages
that no family names are families of their own; extra columns are carried along, those
named like the results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shockspan.llm.common import fold, named, sampled

ROWS, SIZE, PENALTY, STEPS = 6_000, 2048, 10.0, 150
#: Languages of families with more than one widely written member.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "bg", "sr"),
}
LETTER = regex.compile(r"\p{L}")
#: ASCII that is no letter becomes a blank.
LETTERS_ONLY = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
MIX = np.uint32(0x9E3779B1)


def grams(text: str) -> np.ndarray:
    """A unit vector of hashed n-grams; zeros if the text has no letter."""
    # words apart by one blank, so decoration between them makes no difference
    raw = np.frombuffer(b" " + b" ".join(text.lower().encode().translate(LETTERS_ONLY).split()) + b" ", np.uint8).astype(np.uint32)
    found = np.zeros(SIZE)
    code = np.zeros(len(raw), np.uint32)
    for n in range(1, 4):
        code = (code[: len(raw) - n + 1] << np.uint32(8)) | raw[n - 1 :]
        slots = ((code + np.uint32(n << 28)) * MIX) >> np.uint32(21)
        found += np.bincount(slots, minlength=SIZE) / max(1, len(code))
    found = np.sqrt(found)
    return (found / max(np.linalg.norm(found), 1e-12)).astype(np.float32)


def machine(x: np.ndarray, sign: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> np.ndarray:
    """Weights (the last one the offset) of a linear machine with squared hinge loss; classes weigh alike."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    sign = sign.astype(np.float32)
    weight = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum())).astype(np.float32)
    v = np.ones(x.shape[1], np.float32)
    for _ in range(20):
        v = x.T @ (weight * (x @ v))
        top = np.linalg.norm(v)
        v /= max(top, 1e-12)
    rate = 1 / (1 / len(x) + 2 * penalty * top)
    w = ahead = np.zeros(x.shape[1], np.float32)
    for k in range(steps):
        slack = np.maximum(0, 1 - sign * (x @ ahead))
        new = ahead - rate * (ahead / len(x) - 2 * penalty * (x.T @ (weight * sign * slack)))
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return w


@dataclass
class Languages:
    families: list[list[str]]
    choose: np.ndarray
    pairs: list[tuple[str, str]]
    within: np.ndarray

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        if not self.families:
            return [("und", 0.0)] * len(x)
        margin = 3 * (x @ self.choose.T)
        family = np.exp(margin - margin.max(1, keepdims=True))
        family /= family.sum(1, keepdims=True)
        wins = 1 / (1 + np.exp(-4 * (x @ self.within.T))) if self.pairs else np.zeros((len(x), 0))
        of = {pair: i for i, pair in enumerate(self.pairs)}
        out = []
        for row, best in enumerate(family.argmax(1).tolist()):
            members = self.families[best]
            shares = [np.prod([wins[row, of[a, b]] if (a, b) in of else 1 - wins[row, of[b, a]] for b in members if b != a]) for a in members]
            k = int(np.argmax(shares))
            out.append((members[k], float(family[row, best] * shares[k] / max(sum(shares), 1e-12))))
        return out


def trained(x: np.ndarray, langs: list[str], families: dict[str, tuple[str, ...]] = FAMILIES) -> Languages:
    home = {code: name for name, codes in families.items() for code in codes}
    groups: dict[str, list[str]] = {}
    for code in sorted(set(langs)):
        groups.setdefault(home.get(code, f"only {code}"), []).append(code)
    members, lang = list(groups.values()), np.array(langs, object)
    choose = [machine(x, np.where(np.isin(lang, m), 1, -1)) if len(members) > 1 else np.zeros(x.shape[1] + 1) for m in members]
    pairs = [p for m in members for p in combinations(m, 2)]
    within = []
    for a, b in pairs:
        rows = (lang == a) | (lang == b)
        within.append(machine(x[rows], np.where(lang[rows] == a, 1, -1)))
    return Languages(members, np.array(choose, np.float32), pairs, np.array(within, np.float32))


def fitted(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS) -> Languages:
    """Machines from the documents of which ``learn`` holds."""
    known = docs.select(named(id_col).alias("id"), named(text_col).alias("text"), named(lang_col).alias("lang"), learn.alias("learn"))
    known = known.filter("learn and lang is not null and text is not null").drop("learn")
    vectors = F.pandas_udf(lambda s: pd.Series([grams(t).astype("<f4").tobytes() for t in s]), "binary")
    chosen = sampled(known, F.col("id"), rows, F.col("lang")).select("id", "lang", vectors("text").alias("x"))
    got = chosen.toPandas().sort_values(["id", "lang"], kind="stable")
    x = np.frombuffer(b"".join(got["x"]), "<f4").reshape(-1, SIZE)
    return trained(x[x.any(axis=1)], got["lang"][x.any(axis=1)].tolist())


def predicted(model: Languages, text: Column) -> Column:
    """struct of lang_pred and score."""

    def run(texts: pd.Series) -> pd.DataFrame:
        out: list[tuple[str, float]] = []
        for i in range(0, len(texts), 256):
            part = texts.iloc[i : i + 256].tolist()
            lettered = [bool(t) and LETTER.search(t) is not None for t in part]
            x = np.stack([grams(t) if ok else np.zeros(SIZE, np.float32) for t, ok in zip(part, lettered, strict=True)])
            out += [p if ok else ("und", 0.0) for p, ok in zip(model.predict(x), lettered, strict=True)]
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    return F.pandas_udf(run, "lang_pred string, score double")(text)


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, held: int = 0) -> DataFrame:
    """All columns of ``docs`` and held_out, lang_pred, score; the held-out fold is never learnt from."""
    model = fitted(docs, fold(named(id_col), folds) != held, id_col, text_col, lang_col)
    rows = docs.select(*[named(c) for c in docs.columns if c not in ("held_out", "lang_pred", "score")], predicted(model, named(text_col)).alias("found"))
    held_out = F.coalesce(fold(named(id_col), folds) == held, F.lit(False))
    return rows.withColumns({"held_out": held_out, "lang_pred": F.col("found.lang_pred"), "score": F.col("found.score")}).drop("found")
