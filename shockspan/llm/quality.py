"""A quality classifier: histogram gradient-boosted trees over document statistics.

Every document is summed up in some twenty statistics of its bytes, words and lines.
Trees are grown on a bounded sample of labelled documents (``ROWS``), level by level
from histograms of at most ``BINS`` quantile bins per statistic, on logistic loss. The
trees are complete and flattened into arrays (statistic, threshold, leaf value), so a
batch of documents walks all trees at once in numpy. The model is a few kilobytes and
travels with the tasks; scoring is one pass without a shuffle.

Defined cases: a null or empty text has all statistics 0 and is scored from them;
labels that are null are ignored, of several labels of an id the largest counts;
labelled ids without a document are ignored; with one class only every score is that
class, with no label at all 0.5; a null id is never learnt from; extra columns are
carried along, those named like the results are replaced.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shockspan.llm.common import fold, named, sampled

ROWS, TREES, DEPTH, BINS, STEP, RIDGE, LEAST = 20_000, 60, 4, 64, 0.2, 1.0, 8
THRESHOLD = 0.3
STATISTICS = (
    "log_bytes upper lower digit blank newline symbol bar bang stop comma high log_words word_length word_spread distinct "
    "same_as_last commonest titled shouted marked lines same_lines line_length"
).split()


def _class(characters: bytes) -> np.ndarray:
    return np.array(list(characters))


UPPER, LOWER, DIGIT = _class(bytes(range(65, 91))), _class(bytes(range(97, 123))), _class(bytes(range(48, 58)))
SYMBOL, STOP, COMMA, BLANK = _class(b"#*$%&<>@^~=+_\\"), _class(b".?;:"), _class(b","), _class(b" \t\r\x0b\x0c")


def statistics(text: str | None) -> list[float]:
    if not text:
        return [0.0] * len(STATISTICS)
    raw = text.encode()
    n = len(raw)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = text.split(), [line for line in text.split("\n") if line.strip()]
    shares = [seen[c].sum() / n for c in (UPPER, LOWER, DIGIT, BLANK)]
    shares += [seen[10] / n, seen[SYMBOL].sum() / n, seen[124] / n, seen[33] / n, seen[STOP].sum() / n, seen[COMMA].sum() / n, seen[128:].sum() / n]
    m, k = max(1, len(words)), max(1, len(lines))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    own = Counter(words)
    return [
        float(np.log1p(n)), *shares, float(np.log1p(len(words))), lengths.mean(), lengths.std(), len(own) / m,
        sum(map(eq, words, words[1:])) / m, max(own.values(), default=0) / m, sum(map(str.istitle, words)) / m,
        sum(map(str.isupper, words)) / m, sum(not w[-1].isalnum() for w in words) / m,
        float(np.log1p(len(lines))), 1 - len(set(lines)) / k, float(np.log1p(n / k)),
    ]


@dataclass
class Trees:
    """Complete trees as arrays: statistic and threshold of inner nodes, values of leaves."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        trees, inner = self.feature.shape
        if trees:
            node, tree = np.zeros((len(x), trees), np.int64), np.arange(trees)
            rows = np.arange(len(x))[:, None]
            for _ in range((inner + 1).bit_length() - 1):
                node = 2 * node + 1 + (x[rows, self.feature[tree, node]] > self.threshold[tree, node])
            out = out + self.value[tree, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-out))


def grown(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, step: float = STEP, ridge: float = RIDGE, least: int = LEAST) -> Trees:
    """Boosted trees on logistic loss; ``x`` rows by statistics, ``y`` 0 or 1."""
    inner = 2**depth - 1
    rate = y.mean() if len(y) else 0.5
    if rate in (0.0, 1.0) or not len(y):
        base = 0.0 if not len(y) else (20.0 if rate else -20.0)
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    model = Trees(float(np.log(rate / (1 - rate))), np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    raw = np.full(len(y), model.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        slope, curve = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best, choice = np.zeros(width), [(0, -1)] * width
            for f, cuts in enumerate(edges):
                if not len(cuts):
                    continue
                slot, size = (node - first) * (bins + 1) + binned[:, f], width * (bins + 1)
                g, h, c = (np.bincount(slot, w, size).reshape(width, -1) for w in (slope, curve, None))
                gl, hl, cl = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1], c.cumsum(1)[:, :-1]
                gs, hs, cs = g.sum(1, keepdims=True), h.sum(1, keepdims=True), c.sum(1, keepdims=True)
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                gain[(cl < least) | (cs - cl < least)] = 0
                gain = gain[:, : len(cuts)]
                k = gain.argmax(1)
                for j in np.flatnonzero(gain[np.arange(width), k] > best + 1e-12):
                    best[j], choice[j] = gain[j, k[j]], (f, int(k[j]))
            for j, (f, k) in enumerate(choice):
                if k >= 0:
                    model.feature[t, first + j], model.threshold[t, first + j] = f, edges[f][k]
            right = x[np.arange(len(y)), model.feature[t, node]] > model.threshold[t, node]
            node = 2 * node + 1 + right
        leaf = node - inner
        g, h = np.bincount(leaf, slope, inner + 1), np.bincount(leaf, curve, inner + 1)
        model.value[t] = -step * g / (h + ridge)
        raw += model.value[t][leaf]
    return model


def best_label(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    rows = labels.select(named(id_col).cast("long").alias("label_id"), named(label_col).alias("label"))
    return rows.filter("label is not null and label_id is not null").groupBy("label_id").agg(F.max("label").cast("int").alias("label"))


def fitted(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = ROWS) -> Trees:
    """Trees from labelled documents; ``learn`` says of a label (its ``label_id``) if it may be learnt from."""
    marks = sampled(best_label(labels, id_col, label_col).filter(learn), F.col("label_id"), rows)
    texts = docs.select(named(id_col).cast("long").alias("label_id"), named(text_col).alias("text"))
    chosen = texts.join(F.broadcast(marks), "label_id")  # the sample is bounded
    measure = F.pandas_udf(lambda s: pd.Series([statistics(t) for t in s]), "array<double>")
    got = chosen.select("label_id", "label", measure("text").alias("x")).toPandas().sort_values("label_id", kind="stable")
    x = np.array(got["x"].tolist(), float).reshape(-1, len(STATISTICS))
    return grown(x, got["label"].to_numpy(float))


def score(model: Trees, text: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        x = np.array([statistics(t) for t in texts], float).reshape(-1, len(STATISTICS))
        return pd.Series(model.score(x))

    return F.pandas_udf(run, "double")(text)


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 0) -> DataFrame:
    """All columns of ``docs`` and held_out, score, predicted; the held-out fold is never learnt from."""
    model = fitted(docs, labels, fold(F.col("label_id"), folds) != held, id_col, text_col)
    rows = docs.select(*[named(c) for c in docs.columns if c not in ("held_out", "score", "predicted")], score(model, named(text_col)).alias("score"))
    held_out = F.coalesce(fold(named(id_col), folds) == held, F.lit(False))
    return rows.withColumns({"held_out": held_out, "predicted": (F.col("score") >= THRESHOLD).cast("int")})
