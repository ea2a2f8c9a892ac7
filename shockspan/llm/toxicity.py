"""Toxicity by weak supervision: many voters, a label model, a linear classifier.

Voters. A general lexicon of insults and a few patterns vote on every text. Further
voters are words and stems (first 4 to 8 letters, for insults come inflected) that labelled
toxic documents hold many times more often than others: candidates are counted over a bounded
sample of labelled documents by a grouped aggregate, then taken one by one while they
explain toxic documents that few earlier voters explain, so the many rare words that
copies of a toxic document share do not crowd in.

Label model. For a hidden class, each voter's chances of firing in toxic and in other
documents, that is its accuracy, are estimated by expectation maximisation over all
documents that may be learnt from: labelled ones enter with their label held, the others
with the model's own belief. Spark counts how often each pattern of votes and label
occurs; a step is one grouped aggregate over these counts, of which a row per voter comes
back. Correlations of voters within a class are measured in every round, and a voter's
evidence is divided by its correlation with the rest, so a word and the pattern that
contains it do not count twice.

Classifier. A logistic regression on the votes of the sample, learnt from the label model's
posterior shares, gives the score. Sampled documents weigh by how many labels of their class
there are for each that was drawn, so scores do not depend on where the sample's bound cuts.
The model is a few kilobytes and travels with the tasks; scoring is one pass without a shuffle.

Defined cases: a null or empty text has no vote but the one of finding nothing; labels
that are null are ignored, of several labels of an id the largest counts; without
labels the lexicon's prior accuracies stand; a null id is never learnt from; extra
columns are carried along, those named like the results are replaced.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shockspan.llm.common import fold, give_back, named, sampled, text_parts, trimmed
from shockspan.llm.quality import best_label
from shockspan.session import stored

#: Labelled documents of each class, and mined words, at most.
LABELLED, MINED = 8_000, 400
#: Words that a task counts before it hands the counts on.
HELD = 100_000
CANDIDATES, SUPPORT, LIFT, COVER, STEMS = 30_000, 4, 12.0, 8, (4, 5, 6, 7, 8)
THRESHOLD = 0.7
#: The share of toxic that a label of its own stands for.
SURE = 0.97
LEXICON = (
    "idiot", "idiots", "moron", "morons", "stupid", "loser", "losers", "scum", "trash", "worthless", "pathetic", "disgusting", "clown",
    "dumb", "imbecile", "vermin", "filth", "retard", "bastard", "bitch", "asshole", "whore", "slut", "fuck", "fucking", "shit", "crap",
    "idiota", "imbécil", "estúpido", "basura", "asqueroso", "patético", "escoria", "mierda",
    "idiote", "imbécile", "stupide", "ordure", "pathétique", "dégoûtant", "connard", "merde", "salaud",
    "trottel", "dumm", "abschaum", "müll", "erbärmlich", "ekelhaft", "wertlos", "arschloch", "scheiße", "versager",
)
WORD = re.compile(r"[^\W\d_]+")
MASKED = re.compile(r"\b[a-z]{1,2}[*@#$]{2,}[a-z]{0,3}\b")
AIMED = re.compile(r"\b(?:you|your|they|he|she|tu|vous|du|ihr|eres) (?:are|is|re|es|êtes|bist|seid|son)\b")
PATTERNS = ("masked word", "aimed at somebody", "shouted", "many exclamations", "two different words", "three words", "one in fifty", "nothing found")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def stems_of(place: dict[str, int]) -> set[int]:
    """The lengths of the stems among the voters; a stem ends in a star."""
    return {len(w) - 1 for w in place if w.endswith("*")}


def hits(words: list[str], place: dict[str, int], lengths: set[int]) -> Counter:
    """How often each voter's word or stem occurs."""
    own = Counter(w for w in words if w in place)
    for n in lengths:
        own.update(x for w in words if (x := w[:n] + "*") in place)
    return own


def votes(text: str | None, place: dict[str, int], lengths: set[int]) -> list[int]:
    """The voters that fire: places of words and stems, then of patterns."""
    words = words_of(text)
    own = hits(words, place, lengths)
    n, total = len(place), sum(own.values())
    fired = [place[w] for w in own]
    tests = [False] * len(PATTERNS)
    if text:
        low = text.lower()
        tests[0], tests[1] = MASKED.search(low) is not None, AIMED.search(low) is not None
        tests[2], tests[3] = text.isupper(), 20 * text.count("!") > len(words)
    tests[4], tests[5], tests[6], tests[7] = len(own) > 1, total > 2, 50 * total >= max(1, len(words)), not total
    return fired + [n + i for i, hit in enumerate(tests) if hit]


@dataclass
class Voters:
    place: dict[str, int]
    weight: np.ndarray

    def score(self, fired: list[list[int]]) -> np.ndarray:
        raw = np.array([self.weight[f].sum() for f in fired]) + self.weight[-1]
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


@dataclass
class Beliefs:
    """What the label model knows: chances of firing in other and in toxic documents, and
    by how much each voter's evidence is discounted; ``base`` is the share of toxic ones."""

    chance: np.ndarray
    discount: np.ndarray
    base: float

    def evidence(self) -> tuple[np.ndarray, float]:
        """Log-odds that a vote adds, and those of a document without any."""
        ratio = np.log(self.chance[1] / self.chance[0]) * self.discount
        silent = np.log((1 - self.chance[1]) / (1 - self.chance[0])) * self.discount
        return ratio - silent, float(np.log(self.base / (1 - self.base)) + silent.sum())

    def share(self, x: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Posterior shares of toxic for rows of votes; a label is one more voter, wrong now and then."""
        weight, offset = self.evidence()
        belief = 1 / (1 + np.exp(-np.clip(x @ weight + offset, -30, 30)))
        sure = np.where(label == 1, SURE, np.where(label == 0, 1 - SURE, 0.5))
        return belief * sure / (belief * sure + (1 - belief) * (1 - sure))


@dataclass
class Sums:
    """Over documents: how many, their shares of toxic and the squares of these; per voter, over those it fires in, the first two."""

    total: np.ndarray
    by_voter: np.ndarray


def label_model(measure: Callable[[Beliefs | None], Sums], together: np.ndarray, prior: np.ndarray, base: float | None, rounds: int = 25) -> Beliefs:
    """Accuracies and correlations from counts.

    ``measure`` adds up the documents under given beliefs, or the labelled ones alone under
    none; ``together`` counts the documents in which two voters fire; ``prior`` holds chances
    before any count, and ``base`` the share of toxic labels, None without labels.
    """
    strength = 4.0
    now = Beliefs(prior.copy(), np.ones(prior.shape[1]), 0.1 if base is None else float(np.clip(base, 0.01, 0.99)))
    for step in range(rounds):
        own = step == 0 and base is not None
        sums = measure(None if own else now)
        n, toxic, squares = sums.total
        fired, fired_toxic = sums.by_voter.T
        totals = np.array([n - toxic, toxic])
        now.chance = (np.stack([fired - fired_toxic, fired_toxic]) + strength * prior) / (totals[:, None] + strength)
        now.chance = np.clip(now.chance, 1e-5, 1 - 1e-5)
        if own:
            continue
        # correlation within the classes, as votes differ from their class's chance
        low, rise = now.chance[0], now.chance[1] - now.chance[0]
        mixed = np.outer(fired, low) + np.outer(fired_toxic, rise)
        expected = n * np.outer(low, low) + toxic * (np.outer(low, rise) + np.outer(rise, low)) + squares * np.outer(rise, rise)
        cov = (together - mixed - mixed.T + expected) / max(n, 1)
        sd = np.sqrt(np.maximum(np.diag(cov), 0)) + 1e-9
        tied = np.clip(cov / sd[:, None] / sd[None, :], 0, 1)
        tied[tied < 0.1] = 0
        now.discount = 1 / np.maximum(tied.sum(1), 1)
    return now


def classifier(x: np.ndarray, share: np.ndarray, weight: np.ndarray, ridge: float = 0.2, steps: int = 30) -> np.ndarray:
    """Logistic regression on soft labels of weighted rows by Newton steps; the last weight is the offset."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, hold = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    hold[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - share)) + hold * w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(hold)
        move = np.linalg.solve(curve, slope)
        w -= move
        if np.abs(move).max() < 1e-6:
            break
    return w


def prior_chances(n_words: int) -> np.ndarray:
    n = n_words + len(PATTERNS)
    prior = np.full((2, n), 0.02)
    prior[1, :n_words] = 0.1
    prior[0, :n_words] = 0.002
    prior[1, [n - 4, n - 3]], prior[0, [n - 4, n - 3]] = 0.3, 0.01
    prior[:, n - 1] = [0.97, 0.15]
    return prior


def class_weights(label: np.ndarray, counts: dict[int, int]) -> np.ndarray:
    """How many labels of its class a sampled row stands for, on average 1."""
    drawn = {c: max(1, int((label == c).sum())) for c in counts}
    weight = np.array([counts[c] / drawn[c] for c in label.tolist()], float)
    return weight / weight.mean() if len(weight) else weight


def trained(place: dict[str, int], fired: list[list[int]], label: np.ndarray, beliefs: Beliefs, counts: dict[int, int]) -> Voters:
    n = len(place) + len(PATTERNS)
    if not len(fired):
        x, share = np.zeros((2, n)), np.array([1 - SURE, SURE])
        x[0, n - 1], x[1, : len(place)] = 1, 1
        return Voters(place, classifier(x, share, np.ones(2)))
    x = np.zeros((len(fired), n))
    for row, f in enumerate(fired):
        x[row, f] = 1
    return Voters(place, classifier(x, beliefs.share(x, label), class_weights(label, counts)))


def vote_patterns(fired: DataFrame) -> DataFrame:
    """How many documents (``n``) have each set of votes and label (-1: none)."""
    rows = fired.select(F.array_sort("fired").alias("fired"), F.coalesce("label", F.lit(-1)).alias("label"))
    return rows.groupBy("fired", "label").agg(F.count(F.lit(1)).alias("n"))


def pattern_sums(patterns: DataFrame, n_voters: int) -> Callable[[Beliefs | None], Sums]:
    """``measure`` of the label model over stored patterns: a job each, a row per voter back.

    Shares are added up as decimals, so the order in which tasks end changes no digit.
    """

    def measure(beliefs: Beliefs | None) -> Sums:
        sure = F.when(F.col("label") == 1, SURE).when(F.col("label") == 0, 1 - SURE).otherwise(0.5)
        rows = patterns
        if beliefs is None:
            rows, share = patterns.filter("label >= 0"), sure
        else:
            weight, offset = beliefs.evidence()
            table = F.lit(np.asarray(weight, float))
            raw = F.aggregate("fired", F.lit(offset), lambda total, i: total + F.get(table, i))
            belief = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), raw))))
            share = belief * sure / (belief * sure + (1 - belief) * (1 - sure))
        shares = rows.select("n", share.alias("s"), F.array_append("fired", F.lit(n_voters)).alias("voters"))
        exact = [F.sum((F.col("n") * x).cast("decimal(28,10)")).cast("double") for x in (F.col("s"), F.col("s") * F.col("s"))]
        total, by_voter = np.zeros(3), np.zeros((n_voters, 2))
        for r in shares.select(F.explode("voters").alias("i"), "n", "s").groupBy("i").agg(F.sum("n"), *exact).collect():
            if r[0] == n_voters:
                total[:] = r[1:]
            else:
                by_voter[r[0]] = r[1:3]
        return Sums(total, by_voter)

    return measure


def fired_together(patterns: DataFrame, n_voters: int) -> np.ndarray:
    """The documents in which two voters fire both; the voters are bounded, so the pairs are."""
    pairs = patterns.select("n", "fired", F.explode("fired").alias("i")).select("n", "i", F.explode("fired").alias("j"))
    out = np.zeros((n_voters, n_voters))
    for r in pairs.filter("i <= j").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["n"]
    return out


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()
    toxic: Counter = Counter()

    def counted() -> pa.RecordBatch:
        columns = [pa.array(list(found), pa.string()), pa.array([toxic[w] for w in found], pa.int64()), pa.array(list(found.values()), pa.int64())]
        found.clear()
        toxic.clear()
        return pa.RecordBatch.from_arrays(columns, names=["word", "t", "n"])

    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
            own = set(words_of(text.as_py()))
            own |= {w[:n] + "*" for w in own for n in STEMS if len(w) >= n}
            found.update(own)
            if label == 1:
                toxic.update(own)
            if len(found) > HELD:
                yield counted()
    yield counted()


def candidates(sample: DataFrame, most: int = CANDIDATES) -> list[str]:
    """Words and stems of toxic documents mainly, those in most of them first."""
    parts = sample.filter("label >= 0").select("text", "label").mapInArrow(trimmed(_candidates), "word string, t long, n long")
    totals = {r["label"]: r["count"] for r in sample.filter("label >= 0").groupBy("label").count().collect()}
    counts = parts.groupBy("word").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    lift = F.col("t") * totals.get(0, 0) / ((F.col("n") - F.col("t") + 0.5) * max(1, totals.get(1, 0)))
    found = counts.filter((F.col("t") >= SUPPORT) & (lift >= LIFT))
    return [r["word"] for r in found.orderBy(F.desc("t"), "n", F.desc(F.length("word")), "word").limit(most).collect()]


def chosen_voters(fired: list[list[int]], n_lexicon: int, most: int = MINED) -> list[int]:
    """Candidates that explain toxic documents without a lexicon word, each by COVER of them at most."""
    rows: dict[int, set[int]] = {}
    for row, f in enumerate(fired):
        if min(f, default=n_lexicon) >= n_lexicon:
            for i in f:
                rows.setdefault(i, set()).add(row)
    queue = [(-len(r), i) for i, r in rows.items()]
    heapq.heapify(queue)
    explained: Counter = Counter()
    full: set[int] = set()
    out: list[int] = []
    while queue and len(out) < most and -queue[0][0] >= SUPPORT:
        gain, i = heapq.heappop(queue)
        now = len(rows[i] - full)
        if now < -gain:  # earlier voters took some of it
            heapq.heappush(queue, (-now, i))
        else:
            out.append(i)
            explained.update(rows[i])
            full |= {r for r in rows[i] if explained[r] >= COVER}
    return out


def over_texts(voters: Callable[[str | None], list[int]]):
    """A function of a text column that gives the voters of every text, a slice at a time."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for texts in columns:
                yield pa.array([voters(t) for part in text_parts(texts) for t in part], pa.list_(pa.int32()))
        finally:
            give_back()

    return F.arrow_udf(run, "array<int>")


def fitted(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", labelled: int = LABELLED) -> Voters:
    """Voters and weights; ``learn`` says of an id (``label_id``) if it may be learnt from.

    Voters are mined from, and the classifier is fitted on, a sample of at most about ``labelled``
    labelled documents of each class; the label model counts all documents.
    """
    marks = best_label(labels, id_col, label_col).filter(learn)
    drawn = sampled(marks, F.col("label_id"), 2 * labelled, F.col("label"))
    texts = docs.select(named(id_col).cast("long").alias("label_id"), named(text_col).alias("text"))
    with_label = texts.join(F.broadcast(drawn), "label_id")  # the sample is bounded
    sample = stored(with_label, "toxic-sample")
    lexicon = list(dict.fromkeys(LEXICON))
    place = {w: i for i, w in enumerate(dict.fromkeys([*lexicon, *candidates(sample)]))}
    lengths = stems_of(place)
    fire = over_texts(lambda t: [place[w] for w in hits(words_of(t), place, lengths)])
    toxic = sample.filter("label = 1").select(fire("text").alias("fired")).toPandas()["fired"]
    names = list(place)
    taken = chosen_voters([list(f) for f in toxic], len(lexicon))
    final = {w: i for i, w in enumerate([*lexicon, *[names[i] for i in taken]])}
    ends = stems_of(final)
    fire = over_texts(lambda t: votes(t, final, ends))
    got = sample.select("label_id", "label", fire("text").alias("fired")).select("label_id", "label", F.array_sort("fired").alias("fired"))
    rows = sorted((r["label_id"], r["label"], r["fired"]) for r in got.collect())
    every = texts.filter(learn).select("label_id", fire("text").alias("fired")).join(marks, "label_id", "left")
    patterns = stored(vote_patterns(every), "toxic-patterns")
    counts = {r["label"]: r["n"] for r in patterns.filter("label >= 0").groupBy("label").agg(F.sum("n").alias("n")).collect()}
    base = counts.get(1, 0) / sum(counts.values()) if counts else None
    n = len(final) + len(PATTERNS)
    beliefs = label_model(pattern_sums(patterns, n), fired_together(patterns, n), prior_chances(len(final)), base)
    return trained(final, [f for *_, f in rows], np.array([label for _, label, _ in rows], int), beliefs, counts)


def score(model: Voters, text: Column) -> Column:
    lengths = stems_of(model.place)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for texts in columns:
                found = [model.score([votes(t, model.place, lengths) for t in part]) for part in text_parts(texts)]
                yield pa.array(np.concatenate(found) if found else [], pa.float64())
        finally:
            give_back()

    return F.arrow_udf(run, "double")(text)


def learnable(folds: int = 3, held: int = 1) -> Column:
    return fold(F.col("label_id"), folds) != held


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held: int = 1) -> DataFrame:
    """All columns of ``docs`` and held_out, score, predicted; the held-out fold is never learnt from."""
    model = fitted(docs, labels, learnable(folds, held), id_col, text_col)
    rows = docs.select(*[named(c) for c in docs.columns if c not in ("held_out", "score", "predicted")], score(model, named(text_col)).alias("score"))
    held_out = F.coalesce(fold(named(id_col), folds) == held, F.lit(False))
    return rows.withColumns({"held_out": held_out, "predicted": (F.col("score") >= THRESHOLD).cast("int")})


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` that the classifier does not reject."""
    model = fitted(docs, labels, learnable())
    return docs.filter(score(model, F.col("text")) < THRESHOLD)
