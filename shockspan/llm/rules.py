"""Quality rules whose cutoffs come with a guarantee on good documents.

Every document gets its base counts. For each stratum (language) and each rule (a
statistic and a direction) the cutoffs of a grid are tested on the labelled good
documents: a cutoff is admitted when the exact binomial tail shows that it rejects at
most its share of the allowed false rejections, at a level divided by the number of
all tests (Bonferroni over strata, rules and cutoffs). The strictest admitted cutoff is
used; where none is admitted the rule rejects nothing in that stratum. So with
probability 1 - ``delta`` no stratum loses more than ``alpha`` of its good documents to
the rules together.

Only DataFrame functions are used. All counts of a document come from arrays inside
its row, so nothing but the counts is ever shuffled; the labelled tallies combine
before the shuffle, so a stratum may hold most rows.

Defined cases: a null text has no words; a null stratum is the stratum "und"; labels
without a value are ignored, of several labels of an id the largest counts; repeated
rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shockspan.llm.common import named
from shockspan.session import stored

GAP = r"[\x20\x09-\x0D]+"
ALPHA, DELTA = 0.02, 0.05
#: Rule -> (direction, cutoffs from the mildest to the strictest).
RULES = {
    "symbol_ratio": ("above", [0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.08, 0.05, 0.03, 0.02]),
    "dup_line_ratio": ("above", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1]),
    "repeat_ratio": ("above", [0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05]),
    "mean_word": ("above", [20.0, 15.0, 12.0, 11.0, 10.0, 9.5, 9.0, 8.5, 8.0, 7.5]),
}
#: Strata up to which their cutoffs are written into the plan; more are joined.
INLINE_STRATA = 500


def base_counts(docs: DataFrame, carry: list[Column], text_col: str = "text") -> DataFrame:
    """``carry`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    names = [f"c{i}" for i in range(len(carry))]
    held = [c.alias(n) for c, n in zip(carry, names, strict=True)]
    # a line with a word: something other than white space is in it
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.regexp_replace(line, GAP, "")) > 0)
    rows = docs.select(
        *held,
        F.filter(F.split(text, GAP), lambda w: w != "").alias("words"),
        lines.alias("lines"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
    )
    rows = rows.select(
        *names, "words", "n_symbols",
        F.size("words").alias("n"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
    )
    # 64-bit hashes of the 3-word windows, by their first word's place
    window = F.transform(
        F.slice("words", 1, F.greatest(F.col("n") - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)),
    )
    counts = ["n", "n_lines", "word_chars", "n_symbols", "n_dup_lines"]
    rows = rows.select(*names, *counts, window.alias("h"))
    none = F.expr("cast(array() as array<struct<h:bigint,i:int>>)")
    placed = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    rows = rows.select(*names, *counts, F.when(F.size(F.array_distinct("h")) < F.size("h"), placed).otherwise(none).alias("s"))
    twice = F.filter(
        "s",
        lambda x, i: F.coalesce(F.get("s", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("s", i + 1)["h"] == x["h"], F.lit(False)),
    )
    rows = rows.select(*names, *counts, F.sort_array(F.transform(twice, lambda x: x["i"])).alias("p"))
    # places in order: each window adds its words up to the next window's first
    own = F.transform("p", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("p", i + 1), x + 3) - x))
    return rows.select(
        *names,
        F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"),
        "n_lines",
    )


def statistics() -> dict[str, Column]:
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return {
        "symbol_ratio": F.col("n_symbols") / F.greatest("word_chars", F.lit(1)),
        "dup_line_ratio": F.col("n_dup_lines") / lines,
        "repeat_ratio": F.col("n_repeat_words") / words,
        "mean_word": F.col("word_chars") / words,
    }


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X binomial (n, p), summed exactly, term by term, in logarithms.

    1 where k is at or above the mean, for no such count is evidence of a smaller rate.
    """
    odds = F.log(F.lit(p / (1 - p)))
    start = F.struct((n * F.log(F.lit(1 - p))).alias("term"), F.lit(0.0).alias("sum"))

    def step(a: Column, i: Column) -> Column:
        return F.struct((a["term"] + F.log((n - i) / (i + 1)) + odds).alias("term"), (a["sum"] + F.exp(a["term"])).alias("sum"))

    exact = F.aggregate(F.sequence(F.lit(0), k.cast("int")), start, step, lambda a: a["sum"])
    return F.when(k >= n * p, F.lit(1.0)).otherwise(exact)


def admitted(good: DataFrame, rules=RULES, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, rule, cut: the strictest admitted cutoff. ``good``: stratum and statistics of good documents."""
    total = good.select("stratum").distinct().count() * sum(len(cuts) for _, cuts in rules.values())
    parts = []
    for rule, (way, cuts) in rules.items():
        for rank, cut in enumerate(cuts):
            hit = F.col(rule) > cut if way == "above" else F.col(rule) < cut
            parts.append((rule, rank, cut, F.sum(hit.cast("long"))))
    tallies = good.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *[c.alias(f"k{i}") for i, (_, _, _, c) in enumerate(parts)])
    tests = tallies.select(
        "stratum", "n",
        F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(rank).alias("rank"), F.lit(float(cut)).alias("cut"), F.col(f"k{i}").alias("k")) for i, (r, rank, cut, _) in enumerate(parts)])).alias("t"),
    ).select("stratum", "n", "t.*")
    tail = binomial_tail(F.col("n"), F.col("k"), alpha / len(rules))
    return tests.filter(tail <= delta / max(total, 1)).groupBy("stratum", "rule").agg(F.max_by("cut", "rank").alias("cut"))


def kept_by_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", rules=RULES, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """id, the base counts, base_failed, kept for every row of ``docs``.

    ``labels``: the id and quality (1: good).
    """
    stratum = F.coalesce(named(stratum_col).cast("string"), F.lit("und"))
    counts = base_counts(docs, [named(id_col), stratum], text_col)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counts = stored(counts.withColumnsRenamed({"c0": "id", "c1": "stratum"}).withColumn("base_failed", failed), "base-counts")
    shown = statistics()
    best = labels.filter("quality is not null").groupBy(named(id_col).alias("id")).agg(F.max("quality").alias("quality")).filter("quality = 1")
    good = counts.filter("not base_failed").join(best, "id").select("stratum", *[c.alias(r) for r, c in shown.items()])
    cuts = admitted(stored(good, "good"), rules, alpha, delta).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cut"))).alias("cuts"))
    cuts = stored(cuts, "cutoffs")

    def rejected(cut) -> Column:
        any_rule = F.lit(False)
        for rule, (way, _) in rules.items():
            over = shown[rule] > cut(rule) if way == "above" else shown[rule] < cut(rule)
            any_rule = any_rule | F.coalesce(over, F.lit(False))
        return any_rule

    few = cuts.limit(INLINE_STRATA + 1).collect()
    if len(few) <= INLINE_STRATA:
        def cut(rule: str) -> Column:
            value = F.lit(None).cast("double")
            for row in few:
                if rule in row["cuts"]:
                    value = F.when(F.col("stratum") == row["stratum"], F.lit(row["cuts"][rule])).otherwise(value)
            return value

        out = counts
    else:
        def cut(rule: str) -> Column:
            return F.col("cuts")[rule]

        out = counts.join(cuts, "stratum", "left")
    return out.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~rejected(cut)).alias("kept"),
    )
