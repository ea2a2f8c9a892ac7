"""Pages are allowed or blocked by rules, and else by the reputation of their host.

A host's share of good pages is estimated by empirical Bayes: labelled outcomes are
counted per host, and every level's share is shrunk toward the level above it (host
to registered domain, domain to suffix, suffix to all) through a beta-binomial prior
whose strength is fitted to the spread of the shares at that level. A page is blocked
when even the upper bound of its host's posterior lies below ``floor``. A host with no
labelled page takes its domain's prior, and so on upward.

Only DataFrame functions are used. Counts combine before each shuffle, and the tables
of hosts are joined by equality, so a host that holds a third of all pages is split by
adaptive execution.

Defined cases: a null url, or one without "://", has an empty host and path, which
no rule fits; labels that are null are ignored; a page or label that occurs twice
counts twice; with no labels at all nothing is blocked but by rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shockspan.llm.common import named
from shockspan.session import stored

#: (verdict, rule): a rule is a host and a path from its first slash on.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FLOOR, Z, MOST = 0.5, 2.0, 1000.0


def host_of(url: Column) -> Column:
    """After the first "://" up to / ? # or the end, A-Z in lower case; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; nulls where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for say, text in sorted(rules, key=lambda r: len(r[1])):
        of, _, rest = text.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(say)).otherwise(verdict)
    return rule, verdict


def domain_of(host: Column) -> Column:
    """The registered domain: the last two labels (a host of one label is its own)."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _strength(counts: DataFrame, above: str) -> DataFrame:
    """One row: the prior's strength (pseudo-pages) by moments, from 1 to MOST.

    With group shares s/n around their parent's share m, the squared differences hold
    the binomial spread m(1-m)/n and the spread between groups m(1-m)/(k+1).
    """
    m = F.col(above)
    seen = F.sum(F.col("n") * (F.col("s") / F.col("n") - m) * (F.col("s") / F.col("n") - m))
    chance, weight = F.sum(m * (1 - m)), F.sum(F.col("n") * m * (1 - m))
    between = (seen - chance) / weight
    k = F.when(weight > 0, F.when(between > 1 / MOST, 1 / between - 1).otherwise(F.lit(MOST)))
    return counts.agg(F.greatest(F.lit(1.0), F.least(F.lit(MOST), F.coalesce(k, F.lit(MOST)))).alias("k"))


def _level(hosts: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Shares of one level, shrunk toward the level above: key, share, s, n, prior, k."""
    counts = hosts.groupBy(key, parent_key).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    counts = stored(counts.join(parents.select(parent_key, F.col("share").alias("prior")), parent_key), "reputation")
    k = _strength(counts, "prior").first()["k"]
    share = (F.col("s") + F.col("prior") * k) / (F.col("n") + k)
    return counts.select(key, "s", "n", "prior", F.lit(float(k)).alias("k"), share.alias("share"))


def reputations(outcomes: DataFrame, z: float = Z) -> tuple[DataFrame, DataFrame, DataFrame, float, float]:
    """Upper bounds of the good share per host, per domain and per suffix, and for no evidence.

    ``outcomes``: host and good (0 or 1, nulls ignored).
    """
    hosts = (
        outcomes.filter("good is not null and host <> ''")
        .groupBy("host")
        .agg(F.sum(F.col("good").cast("double")).alias("s"), F.count(F.lit(1)).cast("double").alias("n"))
        .withColumn("domain", domain_of(F.col("host")))
        .withColumn("suffix", suffix_of(F.col("host")))
        .withColumn("all", F.lit(1))
    )
    hosts = stored(hosts, "hosts")
    total = hosts.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    overall = (total["s"] + 1) / (total["n"] + 2) if total["n"] else 1.0
    top = hosts.sparkSession.createDataFrame([(1, overall)], "all int, share double")
    suffixes = _level(hosts, "suffix", top, "all")
    domains = _level(hosts, "domain", suffixes, "suffix")
    own = _level(hosts, "host", domains, "domain")

    def bound(share: Column, weight: Column) -> Column:
        return (share + z * F.sqrt(share * (1 - share) / (weight + 1))).alias("bound")

    return own.select("host", bound(F.col("share"), F.col("n") + F.col("k"))), domains, suffixes, overall, z


def judged_urls(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, floor: float = FLOOR, z: float = Z) -> DataFrame:
    """id, host, path, rule, verdict, bound of every row of ``pages``.

    ``outcomes``: host and good of labelled pages.
    """
    own, domains, suffixes, overall, _ = reputations(outcomes, z)

    def prior(level: DataFrame, key: str) -> DataFrame:
        share = F.col("share")
        return level.select(key, (share + z * F.sqrt(share * (1 - share) / 2)).alias(f"{key}_bound"))

    host = host_of(named(url_col))
    rows = pages.select(named(id_col).alias(id_col), host.alias("host"), path_of(named(url_col)).alias("path"))
    rows = rows.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    rows = rows.join(own, "host", "left").join(prior(domains, "domain"), "domain", "left").join(prior(suffixes, "suffix"), "suffix", "left")
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    bound = F.coalesce("bound", "domain_bound", "suffix_bound", F.lit(overall + z * (overall * (1 - overall) / 2) ** 0.5))
    by_method = F.when(bound < floor, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"), bound.alias("bound"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled pages: the number in a page's path is the document it shows."""
    shown = F.regexp_extract(path_of(F.col("url")), r"/(\d{1,18})(?:\D|$)", 1)
    rows = pages.select(host_of(F.col("url")).alias("host"), F.when(shown != "", shown).cast("long").alias("doc_id"))
    marks = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("good"))
    return rows.filter("doc_id is not null").join(marks, "doc_id").select("host", "good")
