"""Quality rules, host reputation, packing and the pipeline."""

import random
import zlib
from collections import defaultdict
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import compare
import corpus_pipeline
from shockspan.llm import host_reputation, packing, queries, rules, toxicity
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_query_equals_sql(spark, name):
    assert compare.difference(queries.QUERIES[name](spark, SMALL), compare.connect(SMALL), queries.CHECKS[name]) is None


def test_all_are_registered():
    names = {f"op{n}_" for n in range(1, 14)}
    assert {k[: k.index("_") + 1] for k in queries.QUERIES} == names
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())


def test_binomial_tail_is_exact(spark):
    cases = [(n, k) for n in (5, 40, 700) for k in (0, 1, 3, 9) if k < n]
    got = spark.createDataFrame(cases, "n long, k long").select("n", "k", rules.binomial_tail(F.col("n"), F.col("k"), 0.02).alias("p"))
    for r in got.collect():
        exact = sum(comb(r.n, i) * 0.02**i * 0.98 ** (r.n - i) for i in range(r.k + 1))
        assert r.p == pytest.approx(1.0 if r.k >= r.n * 0.02 else exact, rel=1e-9)


def test_strictest_cutoff_that_the_bound_admits(spark):
    rng = random.Random(8)
    rows = [("a", rng.random() * 0.25) for _ in range(20000)] + [("b", rng.random() * 0.25) for _ in range(50)]
    good = spark.createDataFrame(rows, "stratum string, symbol_ratio double")
    only = {"symbol_ratio": rules.RULES["symbol_ratio"]}
    got = rules.admitted(good, only).collect()
    assert [(r.stratum, r.rule, r.cut) for r in got] == [("a", "symbol_ratio", 0.3)]


def test_rules_spare_the_good_and_catch_the_rest(spark):
    rng = random.Random(9)
    good = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(90)), "en") for i in range(4000)]
    bad = [(5000 + i, " ".join(f"w{rng.randrange(5000)}***" for _ in range(90)), "en") for i in range(50)]
    few = [(6000, "one two", "fr"), (6001, None, None), (6002, "x y z " * 40, "en"), (6002, "x y z " * 40, "en")]
    docs = spark.createDataFrame(good + bad + few, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(4000)] + [(5000, 0), (None, 1), (1, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in rules.kept_by_rules(docs, labels).collect()}
    assert sum(not got[i].kept for i in range(4000)) <= rules.ALPHA * 4000
    assert not any(got[i].kept for i, _, _ in bad) and not any(got[i].base_failed for i, _, _ in bad)
    assert got[6000].base_failed and got[6001].n_words == 0 and got[6002].n_repeat_words == 120


def test_rules_with_many_strata(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    before = {tuple(r) for r in rules.kept_by_rules(docs, labels, alpha=0.5).collect()}
    monkeypatch.setattr(rules, "INLINE_STRATA", 0)
    assert {tuple(r) for r in rules.kept_by_rules(docs, labels, alpha=0.5).collect()} == before


def test_rules_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert rules.kept_by_rules(docs, labels).count() == 0


URLS = [
    (1, "http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
    (2, "https://b.net/EN/", "b.net", "/EN/", "net/", "block"),
    (3, "https://net", "net", "", None, "allow"),
    (4, "x://example.com/de/1", "example.com", "/de/1", "example.com/de/", "block"),
    (5, "x://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"),
    (6, "http://www.a.org/fr/", "www.a.org", "/fr/", "org/fr/", "allow"),
    (7, None, "", "", None, "allow"),
    (8, "no scheme", "", "", None, "allow"),
    (9, "http://h?x://y/z", "h", "", None, "allow"),
    (9, "http://h?x://y/z", "h", "", None, "allow"),
    (10, "", "", "", None, "allow"),
    (11, "u://BÉ.org:80/a b\nc?", "bÉ.org:80", "/a b\nc", None, "allow"),
]


def test_urls_and_rules(spark):
    pages = spark.createDataFrame([u[:2] for u in URLS], "page_id long, url string")
    none = spark.createDataFrame([], "host string, good int")
    got = host_reputation.judged_urls(pages, none).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((u[0], *u[2:]) for u in URLS), key=str)


def test_reputation_shrinks_toward_the_domain(spark):
    rows = [("bad.x.org", 0)] * 60 + [("bad.x.org", 1)] * 2 + [("good.x.org", 1)] * 60 + [("few.x.org", 0)] * 2 + [("bad.y.org", 0)] * 80 + [("bad.y.org", None)]
    rows += [(f"h{i}.z.com", 1) for i in range(40) for _ in range(5)]
    pages = spark.createDataFrame([(i, f"http://{h}/a") for i, h in enumerate(["bad.x.org", "good.x.org", "few.x.org", "new.y.org", "bad.y.org", "h1.z.com", "new.w.info"])], "page_id long, url string")
    got = {r.host: r.verdict for r in host_reputation.judged_urls(pages, spark.createDataFrame(rows, "host string, good int")).collect()}
    assert got["bad.x.org"] == got["bad.y.org"] == "block"
    assert got["good.x.org"] == got["few.x.org"] == got["h1.z.com"] == got["new.w.info"] == "allow"


def test_native_operators_have_no_python(spark):
    docs, pages = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "pages"))
    plans = [rules.base_counts(docs, [F.col("doc_id")]), host_reputation.judged_urls(pages, host_reputation.page_outcomes(pages, spark.read.parquet(f"{SMALL}/labels.parquet")))]
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


ODD = ["", "a  b", " a b ", "a \n b", "\n x y   z", "x\x1c y \x1dz", " 's it's  don't \t t", " ", "  ", "<|endoftext|> a<|endoftext|>", "é ́x", "1 2  3 $$ % x", "日本 語  テ"]


def test_ids_equal_the_tokenizer():
    rng = random.Random(3)
    signs = [" ", "  ", "\n", "a", "'s", "b", "é", "7", "$", " ", "\x1c", " ", "\u200b", "́", "🙂", "'"]
    texts = ODD + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 12))) for _ in range(1500)]
    own = packing.Tokens(packing.default_tokenizer())
    exact = [e.ids for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # the second time from the table
        assert [np.frombuffer(x, "<u4").tolist() for x in own.ids_of([*texts, None])] == [x + [2] for x in [*exact, []]]


def test_ids_with_a_full_table(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_PARTS", 3)
    own = packing.Tokens(packing.default_tokenizer())
    for text in ("some words here", "some other words here again"):
        assert np.frombuffer(own.ids_of([text])[0], "<u4").tolist() == [*own.tokenizer.encode(text, add_special_tokens=False).ids, 2]
    assert len(own.known) <= 3


def checked_packing(rows, texts, capacity=1024, max_docs=None, max_cost=None):
    """Pieces make up their documents and lie in their sequences without gap or overlap."""
    tokenizer = packing.tokens(packing.default_tokenizer()).tokenizer
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert pieces.keys() == texts.keys()
    for i, own in pieces.items():
        ids = np.array([*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 2], "<u4")
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // capacity)))
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and sum(r.length for r in own) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
        assert all(r.length == capacity for r in own[1:])
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) <= capacity and len(own) <= (max_docs or capacity)
        assert sum(r.length**2 for r in own) <= (max_cost or capacity**2)
    return len(sequences)


def test_packing(frame, docs, spark):
    texts = dict(docs)
    n = checked_packing(packing.pack(frame).collect(), texts)
    total = sum(r.length for r in packing.pack(frame).collect())
    assert n <= 1.06 * total / 1024 + 1
    assert checked_packing(packing.pack(frame, max_docs=3, group=40).collect(), texts, max_docs=3) >= len(docs) / 3
    checked_packing(packing.pack(frame, max_cost=1.2 * 1024**2, measure="dot").collect(), texts, max_cost=1.2 * 1024**2)


def test_packing_of_nulls_repeated_rows_and_nothing(spark):
    df = spark.createDataFrame([(None, None, 1), (7, "same text", 2), (7, "same text", 2)], "doc_id long, text string, length int")
    rows = packing.pack(df).collect()
    assert sorted(((r.doc_id, r.piece, r.length) for r in rows), key=str) == sorted([(None, 0, 1), (7, 0, 3), (7, 0, 3)], key=str)
    assert len({r.sequence_id for r in rows}) == 1 and sorted(r.offset for r in rows) == [0, 3, 6]
    assert packing.pack(df.limit(0)).count() == 0


def test_best_fit_keeps_every_capacity():
    rng = np.random.default_rng(4)
    lengths = np.sort(rng.integers(1, 101, 600))[::-1]
    where, offset = packing.vector_best_fit(lengths, 100, 4, 10_500.0)
    for b in set(where.tolist()):
        own = lengths[where == b]
        assert own.sum() <= 100 and len(own) <= 4 and (own.astype(float) ** 2).sum() <= 10_500.0
    assert len(set(where.tolist())) < 1.2 * lengths.sum() / 100 + 600 / 4


def test_pipeline_equals_its_stages_by_brute_force(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rejected = {r.doc_id for r in toxicity.scored(documents, labels).filter("predicted = 1").collect()}
    kept = [(r.doc_id, r.text) for r in documents.orderBy("doc_id").collect() if r.doc_id not in rejected]
    kept = [(i, t) for i, _, _, t in brute.line_dedup(kept)]
    found = brute.components({i: brute.fingerprint(t) for i, t in kept})
    kept = [(i, t) for i, t in kept if found[i] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    small = [(i, t) for i, t in kept if any(w in set(brute.words(t)) for _, s in items for w in brute.words(s)[:3])]
    held = {i for i, _, _ in quick_contaminations(small, items)}
    texts = {i: t for i, t in kept if i not in held}
    checked_packing(corpus_pipeline.run(spark, SMALL).collect(), texts)


def quick_contaminations(docs, items):
    """The brute-force pairs, with pairs left out that share too few words to match."""
    out = set()
    for i, t in docs:
        own = set(brute.words(t))
        near = [(k, s) for k, s in items if sum(w in own for w in brute.words(s)) >= 0.8 * len(brute.words(s))]
        out |= brute.contaminations([(i, t)], near)
    return out


def test_stages_return_documents(spark):
    docs = spark.createDataFrame([(1, "some words", "en", "s", 10), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.dtypes == docs.dtypes and out.count() == 2
