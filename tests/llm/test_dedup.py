"""Line dedup, SimHash near-dedup, decontamination and suffix-array dedup against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from shockspan.llm import components, decontaminate, line_dedup, simhash, suffix
from tests.llm import brute

EMPTY = "doc_id long, text string"


def test_lines(frame, docs):
    out = {(r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in line_dedup.dedup_lines(frame).collect()}
    assert out == set(brute.line_dedup(docs))
    assert any(r[2] for r in out)


def test_lines_held_by_more_documents(frame, docs):
    out = {(r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in line_dedup.dedup_lines(frame, max_docs=4).collect()}
    assert out == set(brute.line_dedup(docs, max_docs=4))


def test_lines_with_null_ids_repeated_rows_and_clashing_names(spark):
    rows = [(None, "a line of some length", 1, 2), (5, "A line of some length ", 3, 4), (5, "A line of some length ", 3, 4), (None, None, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id long, n_dropped long")
    out = sorted(((r.doc_id, r.text, r.id, r.n_dropped) for r in line_dedup.dedup_lines(df).collect()), key=str)
    assert out == sorted([(None, "", 1, 1), (5, "A line of some length ", 3, 0), (5, "A line of some length ", 3, 0), (None, None, 0, 0)], key=str)
    kept = line_dedup.without_shared_lines(df)
    assert kept.columns == df.columns[:4] and kept.count() == 4


def test_fingerprints_and_components(frame, docs):
    prints = {i: brute.fingerprint(t) for i, t in docs}
    found = brute.components(prints)
    for crowd in (64, 0):  # 0: every anchor with a fingerprint at home is crowded
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.components(frame, crowd=crowd).collect()}
        assert got == {i: (f"{prints[i]:016x}", found[i]) for i in prints}
    assert len(set(found.values())) < len(found) - 6


def test_links_of_random_fingerprints(spark):
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(150)]
    for base in list(prints):
        for _ in range(3):
            bits = rng.sample(range(64), rng.randint(1, 4))
            prints.append(base ^ sum(1 << b for b in bits))
    prints = {i: p for i, p in enumerate(dict.fromkeys(prints))}
    signed = {i: p - (1 << 64) if p >> 63 else p for i, p in prints.items()}
    df = spark.createDataFrame([(p,) for p in signed.values()], "fp long")
    of = {p: i for i, p in signed.items()}
    for crowd in (64, 0):
        root = {r.node: r.root for r in components.roots(simhash.near_links(df, crowd)).collect()}
        groups = {}
        for i, p in signed.items():
            groups.setdefault(root.get(p, p), []).append(i)
        assert {min(g): sorted(g) for g in groups.values()} == {
            c: sorted(i for i, x in found.items() if x == c) for found in [brute.components(prints)] for c in set(found.values())
        }
    assert of


def test_long_chain_is_one_component(spark):
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components.roots(links).collect()
    assert len(got) == 300 and {r.root for r in got} == {0}


def test_one_of_each_group(frame, docs):
    found = brute.components({i: brute.fingerprint(t) for i, t in docs})
    assert {r.doc_id for r in simhash.one_of_each(frame).collect()} == set(found.values())


def test_near_dedup_of_nulls_and_repeated_rows(spark):
    rows = [(None, "one two three four", "x"), (None, "quite another text of words", "y"), (3, "One two three four", "z"), (3, "One two three four", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    out = simhash.one_of_each(df)
    assert out.columns == df.columns
    assert sorted(map(str, ((r.doc_id, r.fp) for r in out.collect()))) == sorted(map(str, [(None, "y"), (3, "z")]))


@pytest.fixture(scope="module")
def items(docs):
    texts = dict(docs)
    w = texts[2].split()
    edited = w[:20]
    edited[4], edited[11] = "other", "words"
    return [(0, " ".join(w[5:25])), (1, " ".join(edited).upper()), (2, "no such words stand anywhere at all"), (3, ""), (4, None), (5, "short"), (5, "short"), (6, " ".join([*w[:9], *w[10:18]]))]


def test_benchmark_items(spark, frame, docs, items):
    df = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminations(frame, df)
    assert {(r.doc_id, r.item_id, r.distance) for r in got.collect()} == brute.contaminations(docs, items)
    clean = {r.doc_id for r in decontaminate.clean_of(frame, df).collect()}
    assert clean == {i for i, _ in docs} - {i for i, _, _ in brute.contaminations(docs, items)}


def test_benchmark_items_in_many_blocks(spark, frame, docs, items, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 25)
    df = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminations(frame, df)
    assert {(r.doc_id, r.item_id, r.distance) for r in got.collect()} == brute.contaminations(docs, items)


def test_edit_distance_by_bits():
    rng = random.Random(2)
    for _ in range(300):
        item = [rng.randint(1, 3) for _ in range(rng.randint(1, 70))]
        text = [rng.randint(1, 3) for _ in range(rng.randint(0, 90))]
        masks = {}
        for i, c in enumerate(item):
            masks[c] = masks.get(c, 0) | 1 << i
        exact = brute.least_edits(item, text)
        got = decontaminate.myers(masks, len(item), text, len(item) - 1)
        assert (got[0] if got else None) == (exact if exact < len(item) and text else None)


def test_suffix_array():
    rng = random.Random(5)
    for _ in range(2000):
        text = [rng.randint(1, rng.randint(1, 5)) for _ in range(rng.randint(0, 40))] + [0]
        assert suffix.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


@pytest.mark.parametrize(("length", "crowd"), [(400, 16384), (400, 0), (128, 16384)])
def test_repeated_strings(frame, docs, length, crowd):
    got = suffix.without_repeats(frame, length=length, crowd=crowd)
    out = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()}
    assert out == set(brute.without_repeats(docs, length))
    assert any(r[2] for r in out)


def test_repeated_strings_of_long_texts_in_parts(spark, monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice("abcd ") for _ in range(9000))
    docs = [(1, text + text[500:2000]), (2, text[3000:3700]), (3, "é" * 300 + text[100:480])]
    monkeypatch.setattr(suffix, "PART", 1000)
    df = spark.createDataFrame(docs, EMPTY)
    out = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.without_repeats(df).collect()}
    assert out == set(brute.without_repeats(docs))


def test_repeated_strings_of_nulls_and_repeated_rows(spark):
    rows = [(None, "q" * 10, 1), (None, None, 2), (4, "word " * 100 + "!", 3), (4, "word " * 100 + "!", 3), (4, "other", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes long")
    out = suffix.without_repeats(df)
    assert sorted(map(str, ((r.doc_id, r.n_bytes, r.n_removed) for r in out.collect()))) == sorted(
        map(str, [(None, 10, 0), (None, 0, 0), (4, 501, 501), (4, 501, 501), (4, 5, 0)])
    )


@pytest.mark.parametrize("crowd", [16384, 0])
@pytest.mark.parametrize(("size", "gone"), [(321, 0), (399, 0), (400, 400), (401, 401)])
def test_passages_of_over_50_words_go_from_400_bytes_on(spark, size, gone, crowd):
    rng = random.Random(size)
    letters = size - 50
    passage = " ".join("".join(rng.choices("abcde", k=letters // 51 + (i < letters % 51))) for i in range(51))
    texts = [f"é{edge}{passage}{edge}z" for edge in "\n\t "] + ["".join(rng.choices("vwxyz ", k=900))]
    df = spark.createDataFrame(list(enumerate(texts)), EMPTY)
    out = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept).decode()) for r in suffix.without_repeats(df, crowd=crowd).collect()}
    held = {(i, size + 5, gone, int(gone > 0), t.replace(passage, "") if gone else t) for i, t in enumerate(texts[:3])}
    assert out == held | {(3, 900, 0, 0, texts[3])}


@pytest.mark.parametrize("run", [line_dedup.dedup_lines, simhash.components, simhash.one_of_each, suffix.without_repeats])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], EMPTY)).count() == 0


def test_empty_benchmark(spark, frame, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminations(frame, none).count() == 0
    assert decontaminate.clean_of(frame, none).count() == len(docs)
