"""Reply trees, the prefix trie and tree contraction against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shockspan.llm import chat, queries
from shockspan.llm.contraction import subtree_totals
from shockspan.llm.prefix_trie import prefix_trie

CONTROL = ["<|im_end|>", "<|im_start|>assistant", "<|", "<\\|", "<\\\\|im_sep|>", "<", "|", "\\", "\n", "x|>", ""]
SCHEMA = "conv_id long, turn int, role string, text string, id long, tree string, parent long, leaf int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def conversations():
    rng = random.Random(5)
    rows = []
    for c in list(range(-6, 40)) + [2**63 - 1, -(2**63)]:
        start = rng.choice(["hello", "a", ""])
        texts = [start, *("".join(rng.choices(CONTROL + ["ab", "é🙂"], k=rng.randint(0, 5))) for _ in range(rng.randint(0, 12)))]
        rows += [(c, t, rng.choice(["user", "assistant", None, "sys\ntem", "<|im_sep|>"]), x) for t, x in enumerate(texts)]
    rows += [(7, 0, "user", "hello"), (7, 0, "user", "hello"), (8, None, "user", "first"), (8, None, None, None), (100, 3, None, None)]
    rows += [(200, t, "assistant" if t % 2 else "user", f"t{t}") for t in range(150)] + [(201, t, "user", "t") for t in range(3)]
    rows += [(c, 0, "user", "base is absent") for c in (401, 402, 403, 404)]
    rows += [(None, 0, "user", "nobody's"), (None, 1, "assistant", "yes"), (300, 0, "user", "x" * 200_000)]
    return rows


def ordered(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for *_, r, x in sorted(v)] for c, v in by.items()}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("talk"))
    rows = [(*r, 1, "z", 2, 3) for r in conversations()]  # extra columns with names of ours
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{path}/conversations.parquet")
    return path


def test_formatted_conversations_are_read_back(spark, folder):
    talks = ordered([*conversations(), (-1, 0, "user", queries.INJECTION), (-1, 1, "assistant", queries.INJECTION)])
    want = set()
    for c, turns in talks.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        want.add((c, len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss)))
    got = queries.op11_chat_format(spark, folder).collect()
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(talks)


def test_segments_make_up_the_text_and_hold_no_control_strings(spark, folder):
    out = chat.formatted_paths(chat.chains(spark.read.parquet(f"{folder}/conversations.parquet"))).collect()
    for r in out:
        assert "".join(s.text for s in r.segments) == r.formatted
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_sep|>") == r.formatted.count("<|im_end|>\n") == r.n_turns
        assert r.formatted.count("<|") == 3 * r.n_turns
    assert max(r.n_turns for r in out) == 150


def test_branches_are_ranked_by_mean_score(spark):
    rows = [
        ("t", 1, None, "user", "q", None), ("t", 2, 1, "assistant", "a", 1.0), ("t", 3, 1, "assistant", "b", 5.0), ("t", 4, 2, "user", "more", 9.0),
        ("t", 5, 1, "assistant", "c", 5.0), ("t", 5, 1, "assistant", "d", 5.0),  # a number that stands twice
        ("u", 1, None, "user", "alone", None), ("u", 9, 9, "user", "itself", 1.0), ("u", 2, 3, "user", "later", 2.0), ("u", 3, 2, "user", "on 2", 0.0),
        (None, 1, None, "user", "no tree", 0.5), (None, 2, 1, None, None, None), ("t", None, 1, "user", "no number", 1.0), ("v", 5, 77, "user", "lost", 1.0),
    ]
    frame = spark.createDataFrame(rows, "tree string, id long, parent long, role string, text string, score double")
    out = chat.formatted_paths(frame, top=None).collect()
    parsed = {(r.tree, r.leaf): (r.path_score, r.n_turns, [s.text for s in r.segments[1::3]]) for r in out}
    assert parsed == {
        ("t", 3): (5.0, 2, ["q", "b"]), ("t", 4): (5.0, 3, ["q", "a", "more"]), ("t", 5): (5.0, 2, ["q", "c"]), ("u", 1): (0.0, 1, ["alone"]),
        ("u", 9): (1.0, 1, ["itself"]), ("u", 3): (1.0, 2, ["later", "on 2"]), (None, 2): (0.5, 2, ["no tree", ""]), ("v", 5): (1.0, 1, ["lost"]),
    }
    best = chat.formatted_paths(frame, top=2).collect()
    assert {(r.tree, r.leaf, r.path_rank) for r in best} == {("t", 3, 1), ("t", 4, 2), ("u", 3, 1), ("u", 9, 2), (None, 2, 1), ("v", 5, 1)}


def test_empty_conversations(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    none.write.parquet(f"{tmp_path}/conversations.parquet")
    assert {r.conv_id for r in queries.op11_chat_format(spark, str(tmp_path)).collect()} == {-1}
    assert queries.op13_prefix_trie(spark, str(tmp_path)).count() == 0
    assert prefix_trie(none).count() == 0


def trie(talks):
    """conv_id -> [(role, text)] to the set of node rows."""
    members, kids, ends = defaultdict(set), defaultdict(set), defaultdict(list)
    for c, turns in talks.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    totals = {}
    for p in sorted(members, key=len, reverse=True):
        saved = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        below = [totals[k] for k in kids[p]]
        totals[p] = (sum(n for n, _ in below) if below else 1, saved + sum(s for _, s in below))
    return {
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), *totals[p], sha(",".join(map(str, sorted(ends[p])))))
        for p, m in members.items()
    }


def test_trie_of_rebuilt_conversations(spark, folder):
    own = {c: t for c, t in ordered(conversations()).items() if c is not None}
    talks = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c > 0 else -1)
        talks[c] = own.get(base, [])[:h] + turns[h:]
    got = queries.op13_prefix_trie(spark, folder).collect()
    want = trie(talks)
    assert any(not t for t in talks.values())  # a conversation without turns
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_trie_as_they_stand(spark, folder):
    own = {c: t for c, t in ordered(conversations()).items() if c is not None}
    got = {tuple(r) for r in prefix_trie(spark.read.parquet(f"{folder}/conversations.parquet")).collect()}
    assert got == trie(own)


@pytest.mark.parametrize("shape", ["random", "path", "star", "caterpillar", "forest"])
def test_contraction_totals(spark, shape):
    rng = random.Random(3)
    n = 400
    up = {
        "random": lambda i: rng.randrange(i), "path": lambda i: i - 1, "star": lambda i: 0,
        "caterpillar": lambda i: i - 1 if i % 2 else max(0, i - 2), "forest": lambda i: None if i % 50 == 0 else i - 1 - (i % 50) // 2,
    }[shape]
    names = rng.sample(range(10**6), n)
    parents = [None, *(up(i) for i in range(1, n))]
    rows = [(names[i], None if p is None else names[p], i, 1) for i, p in enumerate(parents)]
    want = [[i, 1] for i in range(n)]
    for i in range(n - 1, 0, -1):
        if parents[i] is not None:
            want[parents[i]][0] += want[i][0]
            want[parents[i]][1] += want[i][1]
    frame = spark.createDataFrame(rows, "id long, parent long, value long, one long").withColumn("other", F.lit("x"))
    got = {r.id: [r.value, r.one] for r in subtree_totals(frame, ["value", "one"]).collect()}
    assert got == {names[i]: w for i, w in enumerate(want)}
