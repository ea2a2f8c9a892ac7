import random

import pytest

SYLLABLES = "ka lo mi ne pu ra si to vu we xo ya".split()


def prose(rng, n):
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    return " ".join(words)


@pytest.fixture(scope="session")
def rng():
    return random.Random(7)


@pytest.fixture(scope="session")
def docs():
    """(id, text) with copies, near copies, shared lines and passages, nulls and odd texts."""
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(20, 160)) for _ in range(30)]
    passage = prose(rng, 90)
    texts += [f"{prose(rng, 30)} {passage} {prose(rng, 25)}" for _ in range(8)]
    texts += [texts[0]] * 4
    near = texts[1].split()
    texts += [" ".join([*near[:40], "changed", *near[41:]]), " ".join(near[3:]), texts[1].upper(), "\t" + texts[1] + "\n"]
    line = "A line that Many documents share"
    texts += [f"{prose(rng, 12)}\n{line}\n{prose(rng, 9)}\n  {line.upper()}  \nshort" for _ in range(6)]
    texts += ["short\nshort", "x" * 1500, "ab" * 700, "x" * 900, "", None, "\n", "  \n\t", "Éa ÉA\nCafé CRÈME brûlée", "🙂 " * 300, prose(rng, 4000)]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3).cache()
