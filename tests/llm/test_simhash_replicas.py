"""The replicas of fingerprints, 61 each, are never broadcast, however small Spark takes them to be."""

import random
import re

from shockspan.llm import simhash
from shockspan.session import stored


def test_replicas_are_not_broadcast(spark):
    rng = random.Random(5)
    prints = [rng.getrandbits(64) - 2**63 for _ in range(300)]
    prints += [p ^ 5 for p in prints[:20]]
    links = simhash.near_links(stored(spark.createDataFrame([(p,) for p in prints], "fp long")))  # of a known size
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin(?:\(skew=true\))? \[anchor#\d+L\], \[anchor#\d+L\], Inner", plan)
    assert not re.search(r"BroadcastHashJoin \[anchor#\d+L\], \[anchor#\d+L\], Inner", plan)
    assert {frozenset(r) for r in links.collect()} == {frozenset((p, p ^ 5)) for p in prints[:20]}
