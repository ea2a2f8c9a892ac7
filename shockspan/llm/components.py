"""Connected components of a graph that is given by its links, by star contraction.

Large and small stars alternate (Kiveris et al., 2014): first every node's larger
neighbours, then its smaller ones, are linked to the smallest node it knows. Every
round is a grouped minimum, with partial minima before the shuffle, and an equi-join
of two written tables, whose hot nodes adaptive execution splits; links never multiply.
Rounds are written to the shared folder, so a lost executor costs one round. They end
when a round changes no link; then every node is linked to its component's smallest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockspan.session import stored


def _least_neighbour(links: DataFrame) -> DataFrame:
    return stored(links.groupBy("a").agg(F.min("b").alias("m")), "least")


def _state(links: DataFrame) -> tuple:
    low = F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1))
    return tuple(links.agg(F.count(F.lit(1)), F.sum(low), F.sum(F.shiftrightunsigned(F.xxhash64("b", "a"), 24))).first())


def roots(links: DataFrame) -> DataFrame:
    """node, root of every node that has a link; ``links``: longs a and b, in any direction."""
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = stored(links.distinct(), "links")
    before, now = None, _state(links)
    while now != before:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _least_neighbour(both).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.filter("a <> b").distinct(), "large-star")
        least = _least_neighbour(large)
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        links = stored(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        before, now = now, _state(links)
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
