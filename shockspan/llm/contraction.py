"""Subtree totals of a forest by parallel tree contraction, in join rounds.

Rake and compress alternate. Compress takes every chain of nodes with one live child
each out of the tree: pointer doubling, a self-join a round, gives each of its nodes the
sum of the chain's values from itself down and the node below the chain, and that node
hangs from what the chain hung from, with the chain's sum on the link. Rake then removes
all leaves and adds their values to their parents, a grouped sum with partial sums
before the shuffle. Every pair of steps at least halves the tree, so a forest of n nodes
takes about log2(n) of them, each with log2(longest chain) joins, whatever its depth.
Then the removed chains are put back, last ones first: a node's total is the chain's sum
from it down plus the total of the node below the chain.

All joins are equalities on node numbers between written tables; a parent of a third of
all nodes appears as one grouped row. Nodes hold numbers only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shockspan.session import stored


def subtree_totals(nodes: DataFrame, values: list[str]) -> DataFrame:
    """id and the sums of ``values`` over each node's subtree, itself included.

    ``nodes``: id, parent (null for roots; another node of the table), and the longs
    ``values``; ids are distinct and there are no cycles. No nodes give no rows.
    """
    links = [f"_{v}" for v in values]  # what stands on the link to the parent

    def plus(x: Column, y: Column) -> Column:
        return x + F.coalesce(y, F.lit(0))

    live = nodes.select("id", "parent", *values, *[F.lit(0).cast("long").alias(e) for e in links])
    steps: list[tuple[DataFrame, DataFrame]] = []
    while not live.isEmpty():
        below = F.max(F.struct(F.col("id").alias("next"), *[F.col(e).alias(f"n{e}") for e in links])).alias("kid")
        kids = live.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("kids"), below)
        live = stored(live.join(kids, "id", "left"), "live")

        chain = live.filter("kids = 1").select(
            "id", "parent", *links, F.col("kid.next").alias("next"), F.lit(1).alias("length"), *[(F.col(v) + F.col(f"kid.n_{v}")).alias(v) for v in values]
        )
        moved = True
        while moved:
            further = chain.select(F.col("id").alias("next"), F.col("next").alias("end"), F.col("length").alias("more"), *[F.col(v).alias(f"m_{v}") for v in values])
            chain = chain.join(further, "next", "left").select(
                "id", "parent", *links, F.coalesce("end", "next").alias("next"), plus(F.col("length"), F.col("more")).alias("length"),
                *[plus(F.col(v), F.col(f"m_{v}")).alias(v) for v in values], F.col("end").isNotNull().alias("moved"),
            )
            chain = stored(chain, "chain")
            moved = not chain.filter("moved").isEmpty()

        # a chain hangs from where its top, the node with the longest way down, hung from
        top = F.max(F.struct("length", F.col("parent").alias("up"), *[(F.col(v) + F.col(f"_{v}")).alias(f"n_{v}") for v in values])).alias("top")
        tops = chain.groupBy(F.col("next").alias("id")).agg(top)
        rest = live.filter("kids IS NULL OR kids > 1").join(tops, "id", "left").select(
            "id", F.when(F.col("top").isNull(), F.col("parent")).otherwise(F.col("top.up")).alias("parent"), "kids", *values,
            *[F.coalesce(f"top.n_{v}", f"_{v}").alias(f"_{v}") for v in values],
        )
        rest = stored(rest, "rest")

        leaves = rest.filter("kids IS NULL")
        raked = leaves.groupBy(F.col("parent").alias("id")).agg(*[F.sum(F.col(v) + F.col(f"_{v}")).alias(f"r_{v}") for v in values])
        steps.append((leaves.select("id", *values), chain.select("id", "next", *values)))
        inner = rest.filter("kids > 1").join(raked, "id", "left")
        live = stored(inner.select("id", "parent", *[plus(F.col(v), F.col(f"r_{v}")).alias(v) for v in values], *links), "inner")

    known: list[DataFrame] = []
    for leaves, chain in reversed(steps):
        known.append(leaves)
        ends = reduce(DataFrame.union, known).select(F.col("id").alias("next"), *[F.col(v).alias(f"t_{v}") for v in values])
        known.append(stored(chain.join(ends, "next").select("id", *[(F.col(v) + F.col(f"t_{v}")).alias(v) for v in values]), "expanded"))
    return reduce(DataFrame.union, known) if known else nodes.select("id", *values)
