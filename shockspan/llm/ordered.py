"""Places and running sums inside ordered groups of any size.

Rows are dealt out by ranges of (group, order), so a group that holds a third of all
rows spreads over many tasks; sums run inside a range, and the sums of a group's earlier
ranges, one row per range and group, are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shockspan.session import stored


def dealt(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """The rows by ranges of ``by`` and ``order`` (nulls first), with their ``_range``; stored, so borders are drawn once."""
    return stored(df.repartitionByRange(by, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def running(rows: DataFrame, by: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``dealt`` rows with sums over the rows of their group up to themselves; ``by`` holds no nulls."""
    inside = W.partitionBy("_range", by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy(by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy("_range", by).agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    carried = totals.select("_range", by, *[F.sum(f"_{n}").over(before).alias(f"_{n}") for n in sums])
    carried = carried.filter(" OR ".join(f"_{n} IS NOT NULL" for n in sums))
    out = rows.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()}).join(carried, ["_range", by], "left")
    return out.withColumns({n: F.col(n) + F.coalesce(f"_{n}", F.lit(0)) for n in sums}).drop(*[f"_{n}" for n in sums])
