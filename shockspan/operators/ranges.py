"""Sums of dated points over ranges around dated anchors, without a range join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shockspan.functions.columns import shift
from shockspan.session import stored

def range_sums(
    points: DataFrame,
    anchors: DataFrame,
    *,
    by: list[str],
    within: list[str],
    point_time: str,
    anchor_time: str,
    ranges: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column]]],
    reach: tuple[int, int],
    weight: Callable[[Column, Column], Column] | None = None,
    cells_per_task: int = 250_000,
) -> DataFrame:
    """For each anchor and ``within`` group, the points in each half-open range.

    ``ranges`` maps an output name to the functions that give its low and high
    edge from the anchor time; ``reach`` is how many months of points before and
    after the anchor the ranges can touch. A range join would pair every anchor
    with every point of its key. Instead:

    * points collapse to one cell per key and time with map-side combine, so a
      hot key of any row count shrinks to at most one cell per day;
    * anchors sit in slots of one calendar year, and a cell is copied to the few
      slots it can reach, so one task never holds more than one slot of a key;
    * edges and cells of a slot are merged in time order and a running sum is read
      at each edge, edges first, which makes the ranges half-open.

    Times below day grain put no calendar bound on the cells, so for those the
    slots are split again into shares of about ``cells_per_task`` cells; the result
    is the same for any number.
    """
    day_grain = all(
        isinstance(df.schema[c].dataType, T.DateType)
        for df, c in ((points, point_time), (anchors, anchor_time))
    )
    key = [*by, *within]
    back, ahead = reach
    total = F.count(F.lit(1)).alias("_n")

    cells = points.filter(F.col(point_time).isNotNull()).groupBy(*key, F.col(point_time).alias("_at")).agg(total)
    if within or not day_grain:
        cells = stored(cells, "cells")  # read twice below; the points themselves once
    placed = cells.withColumn(
        "_slot",
        F.explode(
            F.sequence(F.year(shift(F.col("_at"), -ahead - 1)), F.year(shift(F.col("_at"), back + 1)))
        ),
    )
    if weight is None:
        amount, kind = F.col("_n"), "long"
    else:
        amount, kind = F.col("_n") * weight(F.col("_at"), F.make_date(F.col("_slot"), F.lit(1), F.lit(1))), "double"
    placed = placed.withColumn("_n", amount.cast(kind))

    marks = (
        anchors.select(*by, F.col(anchor_time).alias("_anchor"))
        .filter(F.col("_anchor").isNotNull())
        .distinct()
        .withColumn("_slot", F.year("_anchor"))
    )
    slots = [*key, "_slot"]
    if within or not day_grain:
        groups = placed.groupBy(*slots).agg(F.count(F.lit(1)).alias("_cells"))
        if not day_grain:
            groups = groups.withColumn("_shares", F.ceil(F.col("_cells") / cells_per_task).cast("int"))
        marks = marks.join(groups.drop("_cells"), [*by, "_slot"])
        if not day_grain:
            marks = marks.withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))).drop("_shares")
            placed = (
                placed.join(groups.select(*slots, "_shares"), slots)
                .withColumn("_share", F.pmod(F.xxhash64("_at"), F.col("_shares")).cast("int"))
                .drop("_shares")
            )
    lane = slots if day_grain else [*slots, "_share"]

    edges: list[Callable[[Column], Column]] = []
    for pair in ranges.values():
        edges += [e for e in pair if e not in edges]
    asked = marks.select(
        *lane,
        "_anchor",
        F.explode(
            F.array(
                *[F.struct(F.lit(i).alias("edge"), e(F.col("_anchor")).alias("at")) for i, e in enumerate(edges)]
            )
        ).alias("_e"),
    ).select(*lane, F.col("_e.at").alias("_at"), F.lit(0).cast(kind).alias("_n"), "_anchor", F.col("_e.edge").alias("_edge"))
    merged = asked.unionByName(placed.select(*lane, "_at", "_n"), allowMissingColumns=True)

    order = W.partitionBy(*lane).orderBy("_at", F.col("_edge").asc_nulls_last())
    run = F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    read = merged.withColumn("_run", run).filter(F.col("_edge").isNotNull())

    def span(lo, hi):
        e = F.col("_edge")
        return F.sum(
            F.when(e == edges.index(hi), F.col("_run")).when(e == edges.index(lo), -F.col("_run")).otherwise(0)
        )

    return (
        read.groupBy(*slots, "_anchor")
        .agg(*[span(lo, hi).cast(kind).alias(name) for name, (lo, hi) in ranges.items()])
        .drop("_slot")
        .withColumnRenamed("_anchor", anchor_time)
    )
