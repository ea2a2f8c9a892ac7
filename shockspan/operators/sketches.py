"""Summaries that add up, and the fields of JSON columns.

A sketch table holds a row per day; a new day is appended without a look at the old ones,
and any span of days is summed up from its few rows. Distinct values are HyperLogLog
sketches of 2^``lg_k`` registers, with a relative standard error of about 1.04 / sqrt(2^lg_k).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 12


def relative_error(lg_k: int = LG_K) -> float:
    """One standard error of a distinct count, as a share of it."""
    return 1.04 / 2 ** (lg_k / 2)


def daily_sketches(df: DataFrame, time: str, distinct: list[str], lg_k: int = LG_K) -> DataFrame:
    """Per day (null times: a day null): rows, nulls by column and a sketch by named column.

    Partial aggregates combine before the shuffle, so a day of a third of all rows is no more
    than a sketch from each task. The columns named have to be integers, text or binary.
    """
    return df.groupBy(F.col(time).cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(time).alias("first_time"),
        F.max(time).alias("last_time"),
        *[F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in df.columns],
        *[F.hll_sketch_agg(c, lg_k).alias(f"sketch_{c}") for c in distinct],
    )


def summary_of_days(days: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """``dataset_summary`` of the days from ``start`` to ``end``; distinct counts are estimates.

    Several rows of a day, as appended by different loads, count together; without a day
    the counts are 0 and the times null. A span leaves out rows whose time is null.
    """
    if start is not None:
        days = days.filter(F.col("day") >= F.lit(start).cast("date"))
    if end is not None:
        days = days.filter(F.col("day") <= F.lit(end).cast("date"))
    nulls = [c for c in days.columns if c.startswith("nulls_")]
    sketches = [c for c in days.columns if c.startswith("sketch_")]
    zero = F.lit(0).cast("long")
    return days.agg(
        F.coalesce(F.sum("n_rows"), zero).alias("n_rows"),
        F.min("first_time").alias("first_time"),
        F.max("last_time").alias("last_time"),
        (F.max(F.year("last_time")) - F.min(F.year("first_time")) + 1).alias("n_years"),
        *[F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), zero).alias("n_" + c.removeprefix("sketch_")) for c in sketches],
        *[F.coalesce(F.sum(c), zero).alias(c) for c in nulls],
    )


def fields_of(column: str) -> Column:
    """A JSON object's top-level fields as variants by name; null for any other text."""
    return F.from_json(column, "map<string,variant>")


def json_fields(df: DataFrame, column: str) -> DataFrame:
    """The top-level fields of a JSON column: rows, nulls and one type that holds all values.

    Text that is no JSON object has no fields. Only counts and merged types leave a task.
    """
    return df.select(F.explode(fields_of(column)).alias("field", "_v")).groupBy("field").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.is_variant_null("_v")).alias("n_null"),
        F.schema_of_variant_agg("_v").alias("type"),
    )


def typed_fields(df: DataFrame, column: str, fields: dict[str, str], rest: str = "rest") -> DataFrame:
    """Named fields of a JSON column in types of their own; what they do not hold stays as JSON text in ``rest``.

    Fields that are not named stay in ``rest``, and so does a value that does not fit its type
    (null in its own column); text that is no JSON object stays there as it is.
    """
    found = fields_of(column)
    got = {n: F.try_variant_get(F.try_element_at(found, F.lit(n)), "$", t) for n, t in fields.items()}
    taken = F.array_compact(F.array(*[F.when(c.isNotNull(), F.lit(n)) for n, c in got.items()]).cast("array<string>"))
    left = F.to_json(F.map_filter(found, lambda k, _: ~F.array_contains(taken, k)), {"ignoreNullFields": "false"})
    return df.select("*", *[c.alias(n) for n, c in got.items()], F.when(found.isNotNull(), left).otherwise(F.col(column)).alias(rest))
