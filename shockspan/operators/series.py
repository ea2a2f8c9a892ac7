"""Monthly count series: building, summarising, ranking and selecting them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shockspan.functions.columns import MONTHS, month_start, ratio

KEYS = ["state", "event_type"]


def monthly_counts(shocks: DataFrame, keys: list[str] = KEYS, time: str = "begin_on") -> DataFrame:
    return (
        shocks.filter(F.col(time).isNotNull())
        .groupBy(*keys, month_start(F.col(time)).alias("month"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def combo_stats(monthly: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Total, mean of the active months, largest month and count of active months."""
    return monthly.groupBy(*keys).agg(
        F.sum("n").alias("total"),
        F.round(F.avg("n"), 6).alias("avg_active_month"),
        F.max("n").alias("max_month"),
        F.count(F.lit(1)).alias("months_with_data"),
    )


def threshold_filter(stats: DataFrame, min_total: int = 10, min_months: int = 12, types: list[str] | None = None) -> DataFrame:
    kept = stats.filter((F.col("total") >= min_total) & (F.col("months_with_data") >= min_months))
    return kept if types is None else kept.filter(F.col("event_type").isin(types))


def select_top_combos(stats: DataFrame, min_total: int = 10, min_months: int = 12, n: int = 3) -> DataFrame:
    """Per state, the n largest eligible types; ties go to the type first in order."""
    rank = F.row_number().over(W.partitionBy("state").orderBy(F.desc("total"), "event_type"))
    return threshold_filter(stats, min_total, min_months).withColumn("state_rank", rank).filter(F.col("state_rank") <= n)


def unmatched_states(stats: DataFrame, selected: DataFrame) -> DataFrame:
    return stats.select("state").distinct().join(selected.select("state").distinct(), "state", "left_anti")


def sparse_flag(selected: DataFrame, below: float = 0.5) -> DataFrame:
    return selected.filter(F.col("avg_active_month") < below)


def coverage_by_type(selected: DataFrame) -> DataFrame:
    return selected.groupBy("event_type").agg(F.count("state").alias("n_states"))


def state_summary(selected: DataFrame) -> DataFrame:
    """One line per state: its selected types with their totals, in rank order."""
    part = F.struct("state_rank", F.format_string("%s (%d)", "event_type", "total").alias("part"))
    return selected.groupBy("state").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["part"]), ", ").alias("summary")
    )


def top1_per_state(stats: DataFrame) -> DataFrame:
    lead = F.min(F.struct((-F.col("total")).alias("neg"), "event_type"))
    return stats.groupBy("state").agg(lead.alias("lead")).select(
        "state", F.col("lead.event_type").alias("event_type"), (-F.col("lead.neg")).alias("total")
    )


def global_top(df: DataFrame, by: str, n: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(by), *ties).limit(n)


def share_of_total(stats: DataFrame, by: str = "event_type", value: str = "total") -> DataFrame:
    """Total per value and its share of the grand total, read as a scalar subquery."""
    whole = stats.select(F.sum(value)).scalar()
    per = stats.groupBy(by).agg(F.sum(value).alias("total"))
    return per.select(by, "total", F.round(F.col("total") * 100.0 / whole, 6).alias("pct"))


def value_counts_top(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), *columns).limit(n)


def calendar_profile(df: DataFrame, time: str = "begin_on") -> DataFrame:
    """Counts by year and by month of year, both rolled up from one scan."""
    cells = df.filter(F.col(time).isNotNull()).groupBy(
        F.year(time).alias("year"), F.month(time).alias("month")
    ).agg(F.count(F.lit(1)).alias("n"))
    part = F.explode(
        F.array(
            F.struct(F.lit("year").alias("kind"), F.col("year").alias("value")),
            F.struct(F.lit("month").alias("kind"), F.col("month").alias("value")),
        )
    )
    return cells.select(part.alias("p"), "n").groupBy("p.kind", "p.value").agg(F.sum("n").alias("n"))


def dataset_summary(df: DataFrame, time: str, distinct: list[str], error: float | None = None) -> DataFrame:
    """Row count, time span, distinct values of the named columns, nulls per column.

    Each distinct count is one over its own column's values, which combine before the
    shuffle; together in one aggregate they would multiply every row. With a relative
    ``error`` they are estimated in the same pass instead.
    """
    if error is None:
        values = {c: df.select(c).distinct().select(F.count(c)).scalar() for c in distinct}
    else:
        values = {c: F.col(f"_{c}") for c in distinct}
    whole = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(time).alias("first_time"),
        F.max(time).alias("last_time"),
        (F.max(F.year(time)) - F.min(F.year(time)) + 1).alias("n_years"),
        *[F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in df.columns],
        *[F.approx_count_distinct(c, error).alias(f"_{c}") for c in distinct if error is not None],
    )
    return whole.select(
        "n_rows", "first_time", "last_time", "n_years", *[v.alias(f"n_{c}") for c, v in values.items()], *[f"nulls_{c}" for c in df.columns]
    )


def calendar_span(monthly: DataFrame) -> tuple[Column, Column]:
    """First and last counted month over all series, as scalar subqueries."""
    return monthly.select(F.min("month")).scalar(), monthly.select(F.max("month")).scalar()


def calendar_fill(monthly: DataFrame, start: Column | str | None = None, end: Column | str | None = None, keys: list[str] = KEYS) -> DataFrame:
    """Every month of the calendar per series, 0 where nothing was counted.

    With no calendar given, each series runs from its first to its last month; with
    ``calendar_span`` all series share the span of the data, its last month included
    even where it is not over. A span of the caller's own leaves out what lies beyond
    it; give such months neither to this function nor to the totals beside it. One
    grouping by series carries the counts as a map (at most one entry per month), so
    the output stays partitioned by series and later groupings need no shuffle.
    """
    wide = monthly.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("month", "n"))).alias("counts"), F.min("month").alias("lo"), F.max("month").alias("hi")
    )
    lo = F.col("lo") if start is None else F.to_date(F.lit(start))
    hi = F.col("hi") if end is None else F.to_date(F.lit(end))
    months = F.sequence(lo, hi, F.make_ym_interval(F.lit(0), F.lit(1)))
    return wide.select(*keys, "counts", F.size(months).alias("months"), F.posexplode(months).alias("t", "month")).select(
        *keys, "months", "t", "month", F.coalesce(F.try_element_at("counts", F.col("month")), F.lit(0)).alias("n")
    )


def combo_series(monthly: DataFrame, selected: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return monthly.join(selected.select(*keys), keys, "left_semi")


def month_means() -> Column:
    """Twelve means by month of year, as one array per group."""
    return F.array(*[F.avg(F.when(F.month("month") == m, F.col("n"))) for m in range(1, 13)])


def top_months(means: Column, n: int = 3) -> Column:
    """Names of the n months with the largest mean; ties go to the earlier month."""
    ranked = F.array_sort(F.transform(means, lambda x, i: F.struct((-x).alias("neg"), i.alias("i"))))
    names = F.array(*[F.lit(m) for m in MONTHS])
    present = F.filter(ranked, lambda p: p["neg"].isNotNull())
    return F.transform(F.slice(present, 1, n), lambda p: F.element_at(names, p["i"] + 1))


def peak_months(series: DataFrame, n: int = 3, keys: list[str] = KEYS) -> DataFrame:
    return series.groupBy(*keys).agg(month_means().alias("m")).select(*keys, top_months(F.col("m"), n).alias("peak_months"))


def series_summary(series: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    per_year = F.sum("n") / (F.count(F.lit(1)) / 12)
    return series.groupBy(*keys).agg(
        F.sum("n").alias("total"),
        F.round(F.avg("n"), 6).alias("avg_per_month"),
        F.max("n").alias("max_in_month"),
        F.count(F.lit(1)).alias("span_months"),
        F.round(per_year, 6).alias("avg_per_year"),
        month_means().alias("m"),
    ).withColumn("peak_months", F.array_join(top_months(F.col("m")), ", ")).drop("m")


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t for whole degrees of freedom.

    The finite trigonometric sums of the t distribution (odd and even degrees).
    """
    angle = F.atan(F.abs(t) / F.sqrt(df))
    cos, sin = F.cos(angle), F.sin(angle)

    def tail(first: int) -> Column:
        # 1 + sum over k of prod((k - 1) / k) * cos^(k - first), k in steps of two
        steps = F.when(df - 2 >= first + 2, F.sequence(F.lit(first + 2), (df - 2).cast("int"), F.lit(2))).otherwise(
            F.array().cast("array<int>")
        )
        start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

        def step(acc, k):
            term = acc["term"] * (k - 1) / k * cos * cos
            return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

        return F.aggregate(steps, start, step, lambda acc: acc["sum"])

    odd = F.when(df == 1, angle).otherwise(angle + sin * cos * tail(1)) * (2 / math.pi)
    even = sin * tail(0)
    return F.greatest(F.lit(0.0), 1 - F.when(df % 2 == 1, odd).otherwise(even))


def trend_columns(y: Column, x: Column, least: int) -> list[Column]:
    """Slope, R2 and p-value of a straight line; null below ``least`` points."""
    n = F.count(F.when(y.isNotNull() & x.isNotNull(), 1))
    r2 = F.when(F.regr_syy(y, x) == 0, F.lit(0.0)).otherwise(F.regr_r2(y, x))
    enough = n >= least
    t = F.sqrt(ratio(r2 * (n - 2), 1 - r2))
    p = F.when(r2 >= 1, F.lit(0.0)).otherwise(student_p(t, n - 2))
    return [
        F.when(enough, F.regr_slope(y, x)).alias("slope"),
        F.when(enough, r2).alias("r_squared"),
        F.when(enough, p).alias("p_value"),
    ]


def trend_label(none: str) -> Column:
    slope, p = F.col("slope"), F.col("p_value")
    return (
        F.when(slope.isNull(), F.lit("insufficient_data"))
        .when((p < 0.05) & (slope > 0), F.lit("increasing"))
        .when(p < 0.05, F.lit("decreasing"))
        .otherwise(F.lit(none))
    )


def trend_test(df: DataFrame, keys: list[str], time: str, value: Column | None = None, least: int = 3, none: str = "stable") -> DataFrame:
    """Straight-line trend of yearly totals, with its significance."""
    total = F.count(F.lit(1)) if value is None else F.sum(value)
    yearly = df.filter(F.col(time).isNotNull()).groupBy(*keys, F.year(time).alias("year")).agg(total.alias("total"))
    fit = yearly.groupBy(*keys).agg(*trend_columns(F.col("total"), F.col("year"), least))
    return fit.withColumn("trend", trend_label(none))
