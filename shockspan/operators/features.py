"""Feature engineering on the impact facts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shockspan.functions.columns import shift
from shockspan.operators.impact import CARRY, dedup_shocks, months_ahead, spread_windows, with_months
from shockspan.operators.ranges import range_sums
from shockspan.operators.selection import median
from shockspan.session import stored

EVENT = ["event_id", "county_id"]
LOOKBACK_YEARS = 2


def onehot(df: DataFrame, column: str, values: list[str], prefix: str) -> DataFrame:
    """Indicator columns, one per value of the caller's dimension; null is none of them.

    An open vocabulary has no such list: join ``category_code`` to it instead.
    """
    return df.select("*", *[F.col(column).eqNullSafe(F.lit(v)).cast("int").alias(f"{prefix}_{v}") for v in values])


def ranked(df: DataFrame, order: list[Column | str], out: str) -> DataFrame:
    """0-based places of all rows in a total order, without a task that sees them all.

    Rows are dealt out by ranges of the order and numbered inside their range; the
    sizes of the ranges before are added. The dealt-out rows are stored, so range
    borders are drawn once.
    """
    dealt = stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row per range
    before = F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    inside = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    rows = dealt.withColumn("_i", inside).join(starts, "_range")
    return rows.withColumn(out, F.col("_start") + F.col("_i")).drop("_range", "_i", "_start")


def category_code(df: DataFrame, column: str, code: str) -> DataFrame:
    """Value -> 0-based code in alphabetical order, of the distinct values."""
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    return ranked(values, [F.col(column)], code).select(column, F.col(code).cast("int").alias(code))


def temporal_columns(time: Column) -> list[Column]:
    angle = F.month(time) * (2 * math.pi / 12)
    return [
        F.month(time).alias("shock_month"),
        F.quarter(time).alias("shock_quarter"),
        F.year(time).alias("shock_year"),
        F.sin(angle).alias("month_sin"),
        F.cos(angle).alias("month_cos"),
    ]


def temporal_features(df: DataFrame, time: str = "begin_on") -> DataFrame:
    return df.select("*", *temporal_columns(F.col(time)))


def durations(facts: DataFrame, shocks: DataFrame) -> DataFrame:
    """Days from begin to end per shock of the facts; open ends get the median of
    the fact rows, negatives 0."""
    ends = dedup_shocks(shocks.select(*EVENT, "begin_on", "end_on"))
    ends = ends.select(*EVENT, "end_on", F.datediff("end_on", "begin_on").alias("_days"))
    rows = facts.groupBy(*EVENT).agg(F.count(F.lit(1)).alias("_rows")).join(ends, EVENT, "left")
    days = F.coalesce(F.col("_days").cast("double"), median(rows, "_days", "_rows"))
    out = rows.withColumn("duration_days", F.greatest(F.lit(0.0), days))
    return out.select(*EVENT, "end_on", "duration_days", F.log1p("duration_days").alias("log_duration"))


def duration_days(facts: DataFrame, shocks: DataFrame) -> DataFrame:
    return facts.join(durations(facts, shocks), EVENT)


def prior_shocks(shocks: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Other shocks of the same county in the two years before each shock.

    An event counts once per county, dated by its first begin there, so the count
    is a sum over a range and no pairs of shocks are formed.
    """
    mine = dedup_shocks(shocks.select(*EVENT, "begin_on"))
    past = mine if history is None else dedup_shocks(history.select(*EVENT, "begin_on"))
    counts = range_sums(
        past, mine, by=["county_id"], within=[], point_time="begin_on", anchor_time="begin_on",
        ranges={"prior_shocks": (lambda at: shift(at, 0, -LOOKBACK_YEARS), lambda at: at)},
        reach=(12 * LOOKBACK_YEARS, 0),
    )
    n = F.coalesce(F.col("prior_shocks"), F.lit(0))
    return mine.join(counts, ["county_id", "begin_on"], "left").select(
        *EVENT, "begin_on", n.alias("prior_shocks"), (n > 0).cast("int").alias("recently_hit")
    )


def decayed_exposure(shocks: DataFrame, tau_days: float = 365.0) -> DataFrame:
    """Prior shocks of the last two years, each weighted by exp(-days ago / tau).

    Our own definition of the exposure feature. The weight factors into a part of
    the earlier shock and a part of the later one, both relative to the slot's
    start, so again a sum over a range is enough.
    """
    mine = dedup_shocks(shocks.select(*EVENT, "begin_on"))
    sums = range_sums(
        mine, mine, by=["county_id"], within=[], point_time="begin_on", anchor_time="begin_on",
        ranges={"_sum": (lambda at: shift(at, 0, -LOOKBACK_YEARS), lambda at: at)},
        reach=(12 * LOOKBACK_YEARS, 0),
        weight=lambda at, start: F.exp(F.datediff(at, start) / F.lit(tau_days)),
    )
    since = F.datediff("begin_on", F.make_date(F.year("begin_on"), F.lit(1), F.lit(1)))
    value = F.coalesce(F.col("_sum") * F.exp(-since / F.lit(tau_days)), F.lit(0.0))
    return mine.join(sums, ["county_id", "begin_on"], "left").select(
        *EVENT, "begin_on", F.greatest(F.lit(0.0), value).alias("exposure_weighted")
    )


def map_lookup(df: DataFrame, mapping: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """Left join to a key -> value table, with a default for unknown keys.

    The optimizer broadcasts the table while it is below the session's threshold.
    """
    found = df.join(mapping.select(key, F.col(value).alias("_found")), key, "left")
    return found.withColumn(value, F.coalesce("_found", F.lit(default))).drop("_found")


def scale_columns(middle: Column) -> list[Column]:
    post, base = F.col("post_exits"), F.col("baseline_exits")
    return [
        F.when(base > 0, post / base).otherwise(post.cast("double")).alias("exit_ratio"),
        F.log1p(base).alias("log_baseline"),
        (base > middle).cast("int").alias("high_turnover"),
    ]


def scale_features(facts: DataFrame) -> DataFrame:
    return facts.select("*", *scale_columns(median(facts, "baseline_exits")))


def with_group_stats(facts: DataFrame, key: str | list[str], stats: dict[str, Column]) -> DataFrame:
    """Join grouped aggregates back to the rows.

    A row with a null key stays, without statistics. Grouping combines map-side, and the stored groups have a known size: as long as
    that is below the broadcast threshold, the rows stay where they are instead of
    meeting in one task per value.
    """
    keys = [key] if isinstance(key, str) else key
    groups = stored(facts.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()]), "groups")
    return facts.join(groups, keys, "left")


def target_mean(facts: DataFrame, column: str, out: str, target: str = "excess_exits", fold: str | None = None) -> DataFrame:
    """Mean target per value; with ``fold``, without the rows of the row's own fold."""
    if fold is None:
        return with_group_stats(facts, column, {out: F.avg(target)})
    per_fold = stored(facts.groupBy(column, fold).agg(F.sum(target).alias("_s"), F.count(target).alias("_c")), "folds")
    whole = per_fold.groupBy(column).agg(F.sum("_s").alias("_ws"), F.sum("_c").alias("_wc"))
    others = per_fold.join(whole, column).select(
        column, fold,
        F.when(F.col("_wc") > F.col("_c"), (F.col("_ws") - F.col("_s")) / (F.col("_wc") - F.col("_c"))).alias(out),
    )
    return facts.join(stored(others, "folds"), [column, fold], "left")


def frequency_encode(facts: DataFrame) -> DataFrame:
    """Rows per industry and distinct events per state."""
    rows = with_group_stats(facts, "industry", {"industry_frequency": F.count(F.lit(1))})
    events = facts.select("state", "event_id").distinct().groupBy("state").agg(F.count(F.lit(1)).alias("state_shock_frequency"))
    return rows.join(stored(events, "events"), "state", "left")


def peak_columns(prefix: str = "exits_month_", months: int = 6) -> list[Column]:
    """Month with the most exits (first on a tie), its count, and an early flag."""
    cols = F.array(*[F.col(f"{prefix}{i}") for i in range(1, months + 1)])
    top = F.array_max(cols)
    month = F.when(top == 0, 0).otherwise(F.array_position(cols, top)).cast("int")
    return [
        month.alias("peak_exit_month"),
        top.alias("peak_exits"),
        ((month <= 2) & (month > 0)).cast("int").alias("immediate_impact"),
    ]


def peak_features(monthly: DataFrame) -> DataFrame:
    return monthly.select("*", *peak_columns())


def interaction_columns() -> list[Column]:
    return [
        F.col("log_baseline").alias("shock_x_baseline"),
        (F.col("industry_vulnerability") * F.col("log_baseline")).alias("vuln_x_baseline"),
        (F.col("log_duration") * F.col("log_baseline")).alias("duration_x_baseline"),
        (F.col("prior_shocks") * F.col("industry_vulnerability")).alias("prior_x_vulnerability"),
    ]


def concentration_features(exits: DataFrame, sector: str = "sector") -> DataFrame:
    """Sector size, log size, share of the county's exits, and sum of squared shares.

    Our own definitions of features the reference names without code.
    """
    sizes = exits.groupBy("county_id", sector).agg(F.count(F.lit(1)).alias("sector_size"))
    whole = sizes.groupBy("county_id").agg(
        F.sum("sector_size").alias("_all"), F.sum(F.col("sector_size").cast("double") * F.col("sector_size")).alias("_sq")
    )
    return sizes.join(whole, "county_id").select(
        "county_id", sector, "sector_size",
        F.log1p("sector_size").alias("log_sector_size"),
        (F.col("sector_size") / F.col("_all")).alias("sector_concentration"),
        (F.col("_sq") / (F.col("_all") * F.col("_all").cast("double"))).alias("herfindahl_index"),
    )


def sector_growth(exits: DataFrame, sector: str = "sector") -> DataFrame:
    """Slope of yearly exits per county and sector (0 with a single year)."""
    yearly = exits.groupBy("county_id", sector, F.year("ended_on").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return yearly.groupBy("county_id", sector).agg(
        F.coalesce(F.regr_slope("n", "year"), F.lit(0.0)).alias("sector_growth_trend")
    )


def type_sector_displacement(facts: DataFrame) -> DataFrame:
    """Mean excess per event type and sector, rows per sector, and the type's code."""
    rows = with_group_stats(facts, ["event_type", "sector"], {"type_sector_avg_displacement": F.avg("excess_exits")})
    rows = with_group_stats(rows, "sector", {"sector_frequency": F.count(F.lit(1))})
    return rows.join(stored(category_code(facts, "event_type", "type_code"), "codes"), "event_type", "left")


def feature_profile(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Type, null count and mean per feature, with the spread of the target, in one pass."""
    types = dict(df.dtypes)
    stats = df.agg(
        *[
            F.struct(
                F.lit(c).alias("name"), F.lit(types[c]).alias("dtype"),
                F.count_if(F.col(c).isNull()).alias("nulls"), F.avg(F.col(c).cast("double")).alias("mean"),
                *[
                    (fn(F.col(c).cast("double")) if c == target else F.lit(None).cast("double")).alias(n)
                    for n, fn in (("std", F.stddev_samp), ("low", F.min), ("high", F.max))
                ],
            ).alias(f"_{i}")
            for i, c in enumerate([*features, target])
        ]
    )
    return stats.select(F.inline(F.array(*[f"_{i}" for i in range(len(features) + 1)])))


def fact_dimensions(facts: DataFrame) -> DataFrame:
    """Group statistics and codes per (industry, sector, event type, state).

    The facts are read once into sums per combination; the statistics of the single
    columns are built from those.
    """
    cells = stored(
        facts.groupBy("industry", "sector", "event_type", "state").agg(
            F.sum("excess_exits").alias("_sum"), F.count("excess_exits").alias("_count")
        ),
        "cells",
    )
    mean, rows = F.sum("_sum") / F.sum("_count"), F.sum("_count")
    per_industry = cells.groupBy("industry").agg(mean.alias("industry_vulnerability"), rows.alias("industry_frequency"))
    per_sector = cells.groupBy("sector").agg(mean.alias("sector_vulnerability"), rows.alias("sector_frequency"))
    per_type = cells.groupBy("event_type", "sector").agg(mean.alias("type_sector_avg_displacement"))
    events = facts.select("state", "event_id").distinct().groupBy("state").agg(F.count(F.lit(1)).alias("state_shock_frequency"))
    out = cells.drop("_sum", "_count").join(per_industry, "industry", "left").join(per_sector, "sector", "left")
    out = out.join(per_type, ["event_type", "sector"], "left").join(events, "state", "left")
    for column, code in (("industry", "industry_code"), ("sector", "sector_code"), ("event_type", "type_code"), ("state", "state_code")):
        out = out.join(category_code(cells, column, code), column, "left")
    return out


def joined_null_safe(rows: DataFrame, dims: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which a null key equals a null key."""
    other = dims.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.join(other, same, "left").drop(*[f"_{k}" for k in keys])


def feature_matrix(
    impact: DataFrame,
    shocks: DataFrame,
    exits: DataFrame,
    mapping: DataFrame,
    history: DataFrame | None = None,
    types: list[str] = (),
    sectors: list[str] = (),
    counts: DataFrame | None = None,
) -> DataFrame:
    """All features of an industry fact, one wide row each.

    ``types`` and ``sectors`` are the dimensions' values; each gets an indicator
    column. A fact with a null type, sector, state or industry stays, without the
    statistics of that column.

    ``impact`` should be a stored stage, since it is read for the facts, the group
    statistics and the medians. What joins to the facts (features per shock, per
    place and month, per place, per dimension) is stored first: its true size is
    then known, so the optimizer broadcasts exactly what is below its threshold and
    shuffles the facts only for what is not.
    ``exits`` carry an industry; sectors come from ``mapping``. ``counts`` are the same facts
    before their windows are spread (``impact_counts``); with them, everything known per
    shock, place and industry joins a third of the rows, which are spread afterwards.
    """
    facts = map_lookup(impact, mapping, "industry", "sector", "Other")
    sectored = map_lookup(exits.select("county_id", "industry", "ended_on"), mapping, "industry", "sector", "Other")

    per_shock = prior_shocks(shocks, history).join(decayed_exposure(shocks).drop("begin_on"), EVENT)
    per_shock = per_shock.select(*EVENT, "prior_shocks", "recently_hit", "exposure_weighted", *temporal_columns(F.col("begin_on")))
    per_shock = stored(durations(impact, shocks).join(per_shock, EVENT), "per-shock")
    per_place = stored(concentration_features(sectored).join(sector_growth(sectored), ["county_id", "sector"]), "per-place")
    per_month = stored(months_ahead(exits), "per-month")
    dims = stored(fact_dimensions(facts), "dimensions")

    rows = facts if counts is None else map_lookup(counts, mapping, "industry", "sector", "Other")
    rows = joined_null_safe(rows.join(per_shock, EVENT, "left"), dims, ["industry", "sector", "event_type", "state"])
    rows = with_months(rows.join(per_place, ["county_id", "sector"], "left"), per_month)
    if counts is not None:
        more = [c for c in rows.columns if c not in counts.columns]
        rows = spread_windows(rows, tuple(c for c in impact.columns if c in CARRY), tuple(more))
        first = ["county_id", "industry", "sector"]
        rows = rows.select(*first, *[c for c in rows.columns if c not in first])
    rows = rows.select("*", *peak_columns(), *scale_columns(median(impact, "baseline_exits")))
    rows = rows.select("*", *interaction_columns())
    return onehot(onehot(rows, "event_type", list(types), "type"), "sector", list(sectors), "sector")


METADATA = ["event_id", "event_type", "title", "county_id", "state", "area", "begin_on", "end_on", "industry", "sector"]
TARGET = "excess_exits"


def feature_columns(df: DataFrame) -> list[str]:
    """All columns but the keys, the target, what it is computed from, and the months."""
    skip = {*METADATA, TARGET, "post_exits", "baseline_yr2_exits", "baseline_yr3_exits"}
    return [c for c in df.columns if c not in skip and not c.startswith("exits_month_")]
