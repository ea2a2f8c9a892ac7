"""Shock cleaning, exit flattening and the window impact join."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shockspan.functions.columns import month_index, month_start, pad_left, shift
from shockspan.operators.ranges import range_sums

WINDOWS = [(1, 0, 6), (2, 6, 12), (3, 12, 18)]  # number, first month, end month
BASE_YEARS = [2, 3]
CARRY = ("event_type", "title", "area", "state")


def county_key(state_code: Column, county_code: Column) -> Column:
    """Five-character place key from a state part and a county part."""
    return F.concat(pad_left(state_code, 2), pad_left(county_code, 3))


def major_only(shocks: DataFrame, level: str, county_code: str = "county_code") -> DataFrame:
    """Keep one declaration level and drop statewide rows (county part 000)."""
    return shocks.filter((F.col("level") == level) & (F.col(county_code) != "000"))


def flatten_exits(persons: DataFrame) -> DataFrame:
    """One row per finished job with a place, a company and an industry."""
    job = F.col("job")
    return (
        persons.select(F.explode("jobs").alias("job"))
        .filter(job["ended_at"].isNotNull() & (job["ended_at"] != ""))
        .filter(job["location_details"].isNotNull() & job["company"].isNotNull())
        .select(
            job["location_details"]["county_id"].alias("county_id"),
            job["company"]["industry"].alias("industry"),
            job["company"]["name"].alias("company"),
            job["title"].alias("title"),
            F.to_date(job["started_at"]).alias("started_on"),
            F.to_date(job["ended_at"]).alias("ended_on"),
            job["location_details"]["locality"].alias("locality"),
            job["location_details"]["region"].alias("region"),
        )
        .dropna(subset=["county_id", "industry"])
        .withColumn("end_month", month_start(F.col("ended_on")))
    )


def dedup_shocks(shocks: DataFrame, keys: tuple[str, ...] = ("event_id", "county_id"), order: str = "begin_on") -> DataFrame:
    """Earliest row per key, taken as a minimum so that copies combine map-side."""
    rest = [c for c in shocks.columns if c not in keys]
    ordered = [order, *[c for c in rest if c != order]]
    return (
        shocks.groupBy(*keys)
        .agg(F.min(F.struct(F.col(order).isNull().alias("_undated"), *ordered)).alias("_row"))
        .select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in shocks.columns])
    )


def overlap_filter(shocks: DataFrame, exits: DataFrame, key: str = "county_id") -> DataFrame:
    """Keep shocks in places that have exits."""
    return shocks.join(exits.select(key).distinct(), key, "left_semi")


@cache
def edge(months: int, years: int = 0):
    """The edge that lies so many months, then so many years back, from the anchor.

    Cached so that equal edges are one object: two ranges share it, and the
    edges 12/-3y and 0/-2y (or 18/-3y and 6/-2y) are the same day for every anchor.
    """
    if years and months >= 12:
        return edge(months - 12, years - 1)
    return lambda at: shift(at, months, -years)


def impact_counts(shocks: DataFrame, exits: DataFrame, industry: str = "industry", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per shock, place and industry with the counts of all windows side by side."""
    ranges = {}
    for n, start, end in WINDOWS:
        ranges[f"post_{n}"] = (edge(start), edge(end))
        for y in BASE_YEARS:
            ranges[f"base{y}_{n}"] = (edge(start, y), edge(end, y))
    counts = range_sums(
        exits.select("county_id", F.col(industry).alias("industry"), "ended_on"),
        shocks.select("county_id", "begin_on"),
        by=["county_id"],
        within=["industry"],
        point_time="ended_on",
        anchor_time="begin_on",
        ranges=ranges,
        reach=(36, 18),
    )
    some = sum((F.col(c) for c in ranges), F.lit(0)) > 0
    places = dedup_shocks(shocks.select("event_id", "county_id", "begin_on", *carry))
    return places.join(counts.filter(some), ["county_id", "begin_on"])


def impact_keys(shocks: DataFrame, exits: DataFrame, industry: str = "industry") -> DataFrame:
    """The shocks, places and industries of ``window_impact``, before windows are spread."""
    return impact_counts(shocks, exits, industry).select("event_id", "county_id", "begin_on", "industry")


def window_impact(
    shocks: DataFrame,
    exits: DataFrame,
    industry: str = "industry",
    carry: tuple[str, ...] = CARRY,
) -> DataFrame:
    """Exits after each shock, by industry and half-year window, against baselines.

    Three windows of six months follow the shock; each is compared with the mean
    of the same window two and three years earlier. A row appears for each industry
    seen in any of the three ranges of its window.
    """
    return spread_windows(impact_counts(shocks, exits, industry, carry), carry)


def spread_windows(counts: DataFrame, carry: tuple[str, ...] = CARRY, more: tuple[str, ...] = ()) -> DataFrame:
    """A row per window out of the counts side by side, and its excess; ``more`` columns stay as they are.

    What is joined before has a third of the rows to meet.
    """
    spread = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(n).alias("window_num"),
                    F.col(f"post_{n}").alias("post_exits"),
                    F.col(f"base2_{n}").alias("baseline_yr2_exits"),
                    F.col(f"base3_{n}").alias("baseline_yr3_exits"),
                )
                for n, _, _ in WINDOWS
            ]
        )
    )
    facts = counts.select("event_id", "county_id", "begin_on", *carry, "industry", *more, spread.alias("w"))
    facts = facts.select("event_id", "county_id", "begin_on", *carry, "industry", "w.*", *more)
    facts = with_excess(facts.filter(F.col("post_exits") + F.col("baseline_yr2_exits") + F.col("baseline_yr3_exits") > 0))
    return facts.select(*[c for c in facts.columns if c not in more], *more)


def with_excess(facts: DataFrame) -> DataFrame:
    """Mean baseline and excess of the post-shock count over it."""
    base = (F.col("baseline_yr2_exits") + F.col("baseline_yr3_exits")) / 2
    return facts.select("*", base.alias("baseline_exits"), (F.col("post_exits") - base).alias("excess_exits"))


def to_sector_level(impact: DataFrame) -> DataFrame:
    """Sum industry facts up to sectors and recompute the excess."""
    keys = ["event_id", "county_id", "begin_on", "event_type", "title", "area", "state", "sector", "window_num"]
    counts = ["post_exits", "baseline_yr2_exits", "baseline_yr3_exits"]
    return with_excess(impact.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts]))


def months_ahead(exits: DataFrame, group: str = "industry", months: int = 6) -> DataFrame:
    """Per place, group and start month: the exits of that and the next months.

    Built from monthly counts alone, each added to the start months it lies ahead
    of; its size is bounded by places, groups and calendar months.
    """
    counts = (
        exits.filter(F.col("ended_on").isNotNull())
        .groupBy("county_id", group, month_index(F.col("ended_on")).alias("_month"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    shifted = counts.withColumn("_offset", F.explode(F.sequence(F.lit(0), F.lit(months - 1))))
    return shifted.groupBy("county_id", group, (F.col("_month") - F.col("_offset")).alias("start_month")).agg(
        *[F.coalesce(F.sum(F.when(F.col("_offset") == m, F.col("_n"))), F.lit(0)).alias(f"exits_month_{m + 1}") for m in range(months)]
    )


def exits_by_month_offset(keys: DataFrame, exits: DataFrame, months: int = 6) -> DataFrame:
    """Exits of a shock's industry by calendar month after the shock; ``keys`` as of ``impact_keys``."""
    return with_months(keys, months_ahead(exits, "industry", months), months)


def with_months(rows: DataFrame, ahead: DataFrame, months: int = 6) -> DataFrame:
    """Add the counts of ``months_ahead`` to rows of place, industry and begin."""
    joined = rows.withColumn("start_month", month_index(F.col("begin_on"))).join(ahead, ["county_id", "industry", "start_month"], "left")
    return joined.drop("start_month").fillna(0, [f"exits_month_{m + 1}" for m in range(months)])


def excess_by(impact: DataFrame, *dims: str) -> DataFrame:
    """Mean excess and row count per value of the given columns."""
    return impact.groupBy(*dims).agg(
        F.round(F.avg("excess_exits"), 6).alias("mean_excess"), F.count(F.lit(1)).alias("n_rows")
    )
