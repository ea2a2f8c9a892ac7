"""Listings, filters and the ranked answers over scenarios and forecasts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE_TYPE = ["state", "event_type"]


def filter_optional(df: DataFrame, equal: dict[str, str | None], contains: dict[str, str | None] | None = None) -> DataFrame:
    """Apply only the filters that are given, ignoring case."""
    tests: list[Column] = [F.lower(c) == v.lower() for c, v in equal.items() if v]
    tests += [F.contains(F.lower(c), F.lit(v.lower())) for c, v in (contains or {}).items() if v]
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def point_lookup(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.filter(F.col(column) == value).limit(1)


def write_for_lookups(df: DataFrame, path: str, keys: list[str], group_bytes: int = 16 << 20, distinct: int = 1_000_000) -> None:
    """Write a table for look-ups by its keys: sorted by them, with Bloom filters on each.

    Rows of a key lie in few row groups, whose ranges and filters let a scan with an equality on
    any of the keys pass over the others. ``distinct`` sizes the filters (about 1.2 bytes a
    value): the values of a row group, not of the table. Null keys come first. A key that holds many
    rows is spread over several files by the other columns' hash, so no task gets all of them.
    """
    spread = F.pmod(F.xxhash64(*[c for c in df.columns if c not in keys] or keys), F.lit(1024))
    ordered = df.withColumn("_spread", spread).repartitionByRange(*keys, "_spread").sortWithinPartitions(*keys, "_spread").drop("_spread")
    options = {"parquet.block.size": group_bytes}
    for k in keys:
        options |= {f"parquet.bloom.filter.enabled#{k}": True, f"parquet.bloom.filter.expected.ndv#{k}": distinct}
    ordered.write.options(**options).parquet(path)


def lookup(table: DataFrame, keys: dict[str, object]) -> DataFrame:
    """All rows of the keys, each compared in its column's own type, so that the scan can skip.

    None finds nulls; text that is no value of the type finds nothing.
    """
    types = {f.name: f.dataType for f in table.schema}
    tests = [F.col(k).isNull() if v is None else F.col(k) == F.lit(v).try_cast(types[k]) for k, v in keys.items()]
    return table.filter(reduce(lambda a, b: a & b, tests))


def list_limit(df: DataFrame, order: str, n: int = 200) -> DataFrame:
    if not 1 <= n <= 1000:
        raise ValueError("limit must lie in 1..1000")
    return df.orderBy(order).limit(n)


def fill_defaults(df: DataFrame) -> DataFrame:
    """0 for missing numbers, '' for missing text."""
    return df.fillna(0).fillna("")


def facet_values(df: DataFrame, event_type: str | None = None, state: str | None = None) -> DataFrame:
    """Choices of the cascading filters: all types, states of the chosen type, and
    the scenarios that match both."""
    of_type = df.filter(F.col("event_type") == event_type) if event_type else df
    both = of_type.filter(F.col("state") == state) if state else of_type
    scenario = F.concat_ws("_", "event_type", "county_id")
    parts = [("event_type", df, F.col("event_type")), ("state", of_type, F.col("state")), ("scenario", both, scenario)]
    return reduce(
        lambda a, b: a.unionByName(b),
        [d.select(F.lit(k).alias("facet"), c.alias("value")).filter(F.col("value").isNotNull()).distinct() for k, d, c in parts],
    )


def coverage_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.countDistinct("event_type").alias("total_events"),
        F.countDistinct("county_id").alias("regions_analyzed"),
        F.countDistinct("sector").alias("industries_tracked"),
    )


def list_scenarios(scenarios: DataFrame, regions: DataFrame) -> DataFrame:
    keys = scenarios.select("event_type", "county_id", "state").distinct().join(regions, "county_id", "left")
    return keys.select(F.concat_ws("_", "event_type", "county_id").alias("scenario"), "event_type", "county_id", "state", "region")


def risk_join(scenarios: DataFrame, forecast: DataFrame) -> DataFrame:
    """Scenario losses with the forecast of their state and type."""
    return scenarios.filter(F.col("job_loss_pct").isNotNull()).join(
        forecast.filter(F.col("avg_next_12").isNotNull()).select(*STATE_TYPE, "avg_next_12", "peak_months"), STATE_TYPE
    )


def _scope(scenarios: DataFrame, state: str | None, event_type: str | None) -> DataFrame:
    if state:
        scenarios = scenarios.filter(F.col("state") == state.upper())
    return scenarios.filter(F.col("event_type") == event_type.lower()) if event_type else scenarios


def sector_ranking(scenarios: DataFrame, state: str | None = None, event_type: str | None = None) -> DataFrame:
    """Sectors by mean loss and, apart, by mean surge; both from one grouping."""
    rows = _scope(scenarios, state, event_type).groupBy("sector").agg(
        F.avg("job_loss_pct").alias("loss"),
        F.avg(F.when(F.col("job_loss_pct").isNotNull(), F.col("recovery_months"))).alias("recovery"),
        F.avg("job_change_pct").alias("surge"),
        F.avg(F.when(F.col("job_change_pct").isNotNull(), F.col("peak_month"))).alias("peak"),
    )
    kinds = F.explode(
        F.array(
            F.struct(F.lit("loss").alias("kind"), F.col("loss").alias("pct"), F.col("recovery").alias("months")),
            F.struct(F.lit("surge").alias("kind"), F.col("surge").alias("pct"), F.col("peak").alias("months")),
        )
    )
    out = rows.select("sector", kinds.alias("k")).select("k.kind", "sector", "k.pct", "k.months").filter(F.col("pct").isNotNull())
    return out.orderBy("kind", F.desc("pct"), "sector")


def top_risk(scenarios: DataFrame, forecast: DataFrame, limit: int = 10) -> DataFrame:
    """State x sector x type by mean loss times forecast frequency."""
    rows = risk_join(scenarios, forecast).groupBy("state", "sector", "event_type", "avg_next_12").agg(
        F.avg("job_loss_pct").alias("loss"), F.avg("recovery_months").alias("recovery")
    )
    return (
        rows.select(
            "state", "sector", "event_type",
            F.round("loss", 1).alias("avg_loss_pct"),
            F.round("recovery", 0).alias("avg_recovery"),
            F.round("avg_next_12", 2).alias("freq_per_month"),
            F.round(F.col("loss") * F.col("avg_next_12"), 1).alias("risk_score"),
        )
        .orderBy(F.desc("risk_score"), "state", "sector", "event_type")
        .limit(limit)
    )


def portfolio(scenarios: DataFrame, states: DataFrame, event_type: str) -> DataFrame:
    """Sector losses over a set of states for one type."""
    rows = scenarios.filter((F.col("event_type") == event_type.lower()) & F.col("job_loss_pct").isNotNull())
    return (
        rows.join(states.select("state").distinct(), "state", "left_semi")
        .groupBy("sector")
        .agg(
            F.round(F.avg("job_loss_pct"), 1).alias("avg_loss"),
            F.round(F.max("job_loss_pct"), 1).alias("worst_loss"),
            F.round(F.avg("recovery_months"), 0).alias("avg_recovery"),
            F.countDistinct("state").alias("states_covered"),
        )
        .orderBy(F.desc("avg_loss"), "sector")
    )


def recovery_variance(scenarios: DataFrame) -> DataFrame:
    """Spread of recovery per sector and how reliable that makes it."""
    spread = F.col("range_months")
    return (
        scenarios.filter(F.col("recovery_months").isNotNull())
        .groupBy("sector")
        .agg(
            F.round(F.avg("recovery_months"), 1).alias("avg_recovery"),
            F.round(F.max("recovery_months") - F.min("recovery_months"), 1).alias("range_months"),
            F.round(F.avg("job_loss_pct"), 1).alias("avg_loss"),
            F.count(F.lit(1)).alias("n_data_points"),
        )
        .filter(F.col("n_data_points") >= 2)
        .withColumn("band", F.when(spread > 9, "HIGH").when(spread > 4, "MEDIUM").otherwise("LOW"))
        .orderBy(F.desc("range_months"), "sector")
    )


def demand_surge(scenarios: DataFrame, event_type: str | None = None) -> DataFrame:
    rows = _scope(scenarios.filter(F.col("job_change_pct").isNotNull()), None, event_type)
    return (
        rows.groupBy("sector", "event_type")
        .agg(
            F.round(F.avg("job_change_pct"), 1).alias("avg_surge"),
            F.round(F.avg("peak_month"), 0).alias("avg_peak"),
            F.countDistinct("state").alias("n_states"),
        )
        .orderBy(F.desc("avg_surge"), "sector", "event_type")
    )


def preposition(scenarios: DataFrame, forecast: DataFrame, limit: int = 10) -> DataFrame:
    """State x type by forecast frequency times mean loss, with the first two peaks."""
    rows = risk_join(scenarios, forecast.filter(F.col("avg_next_12") > 0))
    rows = rows.groupBy(*STATE_TYPE, "avg_next_12", "peak_months").agg(F.avg("job_loss_pct").alias("loss"))
    return (
        rows.select(
            *STATE_TYPE,
            F.round("avg_next_12", 2).alias("freq"),
            F.array_join(F.slice("peak_months", 1, 2), ", ").alias("peaks"),
            F.round("loss", 1).alias("avg_loss"),
            F.round(F.col("avg_next_12") * F.col("loss"), 1).alias("priority_score"),
        )
        .orderBy(F.desc("priority_score"), *STATE_TYPE)
        .limit(limit)
    )
