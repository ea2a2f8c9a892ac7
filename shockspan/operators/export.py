"""Scenario impacts, regional series and roll-ups of scenario predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shockspan.functions.columns import clamp, half_even, month_index, type_key
from shockspan.operators.serving import lookup
from shockspan.session import stored

CAP = 95
SCENARIO = ["event_type", "county_id"]


def scenario_impact(facts: DataFrame, value: str = "excess_exits", top: int = 8) -> DataFrame:
    """Per event type, county and sector: loss or gain in percent of the baseline.

    Sectors need all three windows and a baseline of at least 1; changes below 1 %
    are dropped; percentages are capped. The ``top`` largest sectors are kept.
    """
    means = [F.avg(F.when(F.col("window_num") == w, F.col(value))).alias(f"w{w}") for w in (1, 2, 3)]
    rows = facts.groupBy(*SCENARIO, "sector").agg(F.min("state").alias("state"), F.avg("baseline_exits").alias("base"), *means)
    rows = rows.dropna(subset=["w1", "w2", "w3", "base"]).filter(F.col("base") >= 1)
    w1, w2, w3, base = (F.col(c) for c in ("w1", "w2", "w3", "base"))
    excess = (w1 + w2 + w3) / 3
    pct = excess / base * 100
    rows = rows.filter(F.abs(pct) >= 1)
    size = half_even(F.abs(clamp(pct, -CAP, CAP)), 0)
    parts = [clamp(w / base * 100, -CAP, CAP) for w in (w1, w2, w3)]
    loss = excess > 0
    recovery = F.when(w1 <= 0, 6.0).when(parts[1] <= parts[0] * 0.1, 12.0).otherwise(18.0)
    peak = F.when((w1 < w2) & (w1 < w3), 3).when(w2 < w3, 9).otherwise(15)
    rows = rows.select(
        type_key(F.col("event_type")).alias("event_type"), "county_id", "state", "sector",
        F.when(loss, size).alias("job_loss_pct"),
        F.when(~loss, size).alias("job_change_pct"),
        F.when(loss, recovery).alias("recovery_months"),
        F.when(~loss, peak).alias("peak_month"),
        *[half_even(p, 1).alias(f"window_{i}_pct") for i, p in enumerate(parts, 1)],
        size.alias("_size"),
    )
    order = W.partitionBy(*SCENARIO).orderBy(F.desc("_size"), "sector")
    return rows.withColumn("sector_rank", F.row_number().over(order)).filter(F.col("sector_rank") <= top).drop("_size")


def region_name(area: Column, state: Column) -> Column:
    clean = F.replace(F.replace(area, F.lit(" (County)"), F.lit(" County")), F.lit(" (City)"), F.lit(""))
    return F.concat(clean, F.lit(", "), state)


def scenario_region(keys: DataFrame, facts: DataFrame) -> DataFrame:
    """Readable region per county: the area of its first event, else the county key."""
    first = facts.groupBy("county_id").agg(F.min(F.struct("event_id", "area", "state")).alias("f"))
    name = region_name(F.col("f.area"), F.col("f.state"))
    return keys.join(first, "county_id", "left").select(
        *keys.columns, F.coalesce(name, F.concat(F.lit("FIPS "), "county_id")).alias("region")
    )


def regional_series(facts: DataFrame, exits: DataFrame) -> DataFrame:
    """Change against the monthly baseline for months 0-17 after a shock.

    Months are counted from the exits themselves, reduced to monthly counts first.
    """
    keys = ["event_type", "county_id", "sector"]
    base = (
        facts.groupBy(*keys)
        .agg(F.avg("baseline_exits").alias("base"), F.max(F.abs("excess_exits")).alias("peak"))
        .filter(F.col("base") >= 1)
    )
    monthly = (
        exits.filter(F.col("ended_on").isNotNull())
        .groupBy("county_id", "sector", month_index(F.col("ended_on")).alias("month"))
        .agg(F.count(F.lit(1)).alias("exits"))
    )
    first = (F.col("window_num") - 1) * 6
    rows = (
        facts.select(*keys, "state", "begin_on", F.explode(F.sequence(first, first + 5)).alias("month_offset"))
        .groupBy(*keys, "state", "month_offset", (month_index(F.col("begin_on")) + F.col("month_offset")).alias("month"))
        .agg(F.count(F.lit(1)).alias("copies"))
        .join(monthly, ["county_id", "sector", "month"], "left")
        .join(base, keys)
    )
    per_month = F.col("base") / 6
    change = F.coalesce(F.col("exits"), F.lit(0)) - per_month
    recovery = F.when(F.col("peak") > 0, clamp(1 - F.abs(change) / (F.col("peak") / 6), 0.0, 1.0)).otherwise(1.0)

    def mean(c, digits):
        # without the noise of binary fractions, and summed as decimals, so that
        # neither ties nor the order of the rows depend on the engine
        total = F.sum(half_even(F.round(c, 9), digits).cast("decimal(24,2)") * F.col("copies"))
        return F.round(total.cast("double") / F.sum("copies"), 8)

    return rows.groupBy(
        "county_id", "state", "sector", type_key(F.col("event_type")).alias("event_type"), "month_offset"
    ).agg(
        mean(change, 1).alias("job_change_count"),
        mean(change / per_month * 100, 1).alias("job_change_pct"),
        mean(recovery, 2).alias("recovery_rate"),
    )


def rollup_predictions(scenarios: DataFrame, keys: list[str]) -> DataFrame:
    """Average county predictions per key; the more frequent direction wins.

    Losses win ties. Without any recovery the default is 12 months, without any
    peak it is month 3.
    """
    loss, gain = F.col("job_loss_pct"), F.col("job_change_pct")
    n_loss, n_gain = F.count(loss), F.count(gain)
    lose = (n_loss >= n_gain) & (n_loss > 0)
    recovery = F.avg(F.when(loss.isNotNull(), F.col("recovery_months")))
    peak = F.avg(F.when(gain.isNotNull(), F.col("peak_month")))
    return scenarios.groupBy(*keys).agg(
        F.when(lose, half_even(F.avg(loss), 1)).alias("job_loss_pct"),
        F.when(lose, F.coalesce(half_even(recovery, 0), F.lit(12.0))).alias("recovery_months"),
        F.when(~lose, half_even(F.avg(gain), 1)).alias("job_change_pct"),
        F.when(~lose, F.coalesce(half_even(peak, 0), F.lit(3.0))).cast("int").alias("peak_month"),
        n_loss.alias("n_loss"),
        n_gain.alias("n_gain"),
    )


def rollup_state(scenarios: DataFrame) -> DataFrame:
    """Per state, type and sector, with the count of counties behind the state."""
    n = scenarios.groupBy("state", "event_type").agg(F.countDistinct("county_id").alias("n_counties"))
    return rollup_predictions(scenarios, ["state", "event_type", "sector"]).join(n, ["state", "event_type"])


def rollup_national(scenarios: DataFrame) -> DataFrame:
    """Per type and sector, with the counties and states behind the type."""
    pairs = scenarios.groupBy("event_type", "county_id").agg(F.min("state").alias("state"))
    n = pairs.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_counties"), F.countDistinct("state").alias("n_states"))
    return rollup_predictions(scenarios, ["event_type", "sector"]).join(n, "event_type")


def rollup_state_all(scenarios: DataFrame) -> DataFrame:
    """Per state and type, pooled over sectors, with the state's entries and types."""
    pairs = scenarios.select("state", "event_type", "county_id").distinct()
    n = pairs.groupBy("state").agg(F.count(F.lit(1)).alias("n_counties"), F.countDistinct("event_type").alias("n_types"))
    return rollup_predictions(scenarios, ["state", "event_type"]).join(n, "state")


def choose_rollup(scenarios: DataFrame, event_type: str | None = None, county_id: str | None = None, state: str | None = None) -> DataFrame:
    """The level that the given inputs call for."""
    if event_type and county_id:
        return scenarios.filter((F.col("event_type") == event_type) & (F.col("county_id") == county_id))
    if event_type and state:
        return rollup_state(scenarios.filter((F.col("event_type") == event_type) & (F.col("state") == state)))
    if event_type:
        return rollup_national(scenarios.filter(F.col("event_type") == event_type))
    if state:
        return rollup_state_all(scenarios.filter(F.col("state") == state))
    raise ValueError("an event type or a state is needed")


def resolve_prediction(requests: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Exact county where it exists, else the state's roll-up, else nothing.

    ``requests`` need an event type, a county and a state; one row per sector comes
    back, or one without a sector where neither level knows the request.
    """
    values = ["sector", "job_loss_pct", "job_change_pct", "recovery_months", "peak_month"]
    known = scenarios.select(*SCENARIO).distinct()
    exact = requests.join(scenarios.select(*SCENARIO, *values), SCENARIO).withColumn("source", F.lit("county"))
    rest = requests.join(known, SCENARIO, "left_anti")
    by_state = stored(rollup_state(scenarios).select("event_type", "state", *values), "by-state")
    fallback = rest.join(by_state.withColumn("source", F.lit("state")), ["event_type", "state"], "left")
    return exact.unionByName(fallback)


def resolve_one(exact: DataFrame, by_state: DataFrame, event_type: str, county_id: str, state: str) -> DataFrame:
    """The answer of ``resolve_prediction`` to one request, from tables of ``write_for_lookups``.

    ``exact`` is sorted by county and type, ``by_state`` (``rollup_state``) by state and type;
    each is one look-up, no row of another key is read but those of its row group.
    """
    values = ["event_type", "sector", "job_loss_pct", "job_change_pct", "recovery_months", "peak_month"]
    asked = [F.lit(event_type).alias("event_type"), F.lit(county_id).alias("county_id"), F.lit(state).alias("state")]
    found = lookup(exact, {"county_id": county_id, "event_type": event_type}).select(*values).withColumn("source", F.lit("county"))
    wider = lookup(by_state, {"state": state, "event_type": event_type}).select(*values).withColumn("source", F.lit("state"))
    known = found.agg(F.count(F.lit(1)) > 0).scalar()
    both = found.unionByName(wider.filter(~known))
    request = exact.sparkSession.range(1).select(*asked)
    return request.join(both, "event_type", "left")
