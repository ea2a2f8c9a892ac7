"""Chart and table shapes derived from scenarios, series and forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shockspan.functions.columns import first_match
from shockspan.operators.series import KEYS

# Months of the displacement curve.
CURVE_MONTHS = [-6, -3, 0, 1, 2, 3, 4, 5, 6, 9, 12, 15, 18]

# Alternative sectors per industry keyword, and the default.
PIVOTS = {
    "Hospitality": ["Food Delivery", "Catering", "Property Mgmt"],
    "Retail": ["Warehousing", "E-commerce", "Logistics"],
    "Construction": ["Debris Removal", "FEMA Contracting", "Infrastructure"],
    "Healthcare": ["Telehealth", "Crisis Response", "Home Care"],
    "Manufacturing": ["Supply Chain", "Gov Contracts", "Repair Services"],
    "Transportation": ["Emergency Logistics", "Last-Mile Delivery", "Trucking"],
    "Education": ["Online Tutoring", "Workforce Training", "EdTech"],
    "Agriculture": ["Food Bank Supply", "Processing", "Gov Relief Programs"],
    "Finance": ["Insurance Claims", "Disaster Loans", "Relief Admin"],
    "Government": ["Emergency Mgmt", "FEMA Support", "Public Works"],
}
DEFAULT_PIVOTS = ["Retraining Programs", "Federal Aid", "Adjacent Sectors"]


def displacement_curve(scenarios: DataFrame, sectors: list[str] | None = None) -> DataFrame:
    """Thirteen month points per sector: linear recovery, or ramp and decay.

    Long rows; with ``sectors`` given, one column per sector as a chart wants it.
    """
    m = F.col("month")
    loss, gain = F.col("job_loss_pct"), F.col("job_change_pct")
    rec = F.coalesce("recovery_months", F.lit(12.0))
    peak = F.coalesce("peak_month", F.lit(3)).cast("double")
    end = peak * 2 + 6
    falling = F.when(m == 0, -loss).when(m >= rec, 0.0).otherwise(F.round(-loss * (1 - m / rec), 1))
    rising = (
        F.when(m <= peak, F.round(gain * (m / peak), 1))
        .when(m >= end, 0.0)
        .otherwise(F.round(gain * (1 - (m - peak) / (end - peak)), 1))
    )
    value = F.when(m < 0, 0.0).when(loss.isNotNull(), falling).when(gain.isNotNull(), rising).otherwise(0.0)
    rows = scenarios.withColumn("month", F.explode(F.array(*[F.lit(x) for x in CURVE_MONTHS])))
    rows = rows.select("event_type", "county_id", "sector", "month", value.alias("value"))
    if sectors is None:
        return rows
    return rows.groupBy("event_type", "county_id", "month").pivot("sector", sectors).agg(F.first("value"))


def risk_band(scenarios: DataFrame) -> DataFrame:
    loss = F.coalesce("job_loss_pct", F.lit(0.0))
    label = (
        F.when(F.col("recovery_months") > 0, F.format_string("~%d months", F.col("recovery_months").cast("int")))
        .when(F.col("peak_month") > 0, F.format_string("Peaks month %d", "peak_month"))
        .otherwise("Unknown")
    )
    return scenarios.select(
        "event_type", "county_id", "sector",
        loss.alias("job_loss_pct"),
        F.coalesce("job_change_pct", F.lit(0.0)).alias("demand_increase_pct"),
        F.when(loss > 25, "High").when(loss > 10, "Medium").otherwise("Low").alias("risk_score"),
        label.alias("recovery_time"),
    )


def pivot_columns(industry: Column, rules: dict[str, list[str]] = PIVOTS, default: list[str] = DEFAULT_PIVOTS) -> Column:
    """Alternatives of the first keyword that the industry contains."""
    as_array = lambda words: F.array(*[F.lit(w) for w in words])
    return first_match(
        [(F.contains(F.lower(industry), F.lit(k.lower())), as_array(v)) for k, v in rules.items()], as_array(default)
    )


def pivot_suggestions(df: DataFrame, column: str = "sector", rules: dict[str, list[str]] = PIVOTS) -> DataFrame:
    """Long rows, one per suggestion."""
    return df.select("*", F.posexplode(pivot_columns(F.col(column), rules)).alias("position", "suggestion"))


def ranked_sectors(scenarios: DataFrame, n: int = 5) -> DataFrame:
    """The n largest sectors per scenario, with the largest loss and surge marked."""
    loss, gain = F.coalesce("job_loss_pct", F.lit(0.0)), F.coalesce("job_change_pct", F.lit(0.0))
    whole = W.partitionBy("event_type", "county_id")
    rank = lambda c: F.row_number().over(whole.orderBy(F.desc(c), "sector"))
    size = F.greatest(loss, gain)
    rows = scenarios.select(
        "event_type", "county_id", "sector", size.alias("magnitude"),
        rank(size).alias("rank"),
        ((rank(loss) == 1) & (loss > 0)).alias("biggest_loss"),
        ((rank(gain) == 1) & (gain > 0)).alias("biggest_surge"),
    )
    return rows.filter(F.col("rank") <= n)


def chart_series(history: DataFrame, forecast: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """History, a bridge at the last actual month, then the forecast with its band."""
    none = F.lit(None).cast("double")
    past = history.select(*keys, "month", F.lit(0).alias("part"), F.col("n").cast("double").alias("historical"),
                          none.alias("forecast"), none.alias("lower"), none.alias("upper"))
    last = history.groupBy(*keys).agg(F.max(F.struct("month", "n")).alias("l"))
    level = F.col("l.n").cast("double")
    bridge = last.select(*keys, F.col("l.month").alias("month"), F.lit(1).alias("part"), level.alias("historical"),
                         level.alias("forecast"), level.alias("lower"), level.alias("upper"))
    ahead = forecast.select(*keys, "month", F.lit(2).alias("part"), none.alias("historical"),
                            *[F.round(c, 2).alias(n) for c, n in (("predicted", "forecast"), ("lower", "lower"), ("upper", "upper"))])
    return past.unionByName(bridge).unionByName(ahead)


def chart_meta(history: DataFrame, forecast: DataFrame, table: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    spans = history.groupBy(*keys).agg(F.min("month").alias("data_start"), F.max("month").alias("data_end"))
    ahead = forecast.groupBy(*keys).agg(
        F.min("month").alias("forecast_start"), F.max("month").alias("forecast_end"), F.count(F.lit(1)).alias("horizon")
    )
    return spans.join(ahead, keys).join(table.select(*keys, "total_historical", "cv_mae", "cv_rmse", "train_months"), keys)


def slider_table(history: DataFrame, forecast: DataFrame) -> DataFrame:
    """Type and month -> map of state to its count; forecasts override history."""
    past = history.select("event_type", "month", "state", F.col("n").cast("double").alias("count"), F.lit(0).alias("order"))
    ahead = forecast.select("event_type", "month", "state", F.col("predicted").alias("count"), F.lit(1).alias("order"))
    latest = past.unionByName(ahead).groupBy("event_type", "month", "state").agg(F.max(F.struct("order", "count")).alias("v"))
    kind = F.when(F.col("v.order") == 1, "forecast").otherwise("historical")
    entry = F.struct("state", F.struct(F.col("v.count").alias("count"), kind.alias("kind")).alias("value"))
    return latest.groupBy("event_type", "month").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("states"))


def log_floor(df: DataFrame, columns: list[str], low: float = 0.1) -> DataFrame:
    """Lift small values so that a log scale can show them; missing stays missing."""
    lifted = {c: F.when(F.col(c).isNotNull(), F.greatest(F.col(c), F.lit(low))) for c in columns}
    return df.withColumns(lifted)


def map_extent(points: DataFrame, lat: str = "lat", lng: str = "lng", severity: str = "severity") -> DataFrame:
    """Bounding box and count of points per severity class, and over all of them."""
    shown = F.when(F.col(severity) == "major", "major").otherwise("other")
    box = [F.min(lat).alias("south"), F.max(lat).alias("north"), F.min(lng).alias("west"), F.max(lng).alias("east"),
           F.count(F.lit(1)).alias("n")]
    per = points.groupBy(shown.alias("severity_class")).agg(*box)
    everything = per.agg(F.min("south").alias("south"), F.max("north").alias("north"), F.min("west").alias("west"),
                         F.max("east").alias("east"), F.sum("n").alias("n"))
    return per.unionByName(everything.withColumn("severity_class", F.lit("all")))
