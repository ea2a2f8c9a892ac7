"""Deterministic forecasts of monthly count series, as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shockspan.functions.columns import half_even, month_name
from shockspan.operators.series import KEYS, month_means, top_months, trend_test

SEASON = 12
Z95 = 1.96
DIRECTION = 0.01  # slope per month that counts as a trend


def training(series: DataFrame, holdout: int = 12) -> DataFrame:
    """The series without its last months."""
    return series.withColumn("months", F.col("months") - holdout).filter(F.col("t") < F.col("months"))


def holdout_rows(series: DataFrame, holdout: int = 12) -> DataFrame:
    return series.filter(F.col("t") >= F.col("months") - holdout)


def linear_trend(series: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return series.groupBy(*keys).agg(
        F.round(F.regr_slope("n", "t"), 6).alias("slope"), F.round(F.regr_intercept("n", "t"), 6).alias("intercept")
    )


def trend_fit(series: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One row per series: line, seasonal index array, mean and residual deviation."""
    y, t, months = F.col("n"), F.col("t"), F.col("months")
    whole = t < F.floor(months / SEASON) * SEASON
    by_position = F.array(*[F.avg(F.when(whole & (t % SEASON == p), y)) for p in range(SEASON)])
    spread = (F.regr_syy(y, t) - F.regr_sxy(y, t) * F.regr_sxy(y, t) / F.regr_sxx(y, t)) / F.count(y)
    fit = series.groupBy(*keys).agg(
        F.max(months).alias("months"),
        F.max("month").alias("last_month"),
        F.avg(y).alias("mean"),
        F.when(F.count(y) >= 3, F.regr_slope(y, t)).otherwise(0.0).alias("slope"),
        F.when(F.count(y) >= 3, F.regr_intercept(y, t)).otherwise(F.avg(y)).alias("intercept"),
        F.when(F.count(y) >= 2 * SEASON, F.sqrt(F.greatest(F.lit(0.0), spread))).otherwise(0.0).alias("sigma"),
        by_position.alias("position_mean"),
        F.avg(F.when(whole, y)).alias("whole_mean"),
    )
    usable = (F.col("months") >= 2 * SEASON) & (F.col("whole_mean") > 0)
    ones = F.array_repeat(F.lit(1.0), SEASON)
    season = F.when(usable, F.transform("position_mean", lambda x: x / F.col("whole_mean"))).otherwise(ones)
    return fit.withColumn("season", season).drop("position_mean", "whole_mean")


def seasonal_index(series: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return trend_fit(series, keys).select(*keys, F.posexplode("season").alias("position", "idx")).select(
        *keys, "position", F.round("idx", 6).alias("seasonal_index")
    )


def trend_value(step: Column) -> Column:
    """Trend times season; 0 where the line is not positive; the mean of short series."""
    at = F.col("months") + step
    line = F.col("slope") * at + F.col("intercept")
    value = F.when(line > 0, line * F.get(F.col("season"), (at % SEASON).cast("int"))).otherwise(F.lit(0.0))
    return F.when(F.col("months") < 2 * SEASON, F.col("mean")).otherwise(F.greatest(F.lit(0.0), value))


def trend_seasonal_forecast(series: DataFrame, horizon: int = 72, keys: list[str] = KEYS) -> DataFrame:
    """Line times seasonal index with a 95 % band from the residuals' deviation."""
    return with_band(
        trend_fit(series, keys).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1)))).select(
            *keys,
            F.col("step"),
            F.add_months("last_month", F.col("step") + 1).alias("month"),
            trend_value(F.col("step")).alias("value"),
            "sigma",
        )
    ).drop("sigma")


def with_band(df: DataFrame) -> DataFrame:
    half = Z95 * F.col("sigma")
    return df.select(
        *[c for c in df.columns if c != "value"],
        F.round("value", 6).alias("predicted"),
        F.round(F.greatest(F.lit(0.0), F.col("value") - half), 6).alias("lower"),
        F.round(F.col("value") + half, 6).alias("upper"),
    )


def trend_direction(series: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    slope = F.regr_slope("n", "t")
    label = F.when(slope > DIRECTION, "increasing").when(slope < -DIRECTION, "decreasing").otherwise("stable")
    return series.groupBy(*keys).agg(F.round(slope, 4).alias("slope"), label.alias("direction"))


def direction_counts(directions: DataFrame) -> DataFrame:
    return directions.groupBy("direction").agg(F.count(F.lit(1)).alias("n"))


def smoothed_level(alpha: float) -> Column:
    """Last level of simple smoothing, as the weighted sum it unfolds to."""
    keep = 1 - alpha
    return F.sum(F.col("n") * alpha * F.pow(F.lit(keep), F.col("months") - 1 - F.col("t"))) + F.sum(
        F.when(F.col("t") == 0, F.col("n") * F.pow(F.lit(keep), F.col("months")))
    )


def exp_smoothing(series: DataFrame, alpha: float = 0.3, horizon: int = 72, keys: list[str] = KEYS) -> DataFrame:
    """Flat forecast at the last smoothed level."""
    level = series.groupBy(*keys).agg(F.round(smoothed_level(alpha), 6).alias("predicted"), F.max("month").alias("last"))
    steps = F.explode(F.sequence(F.lit(0), F.lit(horizon - 1)))
    return level.withColumn("step", steps).select(
        *keys, "step", F.add_months("last", F.col("step") + 1).alias("month"), "predicted"
    )


def seasonal_mean_forecast(series: DataFrame, horizon: int = 12, keys: list[str] = KEYS) -> DataFrame:
    """Mean of the month, moved by the yearly slope where that is significant.

    Series shorter than a year are left out. The month's mean and sample deviation
    are taken to two places first; the band is open above for months seen only once.
    """
    year, y = F.month("month"), F.col("n")
    fit = series.groupBy(*keys).agg(
        F.max("month").alias("last"),
        F.transform(month_means(), lambda x: half_even(x, 2)).alias("means"),
        F.array(*[half_even(F.stddev_samp(F.when(year == m, y)), 2) for m in range(1, 13)]).alias("devs"),
        F.count(y).alias("n_months"),
    ).filter(F.col("n_months") >= SEASON)
    trend = trend_test(series, keys, "month", F.col("n"), least=3).select(*keys, "slope", "trend")
    rows = fit.join(trend, keys).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    at = F.add_months("last", F.col("step"))
    moved = F.when(F.col("trend").isin("increasing", "decreasing"), half_even(F.col("slope"), 2) * F.col("step") / 12).otherwise(0.0)
    rows = rows.select(
        *keys, "step", at.alias("month"), "trend",
        (F.get("means", F.month(at) - 1) + moved).alias("value"),
        F.get("devs", F.month(at) - 1).alias("dev"),
    )
    half = Z95 * F.col("dev")
    return rows.select(
        *keys, "step", "month", "trend",
        F.round("value", 6).alias("predicted"),
        F.round(F.coalesce(F.greatest(F.lit(0.0), F.col("value") - half), F.lit(0.0)), 6).alias("lower"),
        F.round(F.col("value") + half, 6).alias("upper"),
    )


def score(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean absolute and root mean squared error of ``predicted`` against ``n``."""
    gap = F.col("n") - F.col("predicted")
    return rows.groupBy(*keys).agg(
        F.round(F.avg(F.abs(gap)), 3).alias("mae"), F.round(F.sqrt(F.avg(gap * gap)), 3).alias("rmse")
    )


def holdout_score(series: DataFrame, holdout: int = 12, keys: list[str] = KEYS) -> DataFrame:
    """Train on all but the last months, then score those."""
    fit = trend_fit(training(series, holdout), keys)
    tests = holdout_rows(series, holdout).select(*keys, "t", "n")
    rows = tests.join(fit, keys).withColumn("predicted", trend_value(F.col("t") - F.col("months")))
    return score(rows, keys)


def model_scores(series: DataFrame, holdout: int = 12, alpha: float = 0.3, keys: list[str] = KEYS) -> DataFrame:
    """Hold-out errors of the three closed-form models, one row per series and model."""
    train = training(series, holdout)
    fit = trend_fit(train, keys).drop("mean")
    level = train.groupBy(*keys).agg(smoothed_level(alpha).alias("level"), month_means().alias("means"))
    rows = holdout_rows(series, holdout).select(*keys, "t", "month", "n").join(fit, keys).join(level, keys)
    rows = rows.withColumn("mean", F.lit(None).cast("double"))
    models = F.explode(
        F.array(
            F.struct(F.lit("trend_seasonal").alias("model"), F.lit(0).alias("priority"), trend_value(F.col("t") - F.col("months")).alias("predicted")),
            F.struct(F.lit("smoothing").alias("model"), F.lit(1).alias("priority"), F.col("level").alias("predicted")),
            F.struct(F.lit("seasonal_mean").alias("model"), F.lit(2).alias("priority"), F.get("means", F.month("month") - 1).alias("predicted")),
        )
    )
    return score(rows.select(*keys, "n", models.alias("m")).select(*keys, "n", "m.*"), [*keys, "model", "priority"])


def best_model(scores: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Model with the smallest error per series; ties go to the fixed priority."""
    lead = F.min(F.struct("mae", "priority", "model"))
    return scores.filter(F.col("mae").isNotNull()).groupBy(*keys).agg(lead.alias("lead")).select(
        *keys, F.col("lead.model").alias("best_model"), F.col("lead.mae").alias("best_mae")
    )


def model_forecasts(series: DataFrame, horizon: int = 12, alpha: float = 0.3, keys: list[str] = KEYS) -> DataFrame:
    """The next months by each of the three closed-form models, fitted to the whole series."""
    steps = F.explode(F.sequence(F.lit(0), F.lit(horizon - 1)))
    fit = trend_fit(series, keys)
    level = series.groupBy(*keys).agg(smoothed_level(alpha).alias("level"), month_means().alias("means"))
    rows = fit.join(level, keys).withColumn("step", steps).withColumn("month", F.add_months("last_month", F.col("step") + 1))
    models = F.explode(
        F.create_map(
            F.lit("trend_seasonal"), trend_value(F.col("step")),
            F.lit("smoothing"), F.col("level"),
            F.lit("seasonal_mean"), F.get("means", F.month("month") - 1),
        )
    )
    return rows.select(*keys, "step", "month", models.alias("model", "value")).select(
        *keys, "model", "step", "month", F.round("value", 6).alias("predicted")
    )


def winning_forecast(series: DataFrame, best: DataFrame, horizon: int = 12, keys: list[str] = KEYS) -> DataFrame:
    """The next months by the model that won the series' hold-out."""
    own = best.select(*keys, F.col("best_model").alias("model"))
    return model_forecasts(series, horizon, keys=keys).join(own, [*keys, "model"]).select(*keys, "model", "step", "month", "predicted")


def zero_holdouts(series: DataFrame, holdout: int = 12, keys: list[str] = KEYS) -> DataFrame:
    return holdout_rows(series, holdout).groupBy(*keys).agg((F.sum("n") == 0).cast("int").alias("test_zeros"))


def leaderboard(scores: DataFrame, best: DataFrame, zeros: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Mean error and wins per model over series whose hold-out is not all zero."""
    live = zeros.filter(F.col("test_zeros") == 0).select(*keys)
    rows = scores.join(live, keys).join(best.select(*keys, "best_model"), keys)
    won = F.count_if(F.col("model") == F.col("best_model"))
    return rows.groupBy("model").agg(
        F.round(F.avg("mae"), 6).alias("mean_mae"),
        F.count(F.lit(1)).alias("n_series"),
        won.alias("wins"),
        F.round(won * 100.0 / F.count(F.lit(1)), 6).alias("win_pct"),
    )


def best_worst_combo(scores: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    low = F.min(F.struct("mae", *keys))
    high = F.max(F.struct("mae", *keys))
    ends = F.explode(
        F.array(F.struct(F.lit("best").alias("kind"), low.alias("r")), F.struct(F.lit("worst").alias("kind"), high.alias("r")))
    )
    return scores.agg(ends.alias("e")).select("e.kind", "e.r.*")


def annual_forecast(forecast: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return forecast.filter(F.col("step") < 12).groupBy(*keys).agg(
        F.round(F.avg("predicted") * 12, 6).alias("annual_forecast")
    )


def next12_peak(forecast: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Mean of the first 12 months and the earliest month with the largest value."""
    lead = F.min(F.struct((-F.col("predicted")).alias("neg"), "month", "upper"))
    return (
        forecast.filter(F.col("step") < 12)
        .groupBy(*keys)
        .agg(F.round(F.avg("predicted"), 3).alias("avg_next_12"), lead.alias("lead"))
        .select(
            *keys, "avg_next_12",
            F.col("lead.month").alias("peak_month"),
            (-F.col("lead.neg")).alias("peak_predicted"),
            F.col("lead.upper").alias("peak_upper"),
        )
    )


def risk_level(value: Column) -> Column:
    return F.when(value >= 2.0, "high").when(value >= 1.0, "moderate").when(value >= 0.5, "low").otherwise("minimal")


def month_risk_profile(series: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Risk level of each month of the year from its mean count."""
    return (
        series.groupBy(*keys, F.month("month").alias("month"))
        .agg(half_even(F.avg("n"), 2).alias("avg_count"))
        .select(*keys, "month", month_name(F.col("month")).alias("month_name"), "avg_count", risk_level(F.col("avg_count")).alias("risk_level"))
    )


def season_split(series: DataFrame, forecast: DataFrame, n: int = 3, keys: list[str] = KEYS) -> DataFrame:
    """Mean forecast in the peak months of the past and in the other months."""
    peaks = series.groupBy(*keys).agg(month_means().alias("m")).select(*keys, top_months(F.col("m"), n).alias("peaks"))
    rows = forecast.join(peaks, keys)
    inside = F.array_contains("peaks", month_name(F.month("month")))
    return rows.groupBy(*keys).agg(
        F.round(F.coalesce(F.avg(F.when(inside, F.col("predicted"))), F.lit(0.0)), 4).alias("avg_peak"),
        F.round(F.coalesce(F.avg(F.when(~inside, F.col("predicted"))), F.lit(0.0)), 4).alias("avg_off"),
    )


def forecast_table(series: DataFrame, horizon: int = 72, holdout: int = 12, keys: list[str] = KEYS) -> DataFrame:
    """The serving table: total, peak months, mean of the next year, hold-out error."""
    past = series.groupBy(*keys).agg(
        F.sum("n").alias("total_historical"), month_means().alias("m"), F.max("months").alias("train_months")
    )
    ahead = trend_seasonal_forecast(series, 12, keys).groupBy(*keys).agg(F.round(F.avg("predicted"), 3).alias("avg_next_12"))
    errors = holdout_score(series, holdout, keys).select(*keys, F.col("mae").alias("cv_mae"), F.col("rmse").alias("cv_rmse"))
    return (
        past.join(ahead, keys)
        .join(errors, keys)
        .select(
            *keys, "total_historical", top_months(F.col("m")).alias("peak_months"), "avg_next_12", "cv_mae", "cv_rmse",
            "train_months", F.lit(horizon).alias("forecast_horizon"),
        )
    )
