"""Registered queries, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shockspan.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
BODIES: dict[str, tuple[str, tuple[str, ...]]] = {}
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


# Date columns of the registered results. Both sides give them as ISO text, since
# clients turn the engines' date types into different values.
MONTH, BEGIN, SPAN = ("month",), ("begin_on",), ("begin_on", "end_on")
DATES = {
    **dict.fromkeys(
        [
            "monthly_counts", "calendar_fill", "calendar_fill_own_span", "combo_series", "trend_seasonal_forecast", "exp_smoothing",
            "seasonal_mean_forecast", "model_forecasts", "winning_forecast", "chart_series", "slider_table", "log_floor", "write_table",
        ],
        MONTH,
    ),
    **dict.fromkeys(
        [
            "window_impact", "dedup_shocks", "prior_shocks", "decayed_exposure", "exits_by_month_offset", "peak_features",
            "temporal_features", "to_sector_level", "distinct_keys",
        ],
        BEGIN,
    ),
    **dict.fromkeys(
        ["major_only", "overlap_filter", "duration_join", "feature_matrix", "point_lookup", "point_lookup_sorted", "list_limit", "read_declarations"], SPAN
    ),
    **dict.fromkeys(["dataset_summary", "dataset_summary_days"], ("first_time", "last_time")),
    "next12_peak": ("peak_month",),
    "flatten_exits": ("started_on", "ended_on", "end_month"),
    "chart_meta": ("data_start", "data_end", "forecast_start", "forecast_end"),
}


def iso_dates(df: DataFrame) -> DataFrame:
    days = [f.name for f in df.schema if isinstance(f.dataType, T.DateType)]
    return df.withColumns({c: F.col(c).cast("string") for c in days}) if days else df


def iso_dates_sql(name: str, body: str) -> str:
    if name not in DATES:
        return body
    texts = ", ".join(f"strftime({c}, '%Y-%m-%d') AS {c}" for c in DATES[name])
    return f"SELECT * REPLACE ({texts}) FROM ({body})"


def view(name: str, body: str, *needs: str) -> None:
    """Name a checking sub-query; ``needs`` are the views it reads."""
    VIEWS[name] = (needs, body)


def _closure(needs: tuple[str, ...], seen: list[str]) -> list[str]:
    for n in needs:
        if n not in seen:
            _closure(VIEWS[n][0], seen)
            seen.append(n)
    return seen


def check_sql(body: str, *needs: str) -> str:
    names = _closure(needs, [])
    if not names:
        return body
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n][1]})" for n in names)
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None, *needs: str):
    """Register a function of ``Tables`` under a name, with its check."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: iso_dates(fn(Tables(spark, folder)))
        if sql is not None:
            BODIES[name] = (sql, needs)
        return fn

    return wrap


def checks() -> dict[str, str]:
    """The checking SQL of every query that has one, complete with its views."""
    return {name: check_sql(iso_dates_sql(name, body), *needs) for name, (body, needs) in BODIES.items()}
