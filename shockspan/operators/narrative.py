"""Texts generated from scenarios, forecasts and rankings, as column work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shockspan.functions import phrases as T
from shockspan.functions.columns import MONTHS, fixed, half_even, type_label
from shockspan.operators.forecast import risk_level
from shockspan.operators.series import KEYS


def say(pattern: str, *parts) -> Column:
    return F.format_string(pattern, *parts)


def whole(col: Column) -> Column:
    return half_even(col, 0).cast("int")


def ordered_text(order: Column, line: Column, separator: str) -> Column:
    """Lines of a group joined in order; groups are one scenario's few sectors."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("s"))))
    return F.array_join(F.transform(rows, lambda r: r["s"]), separator)


def impact_text(scenarios: DataFrame, regions: DataFrame, n: int = 6) -> DataFrame:
    """One narrative per scenario from its n largest sectors."""
    loss, gain = F.col("job_loss_pct"), F.col("job_change_pct")
    parts = [whole(F.abs(f"window_{i}_pct")) for i in (1, 2, 3)]
    line = F.when(loss.isNotNull(), say(T.IMPACT_LOSS, "sector", loss.cast("int"), *parts)).otherwise(
        say(T.IMPACT_GAIN, "sector", gain.cast("int"), "peak_month")
    )
    texts = scenarios.filter(F.col("sector_rank") <= n).groupBy("event_type", "county_id").agg(
        ordered_text(F.col("sector_rank"), line, " ").alias("body")
    )
    opening = say(T.IMPACT_OPENING, F.replace("event_type", F.lit("_"), F.lit(" ")), "region", "county_id")
    return texts.join(regions, "county_id").select(
        F.concat_ws("_", "event_type", "county_id").alias("id"), "event_type", "county_id", "region",
        F.concat(opening, "body").alias("text"),
    )


def prediction_text(rows: DataFrame, keys: list[str], region: Column, summary: Column, order: Column) -> DataFrame:
    """The prediction block of a scenario or roll-up, one line per sector."""
    loss, gain = F.col("job_loss_pct"), F.col("job_change_pct")
    unknown = F.lit("?")
    line = F.when(
        loss.isNotNull(),
        say(T.PREDICTION_LOSS, "sector", plain_number(loss), F.coalesce(F.col("recovery_months").cast("int").cast("string"), unknown)),
    ).otherwise(say(T.PREDICTION_GAIN, "sector", plain_number(gain), F.coalesce(F.col("peak_month").cast("string"), unknown)))
    title = say(T.PREDICTION_TITLE, type_label(F.col("event_type")), region)
    lines = rows.select(*keys, title.alias("_title"), summary.alias("_summary"), order.alias("_order"), line.alias("_line"))
    return lines.groupBy(*keys).agg(
        F.concat_ws(
            "\n", F.min("_title"), say(T.PREDICTION_SUMMARY, F.min("_summary")), F.lit(T.PREDICTION_HEADING),
            ordered_text(F.col("_order"), F.col("_line"), "\n"),
        ).alias("prediction_text")
    )


def state_prediction_text(rollup: DataFrame) -> DataFrame:
    """Prediction block per state and type from the state's roll-up."""
    summary = say(T.STATE_SUMMARY, type_label(F.col("event_type")), "n_counties", "state")
    region = say(T.STATE_REGION, "state", "n_counties")
    return prediction_text(rollup, ["state", "event_type"], region, summary, F.col("sector"))


def plain_number(col: Column) -> Column:
    """Shortest decimal form of a rounded number."""
    return col.cast("double").cast("string")


def year_span(first: Column, last: Column) -> Column:
    return say("%d–%d", F.year(first), F.year(last))


def risk_window(peaks: Column) -> Column:
    """First to last peak month by calendar; a single month stands alone."""
    names = F.array(*[F.lit(m) for m in MONTHS])
    placed = F.array_sort(F.transform(peaks, lambda m: F.array_position(names, m)))
    name = lambda i: F.element_at(names, F.element_at(placed, i).cast("int"))
    return (
        F.when(F.size(peaks) == 0, F.lit(T.NO_WINDOW)).when(F.size(peaks) == 1, name(1)).otherwise(say("%s–%s", name(1), name(-1)))
    )


def circular_window(peaks: Column) -> Column:
    """The shortest span of the calendar circle that holds all peak months."""
    names = F.array(*[F.lit(m) for m in MONTHS])
    placed = F.array_sort(F.transform(peaks, lambda m: F.array_position(names, m).cast("int")))
    spans = F.transform(
        placed,
        lambda start: F.struct(
            F.array_max(F.transform(placed, lambda m: F.pmod(m - start, F.lit(12)))).alias("length"), start.alias("start")
        ),
    )
    best = F.array_min(spans)
    last = F.pmod(best["start"] + best["length"] - 1, F.lit(12)) + 1
    return F.when(F.size(peaks) == 0, F.lit(T.NO_WINDOW)).otherwise(
        F.when(best["length"] == 0, F.element_at(names, best["start"])).otherwise(
            say("%s–%s", F.element_at(names, best["start"]), F.element_at(names, last))
        )
    )


def season_sentence(peaks: Column) -> Column:
    """Peak months as one clause: a, a and b, or a, b, and c."""
    a, b, c = (F.get(peaks, i) for i in range(3))
    listed = F.when(F.size(peaks) == 1, a).when(F.size(peaks) == 2, say("%s and %s", a, b)).otherwise(say("%s, %s, and %s", a, b, c))
    return F.when(F.size(peaks) == 0, F.lit(T.NO_SEASON)).otherwise(say(T.SEASON, listed))


def forecast_text(history: DataFrame, forecast: DataFrame, table: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The forecast block per series: record, season, outlook, worst month, accuracy."""
    spans = history.groupBy(*keys).agg(F.min("month").alias("first"), F.max("month").alias("last"), F.count(F.lit(1)).alias("months"))
    lead = F.min(F.struct((-F.col("predicted")).alias("neg"), "month", "upper"))
    ahead = forecast.groupBy(*keys).agg(
        F.min("month").alias("fc_first"), F.max("month").alias("fc_last"),
        F.min(F.when(F.col("step") < 12, F.struct((-F.col("predicted")).alias("neg"), "month", "upper"))).alias("top"),
    )
    rows = table.join(spans, keys).join(ahead, keys)
    peaks, state = F.col("peak_months"), F.col("state")
    record = year_span(F.col("first"), F.col("last"))
    label = type_label(F.lower("event_type"))
    text = F.concat_ws(
        "\n",
        say(T.FORECAST_TITLE, label, state),
        say(T.FORECAST_HISTORY, "total_historical", state, record, (F.col("months") / 12).cast("int")),
        F.when(F.size(peaks) > 0, say(T.FORECAST_PEAKS, F.array_join(peaks, ", "))),
        F.when(F.size(peaks) >= 2, say(T.FORECAST_WINDOW, say("%s–%s", F.element_at(peaks, 1), F.element_at(peaks, -1)))),
        say(T.FORECAST_AHEAD, year_span(F.col("fc_first"), F.col("fc_last")), fixed(F.col("avg_next_12"), 1)),
        say(T.FORECAST_TOP, F.date_format("top.month", "yyyy-MM"), fixed(-F.col("top.neg"), 1), fixed(F.col("top.upper"), 1)),
        F.when(F.col("cv_mae").isNotNull(), say(T.FORECAST_ACCURACY, fixed(F.col("cv_mae"), 2), record)),
    )
    return rows.select(*keys, text.alias("forecast_text"))


def lookup_phrase(event_type: Column, words: dict[str, str], default: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    return F.coalesce(F.try_element_at(table, event_type), default)


def seasonal_text(history: DataFrame, forecast: DataFrame, table: DataFrame, split: DataFrame, keys: list[str] = KEYS,
                  state_names: dict[str, str] | None = None) -> DataFrame:
    """Self-contained seasonal narrative per series."""
    active = F.avg(F.when(F.col("n") > 0, F.col("n")))
    past = history.groupBy(*keys).agg(
        F.min("month").alias("first"), F.max("month").alias("last"), F.coalesce(active, F.lit(0.0)).alias("active")
    )
    end = forecast.groupBy(*keys).agg(F.max("month").alias("end"))
    rows = table.join(past, keys).join(end, keys).join(split, keys)
    peaks = F.col("peak_months")
    state = lookup_phrase(F.col("state"), state_names, F.col("state")) if state_names else F.col("state")
    low = F.lower("event_type")
    industries = lookup_phrase(F.replace(low, F.lit(" "), F.lit("_")), T.INDUSTRIES, F.lit(T.INDUSTRIES_DEFAULT))
    window = risk_window(peaks)
    text = F.concat_ws(
        "\n\n",
        say(T.PROFILE_TITLE, state, "event_type"),
        say(T.PROFILE_PAST, state, F.format_number("total_historical", 0), low, year_span(F.col("first"), F.col("last")),
            whole(F.col("train_months") / 12), fixed(F.col("active"), 1), season_sentence(peaks), window),
        F.concat_ws(
            "\n",
            say(T.PROFILE_FORECAST_HEADING, fixed(F.col("cv_mae"), 2)),
            say(T.PROFILE_FORECAST, low, state, F.date_format("end", "MMMM yyyy"), F.array_join(peaks, ", "),
                fixed(F.col("avg_peak"), 1), fixed(F.col("avg_off"), 1)),
        ),
        F.concat_ws("\n", F.lit(T.PROFILE_WORKFORCE_HEADING), say(T.PROFILE_WORKFORCE, low, state, industries, state, window)),
        F.lit(T.PROFILE_NOTE),
    )
    return rows.select(F.concat_ws("_", F.lit("forecast"), "state", F.replace("event_type", F.lit(" "), F.lit("_"))).alias("id"), *keys, text.alias("text"))


def comparison_text(fit: DataFrame, best: DataFrame, scores: DataFrame, directions: DataFrame, outlook: DataFrame, totals: DataFrame,
                    baseline: str, keys: list[str] = KEYS) -> DataFrame:
    """Model-comparison profile per series: season by month and a 12-month outlook.

    ``fit`` carries the season array of the training months, ``outlook`` the next 12
    months of the winning model, ``totals`` the total and the first and last month.
    """
    names = F.array(*[F.lit(m) for m in MONTHS])
    month_at = lambda i: ((F.month("first") - 1 + i) % 12 + 1).cast("int")  # noqa: E731  of a season's place
    base = scores.filter(F.col("model") == baseline).select(*keys, F.col("mae").alias("base_mae"))
    ahead = outlook.filter(F.col("step") < 12).groupBy(*keys).agg(
        ordered_text(F.col("step"), say("%s=%s", F.date_format("month", "MMM yyyy"), fixed(F.col("predicted"), 1)), ", ").alias("outlook")
    )
    rows = fit.select(*keys, "season").join(best, keys).join(base, keys).join(directions.select(*keys, "direction"), keys)
    rows = rows.join(ahead, keys).join(totals, keys)
    years = F.floor(F.months_between("last", "first") / 12).cast("int")
    top = F.slice(F.array_sort(F.transform("season", lambda x, i: F.struct((-x).alias("neg"), (-i).alias("i")))), 1, 3)
    months = F.transform(
        "season", lambda x, i: say(T.COMPARISON_MONTH, F.element_at(names, month_at(i)), risk_word(x), fixed(x, 2))
    )
    label = F.replace("event_type", F.lit("_"), F.lit(" "))
    text = F.concat_ws(
        "\n\n",
        F.concat_ws(
            "\n",
            say(T.COMPARISON_TITLE, "state", label, year_span(F.col("first"), F.col("last"))),
            say(T.COMPARISON_KEYS, "state", label),
            say(T.COMPARISON_TOTAL, "total", years, fixed(F.col("total") / years, 1), "direction"),
            say(T.COMPARISON_PEAKS, F.array_join(F.transform(top, lambda p: F.element_at(names, month_at(-p["i"]))), ", ")),
        ),
        F.concat_ws("\n", F.lit(T.COMPARISON_PATTERN), F.array_join(months, "\n")),
        F.concat_ws(
            "\n",
            say(T.COMPARISON_OUTLOOK, F.concat(F.upper(F.substring("best_model", 1, 1)), F.expr("substring(best_model, 2)")),
                fixed(F.col("best_mae"), 2), fixed(F.col("base_mae"), 2)),
            F.col("outlook"),
        ),
        F.lit(T.COMPARISON_NOTE),
    )
    return rows.select(*keys, text.alias("text"))


def risk_word(value: Column) -> Column:
    level = risk_level(value)
    return F.when(level == "high", "HIGH").otherwise(level)


def numbered(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """Number the rows of a finished ranking in one task.

    Such a ranking is a top-k, or has a row per sector (for surges per sector and event
    type), so its size is bounded by the dimensions and not by the facts.
    """
    return df.withColumn("_i", F.row_number().over(W.orderBy(*order)))


def joined(df: DataFrame, line: Column, *head: Column | str) -> DataFrame:
    top = [F.lit(h) if isinstance(h, str) else h for h in head]
    body = df.select("_i", line.alias("_line")).agg(ordered_text(F.col("_i"), F.col("_line"), "\n").alias("body"))
    return body.filter(F.col("body") != "").select(F.concat_ws("\n", *top, F.lit(""), "body").alias("text"))


def sector_ranking_text(ranking: DataFrame, scope: str = "") -> DataFrame:
    """``scope`` is ' — state type' when both are given."""
    order = [F.desc("pct"), "sector"]
    known = F.col("months") > 0
    loss = numbered(ranking.filter(F.col("kind") == "loss"), order).select(
        F.lit(0).alias("part"), "_i",
        say(T.RANKING_LOSS, "_i", "sector", fixed(F.col("pct"), 0), F.when(known, say("%s months", fixed(F.col("months"), 0))).otherwise("unknown")).alias("line"),
    )
    surge = numbered(ranking.filter(F.col("kind") == "surge"), order).select(
        F.lit(1).alias("part"), "_i",
        say(T.RANKING_SURGE, "_i", "sector", fixed(F.col("pct"), 0), F.when(known, say("month %s", fixed(F.col("months"), 0))).otherwise("unknown timing")).alias("line"),
    )
    parts = loss.unionByName(surge).groupBy("part").agg(ordered_text(F.col("_i"), F.col("line"), "\n").alias("body"))
    heading = F.when(F.col("part") == 0, T.RANKING_LOSS_HEADING).otherwise(T.RANKING_SURGE_HEADING)
    blocks = parts.agg(ordered_text(F.col("part"), F.concat_ws("\n", heading, "body"), "\n\n").alias("body"))
    return blocks.filter(F.col("body") != "").select(F.concat(F.lit(T.RANKING_TITLE % scope), F.lit("\n\n"), "body").alias("text"))


def top_risk_text(rows: DataFrame, limit: int = 10) -> DataFrame:
    ranked = numbered(rows, [F.desc("risk_score"), "state", "sector", "event_type"])
    n = plain_number
    line = F.concat_ws(
        "\n",
        say(T.RISK_LINE, "_i", "state", "sector", type_label(F.col("event_type"))),
        say(T.RISK_DETAIL, n(F.col("avg_loss_pct")), n(F.col("avg_recovery")), n(F.col("freq_per_month")), n(F.col("risk_score"))),
    )
    return joined(ranked, line, T.RISK_TITLE % limit, T.RISK_SUBTITLE)


def portfolio_text(rows: DataFrame, states: DataFrame, event_type: str) -> DataFrame:
    """``states`` is the short list of the portfolio's states."""
    n = plain_number
    listed = states.select(F.array_sort(F.collect_set("state"))).scalar()
    ranked = numbered(rows, [F.desc("avg_loss"), "sector"])
    line = say(T.PORTFOLIO_LINE, "sector", n(F.col("avg_loss")), n(F.col("worst_loss")), n(F.col("avg_recovery")), "states_covered", F.size(listed))
    return joined(ranked, line, say(T.PORTFOLIO_TITLE, type_label(F.lit(event_type)), F.array_join(listed, ", ")))


def variance_text(rows: DataFrame) -> DataFrame:
    n = plain_number
    ranked = numbered(rows, [F.desc("range_months"), "sector"])
    line = say(T.VARIANCE_LINE, "_i", "sector", n(F.col("avg_recovery")), n(F.col("range_months")), "band", "n_data_points")
    return joined(ranked, line, T.VARIANCE_TITLE)


def surge_text(rows: DataFrame, event_type: str | None = None) -> DataFrame:
    label = say(" after %s", type_label(F.lit(event_type))) if event_type else F.lit("")
    tail = label if event_type else say(" (%s)", type_label(F.col("event_type")))
    ranked = numbered(rows, [F.desc("avg_surge"), "sector", "event_type"])
    line = say(T.SURGE_LINE, "sector", plain_number(F.col("avg_surge")), tail, fixed(F.col("avg_peak"), 0), "n_states")
    return joined(ranked, line, say(T.SURGE_TITLE, label))


def preposition_text(rows: DataFrame, limit: int = 10) -> DataFrame:
    n = plain_number
    ranked = numbered(rows, [F.desc("priority_score"), "state", "event_type"])
    peaks = F.when(F.col("peaks") != "", F.concat(F.lit(", peak: "), "peaks")).otherwise("")
    line = F.concat_ws(
        "\n",
        say(T.PREPOSITION_LINE, "_i", "state", type_label(F.col("event_type")), peaks),
        say(T.PREPOSITION_DETAIL, n(F.col("freq")), n(F.col("avg_loss")), n(F.col("priority_score"))),
    )
    return joined(ranked, line, T.PREPOSITION_TITLE % limit, T.PREPOSITION_SUBTITLE)
