"""Answers and supporting passages assembled per question."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shockspan.functions import phrases as T
from shockspan.functions.columns import fixed, type_label
from shockspan.operators import narrative as N
from shockspan.operators import serving as V
from shockspan.session import stored


def line_block(rows: DataFrame, keys: list[str], order: Column, line: Column, out: str = "body") -> DataFrame:
    lines = rows.select(*keys, order.alias("_o"), line.alias("_l"))
    return lines.groupBy(*keys).agg(N.ordered_text(F.col("_o"), F.col("_l"), "\n").alias(out))


def sector_ranking_texts(scenarios: DataFrame) -> DataFrame:
    """Ranking text for every asked combination of state and type, either optional.

    Grouping sets give all four kinds of scope in one pass; a null key means "any".
    """
    state, kind = F.col("state"), F.col("event_type")
    rows = scenarios.groupingSets(
        [[kind, state, F.col("sector")], [state, F.col("sector")], [kind, F.col("sector")], [F.col("sector")]],
        kind, state, F.col("sector"),
    ).agg(
        F.avg("job_loss_pct").alias("loss"),
        F.avg(F.when(F.col("job_loss_pct").isNotNull(), F.col("recovery_months"))).alias("recovery"),
        F.avg("job_change_pct").alias("surge"),
        F.avg(F.when(F.col("job_change_pct").isNotNull(), F.col("peak_month"))).alias("peak"),
    )
    keys = ["state", "event_type"]
    parts = []
    for n, (value, months, pattern, when, unknown, heading) in enumerate(
        [
            ("loss", "recovery", T.RANKING_LOSS, "%s months", "unknown", T.RANKING_LOSS_HEADING),
            ("surge", "peak", T.RANKING_SURGE, "month %s", "unknown timing", T.RANKING_SURGE_HEADING),
        ]
    ):
        ranked = rows.filter(F.col(value).isNotNull()).withColumn(
            "_i", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(value), "sector"))
        )
        length = F.when(F.col(months) > 0, N.say(when, fixed(F.col(months), 0))).otherwise(unknown)
        line = N.say(pattern, "_i", "sector", fixed(F.col(value), 0), length)
        block = line_block(ranked, keys, F.col("_i"), line)
        parts.append(block.select(*keys, F.lit(n).alias("_n"), F.concat(F.lit(heading + "\n"), "body").alias("body")))
    both = parts[0].unionByName(parts[1]).groupBy(*keys).agg(N.ordered_text(F.col("_n"), F.col("body"), "\n\n").alias("body"))
    scope = F.when(
        state.isNotNull() & kind.isNotNull(), N.say(" — %s %s", "state", type_label(kind))
    ).otherwise("")
    title = N.say(T.RANKING_TITLE, scope)
    return both.select(F.col("state").alias("asked_state"), F.col("event_type").alias("asked_type"), F.concat_ws("\n\n", title, "body").alias("structured"))


def portfolio_texts(scenarios: DataFrame, asks: DataFrame) -> DataFrame:
    """Portfolio text per distinct list of states and type that was asked for."""
    keys = ["asked_states", "asked_type"]
    wanted = asks.select(*keys).distinct().withColumn("state", F.explode("asked_states"))
    rows = wanted.join(
        scenarios.filter(F.col("job_loss_pct").isNotNull()).withColumnRenamed("event_type", "asked_type"), ["state", "asked_type"]
    )
    per = rows.groupBy(*keys, "sector").agg(
        F.round(F.avg("job_loss_pct"), 1).alias("avg_loss"), F.round(F.max("job_loss_pct"), 1).alias("worst_loss"),
        F.round(F.avg("recovery_months"), 0).alias("avg_recovery"), F.countDistinct("state").alias("covered"),
    )
    n = N.plain_number
    line = N.say(T.PORTFOLIO_LINE, "sector", n(F.col("avg_loss")), n(F.col("worst_loss")), n(F.col("avg_recovery")), "covered", F.size("asked_states"))
    body = line_block(per, keys, F.struct(-F.col("avg_loss"), "sector"), line)
    title = N.say(T.PORTFOLIO_TITLE, type_label(F.col("asked_type")), F.array_join("asked_states", ", "))
    return body.select(*keys, F.concat_ws("\n\n", title, "body").alias("structured"))


def surge_texts(scenarios: DataFrame) -> DataFrame:
    """Surge text per type, and one over all types under a null key."""
    rows = V.demand_surge(scenarios)
    n = N.plain_number
    order = F.struct(-F.col("avg_surge"), "sector", "event_type")

    def block(df, keys, tail, label):
        line = N.say(T.SURGE_LINE, "sector", n(F.col("avg_surge")), tail, fixed(F.col("avg_peak"), 0), "n_states")
        return line_block(df, keys, order, line).select(
            F.col("asked_type"), F.concat_ws("\n\n", N.say(T.SURGE_TITLE, label), "body").alias("structured")
        )

    after = N.say(" after %s", type_label(F.col("event_type")))
    by_type = rows.withColumn("asked_type", F.col("event_type"))
    per_type = block(by_type, ["asked_type"], after, N.say(" after %s", type_label(F.col("asked_type"))))
    whole = rows.withColumn("asked_type", F.lit(None).cast("string"))
    return per_type.unionByName(block(whole, ["asked_type"], N.say(" (%s)", type_label(F.col("event_type"))), F.lit("")))


ASKED = ["intent", "asked_states", "asked_state", "asked_type"]


def structured_answers(routed: DataFrame, scenarios: DataFrame, forecast: DataFrame, limit: int = 10) -> DataFrame:
    """The structured text of each routed question; null where its query finds nothing.

    All texts that can be asked for form one small stored table, keyed by intent and
    parameters, so the questions meet it in one join and are not shuffled by intent.
    """
    routed = stored(routed, "routed")  # read for the portfolios and for the answers
    texts = [
        N.top_risk_text(V.top_risk(scenarios, forecast, limit), limit).withColumn("intent", F.lit("top_risk")),
        N.preposition_text(V.preposition(scenarios, forecast, limit), limit).withColumn("intent", F.lit("preposition")),
        N.variance_text(V.recovery_variance(scenarios)).withColumn("intent", F.lit("recovery_variance")),
    ]
    texts = [df.withColumnRenamed("text", "structured") for df in texts]
    texts.append(sector_ranking_texts(scenarios).withColumn("intent", F.lit("sector_ranking")))
    texts.append(surge_texts(scenarios).withColumn("intent", F.lit("demand_surge")))
    held = portfolio_texts(scenarios, routed.filter(F.col("intent") == "portfolio"))
    texts.append(held.withColumn("intent", F.lit("portfolio")).withColumn("asked_states", state_list("asked_states")))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), texts)
    every = stored(every.select(*ASKED, "structured"), "answers")
    same = [
        F.col(f"q.{c}").eqNullSafe(F.col(f"a.{c}")) if c != "asked_states" else state_list("q.asked_states").eqNullSafe(F.col("a.asked_states"))
        for c in ASKED
    ]
    joined = routed.alias("q").join(every.alias("a"), reduce(lambda x, y: x & y, same), "left")
    return joined.select("q.*", "a.structured")


def state_list(column: str) -> Column:
    """A list of states as a join key; null stays null."""
    return F.when(F.col(column).isNotNull(), F.array_join(column, ","))


def question_context(answers: DataFrame, forecasts: DataFrame, county_texts: DataFrame, state_texts: DataFrame, retrieved: DataFrame, audience: Column) -> DataFrame:
    """One context text per question: forecast, impact, structured result, passages.

    ``answers`` are routed questions with their structured text; the exact county's
    impact text goes before the state's; default sentences stand in for gaps. The
    texts are stored, so that their size decides between broadcast and shuffle.
    """
    county_texts = county_texts.select("county_id", "event_type", F.col("prediction_text").alias("_county"))
    state_texts = state_texts.select("state", "event_type", F.col("prediction_text").alias("_state"))
    rows = (
        answers.join(stored(forecasts.select("state", "event_type", "forecast_text"), "forecast-texts"), ["state", "event_type"], "left")
        .join(stored(county_texts, "county-texts"), ["county_id", "event_type"], "left")
        .join(stored(state_texts, "state-texts"), ["state", "event_type"], "left")
        .join(retrieved.select("query_id", "retrieved"), "query_id", "left")
    )
    said = lambda c, default: F.coalesce(c, F.lit(default))
    parts = [
        said(F.col("forecast_text"), T.NO_FORECAST),
        said(F.coalesce("_county", "_state"), T.NO_PREDICTION),
        said(F.col("structured"), T.NO_STRUCTURED),
        said(F.col("retrieved"), T.NO_DOCUMENTS),
        N.say(T.CONTEXT_USER, said(F.col("state"), T.NOT_SPECIFIED), said(F.col("event_type"), T.NOT_SPECIFIED), said(F.col("job_title"), T.NOT_SPECIFIED)),
    ]
    blocks = [F.concat_ws("\n", F.lit(head), part) for head, part in zip(T.CONTEXT_HEADINGS, parts)]
    return rows.select("query_id", "intent", audience.alias("audience"), F.concat_ws("\n\n", *blocks).alias("context"))
