"""Rule-based reading of questions: audience, places, event type, intent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shockspan.functions.columns import contains_any, first_match
from shockspan.functions.lexicon import KNOWN_AUDIENCES, Lexicon

DEFAULT = Lexicon()


def texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def audience(job: Column, question: Column, given: Column | None = None, lex: Lexicon = DEFAULT) -> Column:
    """The named audience if it is known, else the first keyword's, else worker."""
    job, question = F.coalesce(job, F.lit("")), F.coalesce(question, F.lit(""))
    low = F.lower(F.concat_ws(" ", job, question))
    rules = [(contains_any(low, words), F.lit(name)) for name, words in lex.audiences.items()]
    guess = F.when((job == "") & (question == ""), "unknown").otherwise(first_match(rules, F.lit("worker")))
    return guess if given is None else F.when(given.isin(KNOWN_AUDIENCES), given).otherwise(guess)


def states_in(text: Column, lex: Lexicon = DEFAULT, case_sensitive: bool = False) -> Column:
    """State codes among the words, in order. Without regard to case, as by default,
    words such as "in" and "or" count as states too."""
    read = text if case_sensitive else F.upper(text)
    return F.filter(F.split(read, r"[^\p{L}\p{N}_]+"), lambda w: w.isin(lex.states))


def event_type_in(text: Column, lex: Lexicon = DEFAULT) -> Column:
    low = F.lower(text)
    return first_match([(F.contains(low, F.lit(w)), F.lit(t)) for w, t in lex.event_words], F.lit(None).cast("string"))


def region_states_in(text: Column, lex: Lexicon = DEFAULT) -> Column:
    """States of the first named region, else an empty list."""
    low = F.lower(text)
    rules = [(contains_any(low, [name.replace("_", " "), name]), texts(states)) for name, states in lex.regions.items()]
    return first_match(rules, texts([]))


def route_question(questions: DataFrame, lex: Lexicon = DEFAULT, case_sensitive: bool = False) -> DataFrame:
    """Intent of each question with the parameters of its query.

    ``questions`` need message, state and event_type (both may be null). A portfolio
    question without states falls on to the later intents.
    """
    low = F.lower("message")
    has = lambda words: contains_any(low, words)
    rows = questions.select(
        "*",
        states_in(F.col("message"), lex, case_sensitive).alias("_named"),
        region_states_in(F.col("message"), lex).alias("_region"),
        F.coalesce("event_type", event_type_in(F.col("message"), lex)).alias("_type"),
    )
    rows = rows.withColumn("_states", F.when(F.size("_region") > 0, F.col("_region")).otherwise(F.col("_named")))
    intent = first_match(
        [
            (has(lex.top_rank) & has(lex.top_rank_also), F.lit("top_risk")),
            (has(lex.preposition), F.lit("preposition")),
            (has(lex.portfolio) & (F.size("_states") > 0), F.lit("portfolio")),
            (has(lex.variance), F.lit("recovery_variance")),
            (has(lex.demand_surge), F.lit("demand_surge")),
            (has(lex.sector_rank) | has(lex.top_rank), F.lit("sector_ranking")),
        ],
        F.lit("none"),
    )
    rows = rows.withColumn("intent", intent)
    which = F.col("intent")
    return rows.select(
        *questions.columns, "intent",
        F.when(which == "portfolio", F.array_distinct("_states")).alias("asked_states"),
        F.when(which == "sector_ranking", F.coalesce("state", F.get("_named", F.lit(0)))).alias("asked_state"),
        F.when(which == "portfolio", F.coalesce("_type", F.lit(lex.default_event)))
        .when(which.isin("demand_surge", "sector_ranking"), F.col("_type"))
        .alias("asked_type"),
    )
