"""Registered queries: chunks, corpus, retrieval, routing and question contexts."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from shockspan.functions import phrases as T
from shockspan.functions.columns import WHITESPACE, type_key
from shockspan.functions.lexicon import STATE_CODES, Lexicon
from shockspan.operators import context as C
from shockspan.operators import export as E
from shockspan.operators import index as IX
from shockspan.operators import latent as L
from shockspan.operators import narrative as N
from shockspan.operators import retrieval as R
from shockspan.operators import routing as Q
from shockspan.operators import text as X
from shockspan.plans.dashboard_plans import forecast_blocks, label, num, q, quoted, seasonal_profiles, sql_list
from shockspan.plans.registry import query, view
from shockspan.plans.serving_plans import TYPE, outlook, regions, scenarios
from shockspan.session import scratch_path

# The questions are invented prose, so routing is bound to words that occur in it.
ASIA = [f"NATION_{i}" for i in (2, 7, 12, 17, 22)]
EUROPE = [f"NATION_{i}" for i in (3, 8, 13, 18, 23)]
LEX = Lexicon(
    audiences={"insurer": ["ando"], "investor": ["zt"], "policymaker": ["keit"], "employer": ["ment"]},
    event_words=[("ung", "1-urgent"), ("tion", "2-high"), ("elle", "3-medium"), ("ich", "5-low")],
    default_event="3-medium",
    regions={"thing": ASIA, "eau": EUROPE},
    top_rank=["eran", "zt"],
    top_rank_also=["the", "un"],
    sector_rank=["sch", "que"],
    portfolio=["and", "la "],
    variance=["keit"],
    demand_surge=["ing", "elle"],
    preposition=["rest"],
)

TRIM = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)
view("texts", f"SELECT doc_id, lang, source, trim(text, {TRIM}) AS text FROM documents WHERE trim(text, {TRIM}) <> ''")
view("chunks", """
  SELECT doc_id, lang, source, i::INT AS chunk, text[(i * 700 + 1):(i * 700 + 800)] AS text, doc_id || '_chunk_' || i AS id
  FROM (SELECT *, unnest(range(CASE WHEN length(text) <= 800 THEN 1 ELSE ceil((length(text) - 100) / 700) END::BIGINT)) AS i FROM texts)""", "texts")


def documents(t):
    return t.table("documents").select("doc_id", "lang", "source", "text")


@query("chunk_text", "SELECT * FROM chunks", "chunks")
def _(t):
    return X.chunk_text(documents(t), "doc_id", "text")


NAME_RULES = {
    "categories": {"src1": "general_a", "fr_": "french", "src2": "general_b"},
    "event_types": {"_7": "flood", "9.": "fire"},
    "states": {"en_": "EN", "de_": "DE"},
}


def cased(column, table, test, default):
    arms = " ".join(f"WHEN {test.format(c=column, k=quoted(k))} THEN '{v}'" for k, v in table.items())
    return f"CASE {arms} ELSE {default} END"


NAMED = "lang || '_' || source || '_' || doc_id || '.md'"
view("named", f"""
  SELECT doc_id, name, {cased('name', NAME_RULES['categories'], 'contains({c}, {k})', "'general'")} AS category,
         {cased('name', NAME_RULES['event_types'], 'contains({c}, {k})', 'NULL')} AS event_type,
         {cased('name', NAME_RULES['states'], 'starts_with({c}, {k})', 'NULL')} AS state
  FROM (SELECT doc_id, {NAMED} AS name FROM documents)""")


def named(t):
    name = F.concat(F.col("lang"), F.lit("_"), F.col("source"), F.lit("_"), F.col("doc_id"), F.lit(".md"))
    return t.table("documents").select("doc_id", "text", name.alias("name"))


@query("infer_metadata", "SELECT * FROM named", "named")
def _(t):
    return X.infer_metadata(named(t).drop("text"), "name", **NAME_RULES)


view("corpus", f"""
  SELECT name || '_chunk_' || chunk AS id, c.text, category, state, event_type, name AS source, NULL AS county_id, NULL AS region
  FROM chunks c JOIN named USING (doc_id)
  UNION ALL SELECT id, text, 'model_output', NULL, event_type, 'model_predictions', county_id, region FROM impact_texts
  UNION ALL
  SELECT id || '_chunk_' || i, text[(i * 700 + 1):(i * 700 + 800)], 'forecast', state, lower(event_type), 'forecast_profiles', NULL, NULL
  FROM (SELECT *, unnest(range(CASE WHEN length(text) <= 800 THEN 1 ELSE ceil((length(text) - 100) / 700) END::BIGINT)) AS i FROM seasonal_texts)""",
     "chunks", "named", "impact_texts", "seasonal_texts")


def corpus(t):
    docs = X.infer_metadata(named(t), "name", **NAME_RULES).drop("doc_id")
    return X.build_corpus(docs, N.impact_text(scenarios(t), regions(t)), seasonal_profiles(t))


@query("build_corpus", "SELECT * FROM corpus", "corpus")
def _(t):
    return corpus(t)


@query("upsert_chunks", """
  SELECT doc_id, quality, toxic, text, newer FROM (
    SELECT d.doc_id, NULL::INT AS quality, NULL::INT AS toxic, text, 0 AS newer FROM documents d
    WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT doc_id, arg_max(quality, (toxic, quality)), max(toxic), NULL, 1 FROM labels GROUP BY doc_id)""")
def _(t):
    old = t.table("documents").select("doc_id", "text", F.lit(0).alias("newer"))
    old = old.withColumns({"quality": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")})
    new = t.table("labels").select("doc_id", "quality", F.lit(1).alias("newer"), F.col("toxic").alias("seq"), "toxic")
    return X.upsert_chunks(old, new, "doc_id", "seq")


@query("upsert_keyed", """
  SELECT doc_id, quality, toxic, text, newer FROM (
    SELECT d.doc_id, NULL::INT AS quality, NULL::INT AS toxic, text, 0 AS newer FROM documents d
    WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id % 7 = 0)
    UNION ALL SELECT doc_id, arg_max(quality, (toxic, quality)), max(toxic), NULL, 1 FROM labels WHERE doc_id % 7 = 0 GROUP BY doc_id)""")
def _(t):
    """The same in place: only the folders of the new keys are rewritten."""
    none = F.lit(None).cast("int")
    path = scratch_path(t.spark, "keyed")
    old = t.table("documents").select("doc_id", none.alias("quality"), none.alias("toxic"), "text", F.lit(0).alias("newer"))
    X.create_keyed(old, path, "doc_id", 8)
    new = t.table("labels").filter("doc_id % 7 = 0").select("doc_id", "quality", "toxic", F.lit(None).cast("string").alias("text"), F.lit(1).alias("newer"))
    X.upsert_keyed(t.spark, path, new, "doc_id", "toxic", 8)
    return t.spark.read.parquet(path).drop("part")


@query("hashed_words", """
  SELECT id, array_to_string(list(coalesce(n, 0) ORDER BY slot), ' ') AS counts
  FROM (SELECT DISTINCT id FROM chunks) CROSS JOIN (SELECT unnest(range(64)) AS slot)
  LEFT JOIN (SELECT id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS slot, count(*) AS n
             FROM (SELECT id, unnest(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+')) AS w FROM chunks) WHERE w <> '' GROUP BY ALL)
    USING (id, slot) GROUP BY id""", "chunks")
def _(t):
    out = X.hashed_words(X.chunk_text(documents(t), "doc_id", "text"), "id", "text")
    return out.select("id", F.array_join(F.transform("embedding", lambda x: x.cast("int")), " ").alias("counts"))


# ---- retrieval -------------------------------------------------------------
CATEGORY = ["unemployment", "fema", "cobra", "model_output", "forecast", "warn_act", "retraining", "recovery_timelines",
            "transferable_skills", "general"]
view("stored_vectors", f"""
  SELECT vec_id AS id, ({sql_list(CATEGORY)})[label + 1] AS category, ({sql_list(['CA', 'FL', 'TX'])})[vec_id % 3 + 1] AS state,
         ({sql_list(['fire', 'flood', 'hurricane', 'tornado'])})[vec_id % 4 + 1] AS event_type, embedding::DOUBLE[] AS embedding, label
  FROM embeddings""")


def pick(words, index):
    return F.element_at(F.array(*[F.lit(w) for w in words]), (index + 1).cast("int"))


def stored_vectors(t):
    return t.table("embeddings").select(
        F.col("vec_id").alias("id"), pick(CATEGORY, F.col("label")).alias("category"),
        pick(["CA", "FL", "TX"], F.col("vec_id") % 3).alias("state"),
        pick(["fire", "flood", "hurricane", "tornado"], F.col("vec_id") % 4).alias("event_type"), "embedding", "label",
    )


def centres(t):
    """One query per label: its mean vector, in one of the four filter modes."""
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.col("embedding"))))
    rows = t.table("embeddings").groupBy("label").agg(mean.alias("embedding"))
    mode = F.col("label") % 4
    return rows.select(
        F.col("label").alias("query_id"), F.when(mode < 2, F.lit("FL")).alias("state"),
        F.when(mode.isin(0, 2), F.lit("flood")).alias("event_type"), "embedding",
    )


def filter_sql(state, kind, category, has_state, has_type):
    return f"""CASE WHEN {has_state} AND {has_type} THEN {state} OR {kind} OR {category} IN ({", ".join(map(quoted, R.STATE_AND_TYPE))})
      WHEN {has_state} THEN {state} OR {category} IN ({", ".join(map(quoted, R.STATE_ONLY))})
      WHEN {has_type} THEN {kind} OR {category} IN ({", ".join(map(quoted, R.TYPE_ONLY))}) ELSE true END"""


view("centres", """
  SELECT label AS query_id, list(v ORDER BY p) AS embedding FROM (
    SELECT label, p, avg(v) AS v FROM (SELECT label, unnest(embedding::DOUBLE[]) AS v, unnest(range(64)) AS p FROM embeddings) GROUP BY label, p)
  GROUP BY label""")


@query("topk_cosine", f"""
  SELECT query_id, id, round(sim, 4) AS similarity, rank FROM (
    SELECT query_id, id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id)::INT AS rank FROM (
      SELECT query_id, c.id, round(list_cosine_similarity(q.embedding, c.embedding), 9) AS sim
      FROM centres q CROSS JOIN stored_vectors c
      WHERE {filter_sql("c.state = 'FL'", "c.event_type = 'flood'", "c.category", "query_id % 4 < 2", "query_id % 4 IN (0, 2)")}))
  WHERE rank <= 6""", "centres", "stored_vectors")
def _(t):
    return R.topk_cosine(stored_vectors(t), centres(t), 6)


@query("topk_cosine_all", f"""
  SELECT query_id, id, round(sim, 4) AS similarity, rank FROM (
    SELECT query_id, id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id)::INT AS rank FROM (
      SELECT q.id AS query_id, c.id, round(list_cosine_similarity(q.embedding, c.embedding), 9) AS sim
      FROM stored_vectors q CROSS JOIN stored_vectors c
      WHERE {filter_sql("c.state = q.state", "c.event_type = q.event_type", "c.category", "q.id % 5 < 2", "q.id % 7 < 3")}))
  WHERE rank <= 3""", "stored_vectors")
def _(t):
    return R.topk_cosine(stored_vectors(t), every_asks(t), 3)


def every_asks(t):
    """Every stored vector asks, under one of the four filter modes."""
    i = F.col("id")
    return stored_vectors(t).select(
        i.alias("query_id"), F.when(i % 5 < 2, F.col("state")).alias("state"), F.when(i % 7 < 3, F.col("event_type")).alias("event_type"), "embedding"
    )


@query("topk_index")
def _(t):
    """The same questions through the index; approximate, so without SQL."""
    return indexed_hits(stored_vectors(t), every_asks(t), 3)


def indexed_hits(base, asked, k):
    index = IX.built(base)
    return IX.search(index, asked, k, IX.probes_for(index, asked, k))


@query("topk_index_recall", """
  SELECT count(*) AS n_exact, true AS enough FROM (
    SELECT q.id, row_number() OVER (PARTITION BY q.id) AS r FROM stored_vectors q CROSS JOIN stored_vectors c
    WHERE """ + filter_sql("c.state = q.state", "c.event_type = q.event_type", "c.category", "q.id % 5 < 2", "q.id % 7 < 3") + """) WHERE r <= 3""", "stored_vectors")
def _(t):
    """How many of the exact hits of every stored vector the index finds."""
    base, asked = stored_vectors(t), every_asks(t)
    out = IX.recall(indexed_hits(base, asked, 3), R.topk_cosine(base, asked, 3))
    return out.select("n_exact", (F.col("recall") >= 0.9).alias("enough"))


@query("tfidf", r"""
  WITH words AS (SELECT doc_id AS key, unnest(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+')) AS word FROM documents),
  counts AS MATERIALIZED (SELECT key, word, count(*) AS n FROM words WHERE word <> '' GROUP BY ALL),
  idf AS (SELECT word, ln((1.0 + (SELECT count(DISTINCT key) FROM counts)) / (1 + count(*))) + 1 AS idf FROM counts GROUP BY word),
  raw AS (SELECT key, word, n * idf AS w FROM counts JOIN idf USING (word))
  SELECT key, word, round(w / sqrt(sum(w * w) OVER (PARTITION BY key)), 6) AS w FROM raw""")
def _(t):
    return L.tfidf(documents(t), "doc_id", "text").withColumn("w", F.round("w", 6))


#: Coordinates of the registered text vectors.
LATENT = 16


@query("topk_latent")
def _(t):
    """Each user turn's most similar documents, by vectors fitted on the documents; without SQL."""
    weights = t.stage("weights", lambda: L.tfidf(documents(t), "doc_id", "text"))
    space = L.fitted(weights, LATENT)
    none = F.lit(None).cast("string")
    docs = space.embedded(weights).select(
        F.col("key").alias("id"), F.lit("general").alias("category"), none.alias("state"), none.alias("event_type"), "embedding"
    )
    asked = space.embedded(L.tfidf(questions(t), "query_id", "message")).select(
        F.col("key").alias("query_id"), none.alias("state"), none.alias("event_type"), "embedding"
    )
    return R.topk_cosine(docs, asked, 3)


# ---- questions -------------------------------------------------------------
view("questions", """
  SELECT conv_id * 1000 + turn AS query_id, text AS message,
         CASE WHEN conv_id % 3 <> 0 THEN 'NATION_' || conv_id % 25 END AS state,
         CASE WHEN conv_id % 2 = 0 THEN ['1-urgent', '2-high', '3-medium', '4-not_specified', '5-low'][conv_id % 5 + 1] END AS event_type,
         CASE WHEN conv_id % 4 = 0 THEN lpad((conv_id % 25)::VARCHAR, 2, '0') || lpad((turn % 5)::VARCHAR, 3, '0') END AS county_id,
         CASE WHEN conv_id % 5 = 1 THEN 'fund manager' WHEN conv_id % 5 = 2 THEN 'teacher' END AS job_title,
         CASE WHEN conv_id % 11 = 0 THEN 'investor' WHEN conv_id % 11 = 1 THEN 'somebody' END AS audience_type, conv_id
  FROM conversations WHERE role = 'user'""")


def questions(t):
    c, turn = F.col("conv_id"), F.col("turn")
    return t.table("conversations").filter(F.col("role") == "user").select(
        (c * 1000 + turn).alias("query_id"), F.col("text").alias("message"),
        F.when(c % 3 != 0, F.concat(F.lit("NATION_"), c % 25)).alias("state"),
        F.when(c % 2 == 0, pick(["1-urgent", "2-high", "3-medium", "4-not_specified", "5-low"], c % 5)).alias("event_type"),
        F.when(c % 4 == 0, F.concat(F.lpad((c % 25).cast("string"), 2, "0"), F.lpad((turn % 5).cast("string"), 3, "0"))).alias("county_id"),
        F.when(c % 5 == 1, F.lit("fund manager")).when(c % 5 == 2, F.lit("teacher")).alias("job_title"),
        F.when(c % 11 == 0, F.lit("investor")).when(c % 11 == 1, F.lit("somebody")).alias("audience_type"),
        "conv_id",
    )


def has(words, c="low"):
    return "(" + " OR ".join(f"contains({c}, {quoted(w)})" for w in words) + ")"


AUDIENCE = """CASE WHEN audience_type IN ('worker', 'employer', 'policymaker', 'investor', 'insurer', 'unknown') THEN audience_type
      WHEN coalesce(job_title, '') = '' AND message = '' THEN 'unknown' {arms} ELSE 'worker' END""".format(
    arms=" ".join(f"WHEN {has(w, 'lower(concat(job_title, chr(32), message))')} THEN '{n}'" for n, w in LEX.audiences.items()))


@query("detect_audience", f"SELECT query_id, {AUDIENCE} AS audience FROM questions", "questions")
def _(t):
    who = Q.audience(F.col("job_title"), F.col("message"), F.col("audience_type"), LEX)
    return questions(t).select("query_id", who.alias("audience"))


WORDS = "string_split(regexp_replace({t}, '[^\\p{{L}}\\p{{N}}_]', ' ', 'g'), ' ')"
NAMED_STATES = f"list_filter({WORDS.format(t='upper(message)')}, lambda w: list_contains({sql_list(STATE_CODES)}, w))"


@query("extract_states", f"SELECT query_id, array_to_string({NAMED_STATES}, ' ') AS states FROM questions", "questions")
def _(t):
    return questions(t).select("query_id", F.array_join(Q.states_in(F.col("message")), " ").alias("states"))


@query("extract_states_as_written", f"""
  SELECT query_id, array_to_string(list_filter({WORDS.format(t='message')}, lambda w: list_contains({sql_list(STATE_CODES)}, w)), ' ') AS states
  FROM questions""", "questions")
def _(t):
    return questions(t).select("query_id", F.array_join(Q.states_in(F.col("message"), case_sensitive=True), " ").alias("states"))


EVENT = "CASE " + " ".join(f"WHEN contains(low, '{w}') THEN '{v}'" for w, v in LEX.event_words) + " END"
REGION = "CASE " + " ".join(f"WHEN contains(low, '{k}') THEN {sql_list(v)}" for k, v in LEX.regions.items()) + " ELSE []::VARCHAR[] END"


@query("extract_type", f"SELECT query_id, {EVENT} AS event_type FROM (SELECT query_id, lower(message) AS low FROM questions)", "questions")
def _(t):
    return questions(t).select("query_id", Q.event_type_in(F.col("message"), LEX).alias("event_type"))


@query("extract_region", f"""
  SELECT query_id, array_to_string({REGION}, ' ') AS states FROM (SELECT query_id, lower(message) AS low FROM questions)""", "questions")
def _(t):
    return questions(t).select("query_id", F.array_join(Q.region_states_in(F.col("message"), LEX), " ").alias("states"))


view("routed", f"""
  SELECT * EXCLUDE (low, named_states, region_states, any_type, states),
         CASE WHEN intent = 'portfolio' THEN list_filter(states, lambda s, i: NOT list_contains(states[:i - 1], s)) END AS asked_states,
         CASE WHEN intent = 'sector_ranking' THEN coalesce(state, named_states[1]) END AS asked_state,
         CASE WHEN intent = 'portfolio' THEN coalesce(any_type, '{LEX.default_event}')
              WHEN intent IN ('demand_surge', 'sector_ranking') THEN any_type END AS asked_type
  FROM (SELECT *, CASE WHEN {has(LEX.top_rank)} AND {has(LEX.top_rank_also)} THEN 'top_risk' WHEN {has(LEX.preposition)} THEN 'preposition'
                       WHEN {has(LEX.portfolio)} AND len(states) > 0 THEN 'portfolio' WHEN {has(LEX.variance)} THEN 'recovery_variance'
                       WHEN {has(LEX.demand_surge)} THEN 'demand_surge' WHEN {has(LEX.sector_rank)} OR {has(LEX.top_rank)} THEN 'sector_ranking'
                       ELSE 'none' END AS intent
        FROM (SELECT *, CASE WHEN len(region_states) > 0 THEN region_states ELSE named_states END AS states
              FROM (SELECT *, {NAMED_STATES} AS named_states, {REGION} AS region_states, coalesce(event_type, {EVENT}) AS any_type
                    FROM (SELECT *, lower(message) AS low FROM questions))))""", "questions")


def routed(t):
    return Q.route_question(questions(t), LEX)


@query("route_question", """
  SELECT query_id, intent, array_to_string(asked_states, ' ') AS asked_states, asked_state, asked_type FROM routed""", "routed")
def _(t):
    return routed(t).select("query_id", "intent", F.array_join("asked_states", " ").alias("asked_states"), "asked_state", "asked_type")


view("knowledge", f"""
  SELECT v.id, category, source, text, v.state, v.event_type, v.embedding FROM stored_vectors v
  JOIN (SELECT doc_id, {NAMED} AS source, trim(text, {TRIM}) AS text FROM documents) d ON d.doc_id = v.id""", "stored_vectors")
view("question_hits", f"""
  SELECT query_id, id, rank FROM (
    SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id)::INT AS rank FROM (
      SELECT q.query_id, c.id, round(list_cosine_similarity(e.embedding::DOUBLE[], c.embedding), 9) AS sim
      FROM questions q JOIN embeddings e ON e.vec_id = q.conv_id CROSS JOIN knowledge c
      WHERE {filter_sql("c.state = q.state", "c.event_type = q.event_type", "c.category", "q.state IS NOT NULL", "q.event_type IS NOT NULL")}))
  WHERE rank <= 2""", "questions", "knowledge")
view("passages", """
  SELECT query_id, string_agg('[Source ' || rank || ' — ' || coalesce(category, 'unknown') || '] (' || source || ')' || chr(10) || text,
                              chr(10) || chr(10) ORDER BY rank) AS retrieved
  FROM question_hits JOIN knowledge USING (id) GROUP BY query_id""", "question_hits", "knowledge")


def knowledge(t):
    return stored_vectors(t).join(named(t), F.col("id") == F.col("doc_id")).select(
        "id", "category", "state", "event_type", "embedding", F.col("name").alias("source"), F.btrim("text", F.lit(WHITESPACE)).alias("text")
    )


def passages(t):
    """Each question's vector is the stored one of its conversation."""
    vectors = t.table("embeddings").select("vec_id", "embedding")
    asked = questions(t).join(vectors, F.col("conv_id") == F.col("vec_id")).select("query_id", "state", "event_type", "embedding")
    base = knowledge(t)
    return R.format_hits(R.topk_cosine(base, asked, 2), base)


@query("format_hits", "SELECT * FROM passages", "passages")
def _(t):
    return passages(t)


view("scope_ranks", """
  SELECT state, event_type, kind, sector, pct, months,
         row_number() OVER (PARTITION BY state, event_type, kind ORDER BY pct DESC, sector) AS i
  FROM (SELECT state, event_type, 0 AS kind, sector, avg(job_loss_pct) AS pct, avg(recovery_months) AS months
        FROM scenarios WHERE job_loss_pct IS NOT NULL
        GROUP BY GROUPING SETS ((state, event_type, sector), (state, sector), (event_type, sector), (sector))
        UNION ALL
        SELECT state, event_type, 1, sector, avg(job_change_pct), avg(peak_month)
        FROM scenarios WHERE job_change_pct IS NOT NULL
        GROUP BY GROUPING SETS ((state, event_type, sector), (state, sector), (event_type, sector), (sector)))""", "scenarios")
view("scope_texts", f"""
  SELECT state AS asked_state, event_type AS asked_type,
         printf({q(T.RANKING_TITLE)}, CASE WHEN state IS NOT NULL AND event_type IS NOT NULL THEN ' — ' || state || ' ' || {label('event_type')} ELSE '' END)
         || chr(10) || chr(10) || string_agg(CASE kind WHEN 0 THEN {q(T.RANKING_LOSS_HEADING)} ELSE {q(T.RANKING_SURGE_HEADING)} END || chr(10) || body,
                                             chr(10) || chr(10) ORDER BY kind) AS structured
  FROM (SELECT state, event_type, kind,
               string_agg(CASE kind WHEN 0 THEN printf({q(T.RANKING_LOSS)}, i, sector, {num('pct', 0)}, {num('months', 0)} || ' months')
                                    ELSE printf({q(T.RANKING_SURGE)}, i, sector, {num('pct', 0)}, 'month ' || {num('months', 0)}) END, chr(10) ORDER BY i) AS body
        FROM scope_ranks GROUP BY state, event_type, kind) GROUP BY state, event_type""", "scope_ranks")
view("held_texts", f"""
  SELECT asked_states, asked_type, printf({q(T.PORTFOLIO_TITLE)}, {label('asked_type')}, array_to_string(asked_states, ', ')) || chr(10) || chr(10)
         || string_agg(printf({q(T.PORTFOLIO_LINE)}, sector, avg_loss::VARCHAR, worst_loss::VARCHAR, avg_recovery::VARCHAR, covered, len(asked_states)),
                       chr(10) ORDER BY avg_loss DESC, sector) AS structured
  FROM (SELECT asked_states, asked_type, sector, round(avg(job_loss_pct), 1) AS avg_loss, round(max(job_loss_pct), 1) AS worst_loss,
               round(avg(recovery_months), 0) AS avg_recovery, count(DISTINCT s.state) AS covered
        FROM (SELECT DISTINCT asked_states, asked_type FROM routed WHERE intent = 'portfolio') a
        JOIN scenarios s ON s.event_type = a.asked_type AND list_contains(a.asked_states, s.state)
        WHERE job_loss_pct IS NOT NULL GROUP BY asked_states, asked_type, sector) GROUP BY asked_states, asked_type""", "routed", "scenarios")
view("surge_texts", f"""
  SELECT asked_type, printf({q(T.SURGE_TITLE)}, CASE WHEN asked_type IS NULL THEN '' ELSE ' after ' || {label('asked_type')} END) || chr(10) || chr(10)
         || string_agg(printf({q(T.SURGE_LINE)}, sector, avg_surge::VARCHAR,
                              CASE WHEN asked_type IS NULL THEN ' (' || {label('event_type')} || ')' ELSE ' after ' || {label('event_type')} END,
                              {num('avg_peak', 0)}, n_states), chr(10) ORDER BY avg_surge DESC, sector, event_type) AS structured
  FROM (SELECT event_type AS asked_type, * FROM surges UNION ALL SELECT NULL, * FROM surges) GROUP BY asked_type""", "surges")
view("single_texts", f"""
  SELECT 'top_risk' AS intent, {q(T.RISK_TITLE % 10)} || chr(10) || {q(T.RISK_SUBTITLE)} || chr(10) || chr(10)
         || string_agg(printf({q(T.RISK_LINE)}, i, state, sector, {label('event_type')}) || chr(10)
            || printf({q(T.RISK_DETAIL)}, avg_loss_pct::VARCHAR, avg_recovery::VARCHAR, freq_per_month::VARCHAR, risk_score::VARCHAR), chr(10) ORDER BY i) AS structured
  FROM (SELECT *, row_number() OVER (ORDER BY risk_score DESC, state, sector, event_type) AS i FROM risks)
  UNION ALL
  SELECT 'preposition', {q(T.PREPOSITION_TITLE % 10)} || chr(10) || {q(T.PREPOSITION_SUBTITLE)} || chr(10) || chr(10)
         || string_agg(printf({q(T.PREPOSITION_LINE)}, i, state, {label('event_type')}, ', peak: ' || peaks) || chr(10)
            || printf({q(T.PREPOSITION_DETAIL)}, freq::VARCHAR, avg_loss::VARCHAR, priority_score::VARCHAR), chr(10) ORDER BY i)
  FROM (SELECT *, row_number() OVER (ORDER BY priority_score DESC, state, event_type) AS i FROM positions)
  UNION ALL
  SELECT 'recovery_variance', {q(T.VARIANCE_TITLE)} || chr(10) || chr(10)
         || string_agg(printf({q(T.VARIANCE_LINE)}, i, sector, avg_recovery::VARCHAR, range_months::VARCHAR, band, n_data_points), chr(10) ORDER BY i)
  FROM (SELECT *, row_number() OVER (ORDER BY range_months DESC, sector) AS i FROM spreads)""", "risks", "positions", "spreads")
view("answers", """
  SELECT r.*, coalesce(s.structured, k.structured, h.structured, g.structured) AS structured
  FROM routed r
  LEFT JOIN single_texts s ON s.intent = r.intent
  LEFT JOIN scope_texts k ON r.intent = 'sector_ranking' AND k.asked_state IS NOT DISTINCT FROM r.asked_state AND k.asked_type IS NOT DISTINCT FROM r.asked_type
  LEFT JOIN held_texts h ON r.intent = 'portfolio' AND h.asked_states = r.asked_states AND h.asked_type = r.asked_type
  LEFT JOIN surge_texts g ON r.intent = 'demand_surge' AND g.asked_type IS NOT DISTINCT FROM r.asked_type""",
     "routed", "single_texts", "scope_texts", "held_texts", "surge_texts")


def answers(t):
    return C.structured_answers(routed(t), scenarios(t), outlook(t))


@query("structured_answers", "SELECT query_id, intent, structured FROM answers", "answers")
def _(t):
    return answers(t).select("query_id", "intent", "structured")


view("county_texts", f"""
  SELECT county_id, event_type,
         printf({quoted(T.PREDICTION_TITLE)}, {label('event_type')}, any_value(region)) || chr(10)
         || printf({quoted(T.PREDICTION_SUMMARY)}, any_value(text)) || chr(10) || {quoted(T.PREDICTION_HEADING)} || chr(10)
         || string_agg(CASE WHEN job_loss_pct IS NOT NULL THEN printf({quoted(T.PREDICTION_LOSS)}, sector, job_loss_pct::VARCHAR, recovery_months::INT::VARCHAR)
                            ELSE printf({quoted(T.PREDICTION_GAIN)}, sector, job_change_pct::VARCHAR, peak_month::VARCHAR) END, chr(10) ORDER BY sector_rank) AS prediction_text
  FROM scenarios JOIN impact_texts USING (county_id, event_type) GROUP BY county_id, event_type""", "scenarios", "impact_texts")


def county_texts(t):
    rows = scenarios(t)
    texts = N.impact_text(rows, regions(t)).select("event_type", "county_id", "region", "text")
    return N.prediction_text(
        rows.join(texts, ["event_type", "county_id"]), ["county_id", "event_type"], F.col("region"), F.col("text"), F.col("sector_rank")
    )


@query("county_prediction_text", "SELECT * FROM county_texts", "county_texts")
def _(t):
    return county_texts(t)


HEADS = [quoted(h) for h in T.CONTEXT_HEADINGS]
view("outlook_texts", f"SELECT state, {TYPE} AS event_type, forecast_text FROM forecast_texts", "forecast_texts")


@query("question_context", f"""
  SELECT a.query_id, a.intent, {AUDIENCE} AS audience, array_to_string([
      {HEADS[0]} || chr(10) || coalesce(forecast_text, {quoted(T.NO_FORECAST)}),
      {HEADS[1]} || chr(10) || coalesce(c.prediction_text, p.prediction_text, {quoted(T.NO_PREDICTION)}),
      {HEADS[2]} || chr(10) || coalesce(structured, {quoted(T.NO_STRUCTURED)}),
      {HEADS[3]} || chr(10) || coalesce(retrieved, {quoted(T.NO_DOCUMENTS)}),
      {HEADS[4]} || chr(10) || printf({quoted(T.CONTEXT_USER)}, coalesce(a.state, {quoted(T.NOT_SPECIFIED)}),
                                      coalesce(a.event_type, {quoted(T.NOT_SPECIFIED)}), coalesce(job_title, {quoted(T.NOT_SPECIFIED)}))],
      chr(10) || chr(10)) AS context
  FROM answers a
  LEFT JOIN outlook_texts o ON o.state = a.state AND o.event_type = a.event_type
  LEFT JOIN county_texts c ON c.county_id = a.county_id AND c.event_type = a.event_type
  LEFT JOIN prediction_texts p ON p.state = a.state AND p.event_type = a.event_type
  LEFT JOIN passages d ON d.query_id = a.query_id""",
       "answers", "outlook_texts", "county_texts", "prediction_texts", "passages")
def _(t):
    forecasts = forecast_blocks(t).withColumn("event_type", type_key(F.col("event_type")))
    states = N.state_prediction_text(E.rollup_state(scenarios(t)))
    who = Q.audience(F.col("job_title"), F.col("message"), F.col("audience_type"), LEX)
    return C.question_context(answers(t), forecasts, county_texts(t), states, passages(t), who)
