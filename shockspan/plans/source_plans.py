"""Registered queries: every reader and writer, over files that Spark writes first."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import functions as F

from shockspan.operators import forecast as P
from shockspan.operators import narrative as N
from shockspan.operators import sketches as K
from shockspan.plans import series_plans as SP
from shockspan.plans.dashboard_plans import seasonal_profiles
from shockspan.plans.registry import query
from shockspan.plans.serving_plans import TYPE, regions, scenarios
from shockspan.plans.text_plans import TRIM
from shockspan.session import scratch_path
from shockspan.sources import readers as R


def written(df, fmt, **kw):
    path = scratch_path(df.sparkSession, fmt)
    R.write_table(df, path, fmt, **kw)
    return path


@query("read_declarations", """
  SELECT event_id, state, level, event_type, title, begin_on, end_on, county_id[1:2]::INT::VARCHAR AS state_code,
         county_code::INT::VARCHAR AS county_code, area, county_id FROM shocks""", "shocks")
def _(t):
    raw = t.shocks.select(
        "event_id", "state", "level", "event_type", "title", "begin_on", "end_on",
        F.substring("county_id", 1, 2).cast("int").cast("string").alias("state_code"),
        F.col("county_code").cast("int").cast("string").alias("county_code"), "area",
        F.lit("unused").alias("note"),
    )
    return R.read_declarations(t.spark, written(raw, "csv"), raw.schema)


@query("read_csv_dates", "SELECT * FROM events")
def _(t):
    raw = t.table("events")
    return R.read_csv_dates(t.spark, written(raw, "csv", escape='"'), raw.schema, escape='"')


PERSON_JOBS = """
  SELECT title, strftime(started_on, '%Y-%m-%d') AS started_at, ended_at, county_id, locality, region, company, industry, persons
  FROM person_jobs, (SELECT count(DISTINCT l_orderkey) AS persons FROM jobs)"""


def jobs_of(people):
    n = people.select(F.count(F.lit(1))).scalar()
    return people.select(F.explode("jobs").alias("j")).select(
        "j.title", "j.started_at", "j.ended_at", "j.location_details.county_id", "j.location_details.locality", "j.location_details.region",
        F.col("j.company.name").alias("company"), "j.company.industry", n.alias("persons"),
    )


@query("read_persons", PERSON_JOBS, "person_jobs", "jobs")
def _(t):
    return jobs_of(R.read_persons(t.spark, written(t.persons.select("jobs"), "json", compression="gzip")))


def _bracketed(batches):
    """The lines of a task as one array."""
    comma = ""
    yield pa.RecordBatch.from_pydict({"value": ["["]})
    for batch in batches:
        lines = [comma + x for x in batch.column(0).to_pylist()[:1]] + ["," + x for x in batch.column(0).to_pylist()[1:]]
        comma = "," if lines else comma
        yield pa.RecordBatch.from_pydict({"value": pa.array(lines, pa.string())})
    yield pa.RecordBatch.from_pydict({"value": ["]"]})


@query("read_persons_arrays", PERSON_JOBS, "person_jobs", "jobs")
def _(t):
    """The same persons from files that are one array each."""
    lines = t.persons.select(F.to_json(F.struct("jobs")).alias("value"))
    return jobs_of(R.read_persons(t.spark, written(lines.mapInArrow(_bracketed, "value string"), "text"), one_array=True))


@query("read_predictions", """
  SELECT s.county_id, state, s.event_type, region, sector, job_loss_pct, job_change_pct, recovery_months, peak_month
  FROM scenarios s JOIN regions_of USING (county_id)""", "scenarios", "regions_of")
def _(t):
    rows = scenarios(t)
    path = written(R.nested_predictions(rows, N.impact_text(rows, regions(t))), "json")
    states = t.table("nation").select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("prefix"), F.col("n_name").alias("state"))
    return R.read_predictions(t.spark, path, states)


@query("read_forecasts", f"""
  SELECT replace(state, '_', '') AS state, {TYPE} AS event_type, total_historical, array_to_string(peak_months, ', ') AS peak_months,
         avg_next_12, cv_mae FROM forecast_table""", "forecast_table")
def _(t):
    f = SP.filled(t).withColumn("state", F.replace("state", F.lit("_"), F.lit("")))
    lines = R.nested_forecasts(f, P.trend_seasonal_forecast(f, 72), P.forecast_table(f))
    return R.read_forecasts(t.spark, written(lines, "text")).withColumn("peak_months", F.array_join("peak_months", ", "))


def _one_file_each(out):
    def run(batches):
        fs, root = FileSystem.from_uri(out)
        part, seen = f"{root}/part={TaskContext.get().partitionId()}", Counter()
        for batch in batches:
            for name, value in zip(batch.column("name").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if name is None:
                    raise ValueError("a file needs a name")
                folder = f"{part}/copy={seen[name]}"
                if not seen.total() or seen[name]:
                    fs.create_dir(folder, recursive=True)
                seen[name] += 1
                with fs.open_output_stream(f"{folder}/{name}") as f:
                    f.write((value or "").encode())
        yield pa.RecordBatch.from_pydict({"n": pa.array([seen.total()], pa.int64())})

    return run


def files_named(df):
    """A folder with one file per row of ``name`` and ``value``, written by the tasks.

    Equal names lie in folders of their own (of a task, and of the copy in it), so no row replaces another.
    """
    out = scratch_path(df.sparkSession, "files")
    fs, root = FileSystem.from_uri(out)
    fs.create_dir(root, recursive=True)
    df.select(F.col("name").cast("string"), F.col("value").cast("string")).mapInArrow(_one_file_each(out), "n long").agg(F.sum("n")).collect()
    return out


@query("read_documents", f"""
  SELECT 'item_' || item_id || '.md' AS name, trim(text, {TRIM}) AS text FROM benchmark WHERE trim(text, {TRIM}) <> ''""")
def _(t):
    items = t.table("benchmark").select(F.concat(F.lit("item_"), "item_id", F.lit(".md")).alias("name"), F.concat(F.lit("\n"), "text").alias("value"))
    return R.read_documents(t.spark, files_named(items))


@query("read_every_document", f"""
  SELECT 'doc_' || doc_id || '.md' AS name, trim(text, {TRIM}) AS text FROM documents WHERE trim(text, {TRIM}) <> ''""")
def _(t):
    docs = t.table("documents").select(F.concat(F.lit("doc_"), "doc_id", F.lit(".md")).alias("name"), F.col("text").alias("value"))
    return R.read_documents(t.spark, files_named(docs))


@query("read_profiles", "SELECT id, state, event_type, text, 'forecast' AS source FROM seasonal_texts", "seasonal_texts")
def _(t):
    return R.read_profiles(t.spark, written(seasonal_profiles(t).withColumn("source", F.lit("forecast")), "json"))


@query("read_optional", "SELECT s_suppkey, s_name FROM supplier")
def _(t):
    schema = t.table("supplier").select("s_suppkey", "s_name").schema
    missing = scratch_path(t.spark, "missing")
    found = R.read_optional(t.spark, [missing, f"{t.folder}/supplier.parquet"], schema)
    return found.unionByName(R.read_optional(t.spark, [missing], schema))


@query("write_table", """
  SELECT state, event_type, month, n FROM monthly""", "monthly")
def _(t):
    path = written(SP.monthly(t), "parquet", partition_by=["event_type"])
    return t.spark.read.schema(SP.monthly(t).schema).parquet(path).select("state", "event_type", "month", "n")


@query("event_props", "SELECT event_id, event_type, (props->>'$.k')::BIGINT AS k FROM events")
def _(t):
    """One path of the JSON column, cut out without parsing the rest."""
    return t.table("events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("event_fields", """
  SELECT f.field, count(*) AS n_rows, count(*) FILTER (WHERE json_type(props, '$.' || f.field) = 'NULL') AS n_null, 'BIGINT' AS type
  FROM events, unnest(json_keys(props)) AS f(field) GROUP BY f.field""")
def _(t):
    return K.json_fields(t.table("events").select("props"), "props")


@query("event_typed", "SELECT event_id, (props->>'$.k')::BIGINT AS k, CASE WHEN props IS NOT NULL THEN '{}' END AS rest FROM events")
def _(t):
    return K.typed_fields(t.table("events").select("event_id", "props"), "props", {"k": "bigint"}).drop("props")
