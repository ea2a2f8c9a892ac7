"""Readers and writers of the files between stages; no schema is ever inferred."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shockspan.functions.columns import strip, type_key
from shockspan.operators.impact import county_key
from shockspan.session import folder_address, stored
from shockspan.sources.arrays import read_json_array

DECLARATION_COLUMNS = [
    "event_id", "state", "level", "event_type", "title", "begin_on", "end_on", "state_code", "county_code", "area",
]
PERSONS = (
    "jobs array<struct<title string, started_at string, ended_at string, "
    "location_details struct<county_id string, locality string, region string>, company struct<name string, industry string>>>"
)
PREDICTIONS = (
    "id string, event_type string, county_id string, region string, text string, predictions map<string, "
    "struct<job_loss_pct double, job_change_pct double, recovery_months double, peak_month int, "
    "window_1_pct double, window_2_pct double, window_3_pct double>>"
)
FORECAST_ENTRY = (
    "map<string, struct<state string, event_type string, "
    "historical struct<dates array<string>, counts array<double>>, "
    "forecast struct<dates array<string>, predicted_counts array<double>, lower_bound array<double>, upper_bound array<double>>, "
    "model_info struct<cv_mae double, cv_rmse double, train_months int, forecast_horizon int, peak_months array<string>, "
    "total_historical bigint>>>"
)
PROFILES = "id string, state string, event_type string, text string, source string"


# Times in CSV keep their microseconds, and their zone where they have one.
CSV_TIMES = {
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]",
}


def read_csv_dates(spark: SparkSession, path: str, schema: T.StructType, **options) -> DataFrame:
    """CSV with a header; dates and times are parsed by the given schema.

    With a schema Spark matches columns by position, so it has to name the file's
    columns in order; ``select`` afterwards prunes the parse to what is used.
    """
    return spark.read.schema(schema).options(header=True, enforceSchema=False, **{**CSV_TIMES, **options}).csv(path)


def read_declarations(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Shock declarations: ten of the file's columns and the county key."""
    return read_csv_dates(spark, path, schema).select(*DECLARATION_COLUMNS).withColumn(
        "county_id", county_key(F.col("state_code"), F.col("county_code"))
    )


def read_objects(spark: SparkSession, path: str, schema: str, one_array: bool = False) -> DataFrame:
    """JSON objects, one per line; ``one_array`` for files that are one array each, read by byte ranges."""
    return read_json_array(spark, path, schema) if one_array else spark.read.schema(schema).json(path)


def read_persons(spark: SparkSession, path: str, one_array: bool = False) -> DataFrame:
    """Employment histories, one person per line or all in one array."""
    return read_objects(spark, path, PERSONS, one_array)


def read_predictions(spark: SparkSession, path: str, states: DataFrame, one_array: bool = False) -> DataFrame:
    """Scenario predictions with their sector map as rows; state by key prefix.

    ``states`` maps the two-character prefix to a state; unknown prefixes give ''.
    """
    rows = read_objects(spark, path, PREDICTIONS, one_array)
    rows = rows.select("county_id", "event_type", F.coalesce("region", "county_id").alias("region"), F.explode("predictions").alias("sector", "p"))
    found = rows.withColumn("prefix", F.substring("county_id", 1, 2)).join(states.select("prefix", F.col("state").alias("_s")), "prefix", "left")
    return found.select(
        "county_id", F.coalesce("_s", F.lit("")).alias("state"), "event_type", "region", "sector",
        "p.job_loss_pct", "p.job_change_pct", "p.recovery_months", "p.peak_month",
    )


def forecast_rows(text: DataFrame, column: str = "value") -> DataFrame:
    """Forecast objects keyed state_type as rows of the serving table."""
    entries = text.select(F.explode(F.from_json(column, FORECAST_ENTRY)).alias("key", "e")).filter(F.contains("key", F.lit("_")))
    first = F.slice("e.forecast.predicted_counts", 1, 12)
    total = F.aggregate(first, F.lit(0.0), lambda a, x: a + x)
    return entries.select(
        F.regexp_extract("key", "^([^_]+)_(.*)$", 1).alias("state"),
        type_key(F.regexp_extract("key", "^([^_]+)_(.*)$", 2)).alias("event_type"),
        F.coalesce("e.model_info.total_historical", F.lit(0)).alias("total_historical"),
        F.coalesce("e.model_info.peak_months", F.array().cast("array<string>")).alias("peak_months"),
        F.when(F.size(first) > 0, F.round(total / F.size(first), 3)).otherwise(0.0).alias("avg_next_12"),
        F.col("e.model_info.cv_mae").alias("cv_mae"),
    )


def read_forecasts(spark: SparkSession, path: str, one_object: bool = False) -> DataFrame:
    """Forecast entries, one JSON object per line (or per file with ``one_object``)."""
    return forecast_rows(spark.read.text(path, wholetext=one_object))


#: Files that a task reads, about, and bytes of texts that it hands on at a time.
FILES_PER_TASK, BYTES_AT_ONCE = 4096, 8 << 20


def hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    if name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


def escaped(name: str) -> str:
    """The name as Spark gives it in ``_metadata.file_name``: what may not stand in an address as % and its bytes."""
    return "".join(c if _stays(c) else "".join(f"%{b:02X}" for b in c.encode()) for c in name)


def _stays(c: str) -> bool:
    return c.isalnum() or c in "_-!.~'()*,;:$&+=@" if c.isascii() else unicodedata.category(c)[0] != "Z" and unicodedata.category(c) != "Cc"


def _listed(address: str):
    """What stands in every folder: its files, and the folders of the form key=value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = FileSystem.from_uri(address)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found = [f for f in fs.get_file_info(FileSelector(path)) if not hidden(f.base_name) and (f.is_file or "=" in f.base_name)]
                columns = [[f.path for f in found], [f.base_name for f in found], [not f.is_file for f in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.bool_()), strict=True)], names=["path", "name", "folder"])

    return run


def _contents(address: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = FileSystem.from_uri(address)

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.binary())], names=["name", "value"])

        for batch in batches:
            names, texts, held = [], [], 0
            for path, name in zip(batch.column("path").to_pylist(), batch.column("name").to_pylist(), strict=True):
                with fs.open_input_stream(path) as f:
                    text = f.read()
                if texts and held + len(text) > BYTES_AT_ONCE:
                    yield made()
                    names, texts, held = [], [], 0
                names.append(escaped(name))
                texts.append(text)
                held += len(text)
            yield made()

    return run


def files_of(spark: SparkSession, address: str, glob: str) -> DataFrame:
    """path and name of every file whose name fits ``glob``; a job per depth of folders, nothing is listed by the driver."""
    level, parts, found = spark.createDataFrame([(FileSystem.from_uri(address)[1],)], "path string"), 1, []
    while parts:
        listed = stored(level.repartition(min(parts, FILES_PER_TASK)).mapInArrow(_listed(address), "path string, name string, folder boolean"), "listed")
        found.append(listed.filter("NOT folder").select("path", "name"))
        level = listed.filter("folder").select("path")
        parts = level.count()
    pattern = spark._jvm.org.apache.hadoop.fs.GlobPattern.compile(glob).pattern()  # as pathGlobFilter reads it
    return reduce(DataFrame.union, found).filter(F.col("name").rlike(rf"(?s)\A(?:{pattern})\z"))


def read_documents(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """Whole text files with their names; empty ones are skipped.

    Files are many and small, so tasks list the folders and read the files: Spark's reader
    would hold every file's status and place in the driver. It reads what is no folder
    (patterns, single files) and file systems that only Spark knows.
    """
    address = folder_address(spark, path)
    if address is None:
        files = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value")
    else:
        files = files_of(spark, address, glob)
        n = files.count()
        parts = max(-(-n // FILES_PER_TASK), min(n, spark.sparkContext.defaultParallelism), 1)
        files = files.repartition(parts).mapInArrow(_contents(address), T.StructType([T.StructField("name", T.StringType(), False), T.StructField("value", T.BinaryType())])).withColumn("value", F.col("value").cast("string"))
    rows = files.select("name", strip(F.col("value")).alias("text"))
    return rows.filter(F.length("text") > 0)


def read_profiles(spark: SparkSession, path: str, one_array: bool = False) -> DataFrame:
    return read_objects(spark, path, PROFILES, one_array)


def read_optional(spark: SparkSession, paths: list[str], schema: T.StructType, fmt: str = "parquet", **options) -> DataFrame:
    """The first path that exists, else an empty table of the schema."""
    for path in paths:
        try:
            return spark.read.schema(schema).options(**options).format(fmt).load(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return spark.createDataFrame([], schema)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, mode: str = "errorifexists", **options) -> None:
    """Write a stage. CSV gets a header and keeps empty text apart from null."""
    writer = df.write.mode(mode).format(fmt).options(**options)
    if fmt == "csv":
        writer = writer.options(header=True, emptyValue='""', **CSV_TIMES)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def nested_predictions(scenarios: DataFrame, texts: DataFrame) -> DataFrame:
    """Scenario rows as one object per scenario with a map of its sectors."""
    values = ["job_loss_pct", "job_change_pct", "recovery_months", "peak_month", "window_1_pct", "window_2_pct", "window_3_pct"]
    entry = F.struct("sector", F.struct(*values).alias("v"))
    maps = scenarios.groupBy("event_type", "county_id").agg(F.map_from_entries(F.collect_list(entry)).alias("predictions"))
    return texts.join(maps, ["event_type", "county_id"]).select("id", "event_type", "county_id", "region", "text", "predictions")


def nested_forecasts(history: DataFrame, forecast: DataFrame, table: DataFrame) -> DataFrame:
    """One object per series under its key, as a JSON line.

    The arrays hold one entry per month of the calendar or the horizon.
    """
    keys = ["state", "event_type"]

    def field(name):
        return lambda row: row[name]

    def arrays(df, **cols):
        entry = F.struct("month", *[F.col(c).cast("double").alias(n) for n, c in cols.items()])
        grouped = df.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("rows"))
        dates = F.transform("rows", lambda r: F.date_format(r["month"], "yyyy-MM")).alias("dates")
        values = [F.transform("rows", field(n)).alias(n) for n in cols]
        return grouped.select(*keys, F.struct(dates, *values).alias("a"))

    past = arrays(history, counts="n").withColumnRenamed("a", "historical")
    ahead = arrays(forecast, predicted_counts="predicted", lower_bound="lower", upper_bound="upper").withColumnRenamed("a", "forecast")
    info = F.struct("cv_mae", "cv_rmse", "train_months", "forecast_horizon", "peak_months", "total_historical").alias("model_info")
    rows = table.select(*keys, info).join(past, keys).join(ahead, keys)
    key = F.concat_ws("_", "state", F.replace("event_type", F.lit(" "), F.lit("_")))
    return rows.select(F.to_json(F.create_map(key, F.struct(*keys, "historical", "forecast", "model_info"))).alias("value"))
