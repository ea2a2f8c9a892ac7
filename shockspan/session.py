"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow.fs import FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("shockspan")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SHOCKSPAN_DRIVER_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        # generated methods above this size are never compiled by the JVM's JIT
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.checkpoint.dir", own_folder())
        .getOrCreate()
    )


_own: tempfile.TemporaryDirectory | None = None


def own_folder() -> str:
    """A private folder of this process, removed with all stages in it when it ends."""
    global _own
    _own = _own or tempfile.TemporaryDirectory(prefix="shockspan-", ignore_cleanup_errors=True)
    return _own.name


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their tasks can import it."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(dir=own_folder()), "package"), "zip", os.path.dirname(package), os.path.basename(package))
        context.addPyFile(archive)
        _shipped.add(context.applicationId)


def compiled(spark: SparkSession) -> None:
    """Keep generated methods to the size that the JVM compiles, where the session says nothing else.

    Wide rows run interpreted otherwise; Spark then takes its own way of smaller methods.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(name) == "65535":  # Spark's default
        spark.conf.set(name, "8000")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: the session's ``spark.checkpoint.dir``.

    Only a session of one machine that names none, as in tests, gets a private folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return own_folder()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark's setting by which what a job has shuffled is deleted when the job ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """What a write in here shuffles goes as soon as its table stands, not when the driver next collects garbage."""
    before = spark.conf.get(CLEANUP, None)
    if spark.conf.isModifiable(CLEANUP):
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is not None:
            spark.conf.set(CLEANUP, before)
        elif spark.conf.isModifiable(CLEANUP):
            spark.conf.unset(CLEANUP)


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a stage as a table and read it back: short lineage, survives executors."""
    path = scratch_path(df.sparkSession, name)
    with shuffles_go(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folder_address(spark: SparkSession, path: str) -> str | None:
    """The folder as an address that tasks can read themselves; None where only Spark can, or where it is no folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    address = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(where).toUri().toString()
    try:
        fs, root = FileSystem.from_uri(address)
        return address if fs.get_file_info(root).type == FileType.Directory else None
    except (pa.ArrowInvalid, OSError):
        return None
