"""Files of single documents: none lost, each under its own name."""

from pyspark.sql import functions as F

from shockspan.operators import text as X
from shockspan.plans import catalog
from shockspan.plans.source_plans import files_named
from shockspan.sources import readers


def test_files_of_equal_names_are_all_kept(spark):
    rows = [("a.md", "one"), ("b.md", "two"), ("a.md", "three"), ("a.md", "one"), ("c.md", "  "), ("d.md", None)]
    df = spark.createDataFrame(rows, "name string, value string")
    for parts in (1, 4):
        got = readers.read_documents(spark, files_named(df.repartition(parts))).collect()
        assert sorted((r.name, r.text) for r in got) == [("a.md", "one"), ("a.md", "one"), ("a.md", "three"), ("b.md", "two")]
    assert readers.read_documents(spark, files_named(df.limit(0))).count() == 0


def test_every_document_is_read_from_a_file_of_its_own(spark):
    folder = "/root/testdata/sf0.001"
    docs = {f"doc_{r.doc_id}.md" for r in spark.read.parquet(f"{folder}/documents.parquet").collect() if (r.text or "").strip()}
    got = [r.name for r in catalog.QUERIES["read_every_document"](spark, folder).collect()]
    assert len(got) == len(docs) and set(got) == docs


def test_upsert_touches_only_the_folders_of_its_keys(spark, tmp_path):
    path = str(tmp_path / "table")
    X.create_keyed(spark.range(200).select(F.col("id"), F.lit("old").alias("v"), F.lit(None).cast("int").alias("n")), path, "id", 16)

    def files():
        return {p: p.stat().st_mtime_ns for p in (tmp_path / "table").rglob("*.parquet")}

    before = files()
    batch = spark.createDataFrame([(3, "a", 1, 1), (3, "b", 2, 2), (3, "c", 3, 0), (500, "new", None, 7), (None, "null", 0, 0)], "id long, v string, n int, seq int")
    X.upsert_keyed(spark, path, batch, "id", "seq", 16)
    want = {i: ("old", None) for i in range(200)} | {3: ("b", 2), 500: ("new", None), None: ("null", 0)}
    rows = spark.read.parquet(path).collect()
    assert {r.id: (r.v, r.n) for r in rows} == want and len(rows) == len(want)
    touched = {r.part for r in X.parted(batch, "id", 16).collect()}
    after = files()
    for p, at in before.items():
        assert (after.get(p) == at) == (int(p.parent.name.split("=")[1]) not in touched)
    X.upsert_keyed(spark, path, batch, "id", "seq", 16)
    assert sorted(map(str, spark.read.parquet(path).collect())) == sorted(map(str, rows))
    kept = files()
    X.upsert_keyed(spark, path, batch.limit(0), "id", "seq", 16)
    assert files() == kept
