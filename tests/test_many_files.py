"""Tasks list and read the files of documents: the plan holds no file of theirs, and the rows are those of Spark's reader."""

from pyspark.sql import functions as F

from shockspan.functions.columns import strip
from shockspan.sources import readers


def test_files_are_neither_listed_nor_planned_by_the_driver(spark, tmp_path):
    for k in range(3):
        folder = tmp_path / f"part={k}" / "copy=0"
        folder.mkdir(parents=True)
        for i in range(100):
            (folder / f"d {k}%{i}.md").write_bytes(f"  text {k} {i}\n".encode())
    (folder / "é\u00a0ü #?;[x]@~^'.md").write_bytes(b"x")
    (folder / "odd.md").write_bytes(b"caf\xe9 \xff")
    (folder / "empty.md").write_bytes(b" \n")
    (folder / ".hidden.md").write_bytes(b"no")
    (folder / "_hidden.md").write_bytes(b"no")
    (folder / "other.txt").write_bytes(b"no")
    for glob in ("*.md", "{d,o}*[!t].m?", "none"):
        got = readers.read_documents(spark, str(tmp_path), glob)
        assert not [f for f in got.inputFiles() if f.endswith(".md")]
        files = spark.read.option("pathGlobFilter", glob).text(str(tmp_path), wholetext=True)
        want = files.select(F.col("_metadata.file_name").alias("name"), strip(F.col("value")).alias("text")).filter(F.length("text") > 0)
        rows = [sorted((r.name, bytes(r.b)) for r in df.select("name", F.col("text").cast("binary").alias("b")).collect()) for df in (got, want)]
        assert rows[0] == rows[1] and len(rows[0]) == {"*.md": 302, "none": 0}.get(glob, len(rows[0]))
        assert got.schema == want.schema


def test_folders_without_a_key_and_single_files(spark, tmp_path):
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "b.md").write_text("b")
    (tmp_path / "a.md").write_text("a")
    assert [tuple(r) for r in readers.read_documents(spark, str(tmp_path)).collect()] == [("a.md", "a")]
    assert [tuple(r) for r in readers.read_documents(spark, str(tmp_path / "a.md")).collect()] == [("a.md", "a")]
    assert sorted(tuple(r) for r in readers.read_documents(spark, f"{tmp_path}/*").collect()) == [("a.md", "a"), ("b.md", "b")]
