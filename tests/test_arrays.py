"""Large JSON arrays: the same rows for any cut of the file into splits."""

import json
import random

import pytest

from shockspan.sources import arrays, readers

SPLIT_BYTES = "spark.sql.files.maxPartitionBytes"
SCHEMA = "id int, text string, list array<struct<a string>>, deep struct<b struct<c string>>"


@pytest.fixture
def split_size(spark):
    names = {SPLIT_BYTES: None, "spark.sql.files.openCostInBytes": None}
    names = {n: spark.conf.get(n) for n in names}

    def set_size(n):
        spark.conf.set(SPLIT_BYTES, str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield set_size
    for n, v in names.items():
        spark.conf.set(n, v)


def objects(n, seed=5):
    rng = random.Random(seed)
    marks = ['"', "\\", "{", "}", "[", "]", "}]", '\\"', "},{", "\n", "é", "🙂", "plain words", '{"id": 9}', "\\\\"]
    text = lambda: "".join(rng.choice(marks) for _ in range(rng.randint(0, 12)))
    return [
        {"id": i, "text": text() * (400 if i == n // 2 else 1), "list": [{"a": text()} for _ in range(rng.randint(0, 3))], "deep": {"b": {"c": text()}}}
        for i in range(n)
    ]


def read(spark, path):
    return sorted((r.asDict(True) for r in arrays.read_json_array(spark, str(path), SCHEMA).collect()), key=lambda r: r["id"])


@pytest.mark.parametrize("style", [{}, {"indent": 2}, {"separators": (",", ":"), "ensure_ascii": False}])
def test_rows_do_not_depend_on_the_splits(spark, tmp_path, split_size, style):
    rows = objects(60)
    for f in range(2):
        (tmp_path / f"{f}.json").write_text(json.dumps(rows[f::2], **style), encoding="utf-8")
    for size in (10**7, 3000, 211, 64):
        split_size(size)
        assert read(spark, tmp_path) == rows


def test_one_byte_splits(spark, tmp_path, split_size):
    rows = objects(3, seed=8)[:1] + [{"id": 7, "text": '}{"', "list": [], "deep": None}]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    split_size(1)
    assert read(spark, tmp_path) == rows


def test_equal_to_the_whole_file_reader(spark, tmp_path, split_size):
    rows = objects(40)
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=1))
    split_size(500)
    got = arrays.read_json_array(spark, str(tmp_path), SCHEMA)
    assert arrays.array_records(spark, str(tmp_path)).rdd.getNumPartitions() > 4
    want = spark.read.schema(SCHEMA).json(str(tmp_path), multiLine=True)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_odd_files(spark, tmp_path, split_size):
    split_size(16)
    for i, text in enumerate(["[]", "", " [ ] \n", "[1, null, \"{\"]"]):
        (tmp_path / f"{i}.json").write_text(text)
    assert read(spark, tmp_path) == []
    mixed = [["x", {"id": 5}, [{"id": 6}]], {"id": 1}, "}{", 3, {"id": 2}, [[{"id": 7}] * 9], {"id": 3}, {}]
    (tmp_path / "mixed.json").write_text(json.dumps(mixed))
    for size in (5, 16, 50, 10**6):
        split_size(size)
        got = [r.id for r in arrays.read_json_array(spark, str(tmp_path), SCHEMA).collect()]
        assert sorted(got, key=str) == [1, 2, 3, None]


def test_persons_of_one_array(spark, tmp_path, split_size):
    people = [{"jobs": [{"title": f"t{i} }}", "company": {"name": "[x"}}] * (i % 3)} for i in range(50)]
    (tmp_path / "p.json").write_text(json.dumps(people))
    split_size(300)
    got = readers.read_persons(spark, str(tmp_path), one_array=True)
    assert sorted(len(r.jobs) for r in got.collect()) == sorted(i % 3 for i in range(50))
