"""What the reader of large arrays shuffles and sorts."""

import json

from shockspan.sources import arrays


def test_array_records_stay_where_they_are_scanned(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": i, "t": "}{"} for i in range(30)]))
    got = arrays.array_records(spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "monotonically_increasing_id" not in plan
    assert got.count() == 30


def test_escapes_before_quotes_and_braces(spark, tmp_path):
    rows = [{"id": i, "t": "\\" * i + '"}' * (i % 3)} for i in range(12)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    got = arrays.read_json_array(spark, str(tmp_path), "id int, t string").collect()
    assert sorted((r.id, r.t) for r in got) == [(r["id"], r["t"]) for r in rows]
