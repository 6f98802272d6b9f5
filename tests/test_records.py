"""Readers of record folders and trees."""

from __future__ import annotations

import json

import pytest

from larkspur.sources import records


def test_json_documents(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.json").write_text(json.dumps({"key": i, "error": "x" if i == 1 else None}, indent=1))
    got = records.json_documents(spark, str(tmp_path), "key int, error string")
    good, bad = records.without_errors(got)
    assert sorted(r["file"] for r in good.collect()) == ["0.json", "2.json"] and bad.count() == 1


def test_json_lines_must_be_well_formed(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert records.json_lines(spark, str(tmp_path), "a int").count() == 2
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{oops\n')
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        records.json_lines(spark, str(tmp_path), "a int").collect()


def test_source_tree_leaves_tests_out(spark, tmp_path):
    for name in ("a.go", "a_test.go", "b/c.ts", "b/c.test.ts", "node_modules/d.ts", "e.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("text\n")
    got = records.source_tree(spark, str(tmp_path)).collect()
    assert sorted(r["path"].rpartition("/")[2] for r in got) == ["a.go", "c.ts"] and got[0]["bytes"] == 5


def test_a_missing_partner_is_an_error(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "k int, v string")
    assert records.required(left.where("k = 1"), right, ["k"]).count() == 1
    with pytest.raises(Exception, match="no record for 2"):
        records.required(left, right, ["k"]).collect()
