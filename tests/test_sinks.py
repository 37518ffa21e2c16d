"""Logs, results and fixtures as files."""

import json

import pytest

from ledgerloom.sources import files


def test_a_log_grows_and_fails_open(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\n\"b"), (2, None)], "id long, text string")
    path = str(tmp_path / "log")
    assert files.append_log(df, path) and files.append_log(df.where("id = 1"), path)
    assert sorted(map(tuple, files.read_fixture(spark, path, "id long, text string", lines=True).collect()), key=repr) == [(1, "a\n\"b"), (1, "a\n\"b"), (2, None)]
    blocked = tmp_path / "file"
    blocked.write_text("in the way")
    assert files.append_log(df, f"{blocked}/log", fail_open=True) is False
    with pytest.raises(Exception, match="."):
        files.append_log(df, f"{blocked}/log")
    assert blocked.read_text() == "in the way"


def test_one_result_per_run(spark, tmp_path):
    df = spark.range(100).repartition(8)
    files.write_job_result(df.selectExpr("count(*) as n"), str(tmp_path / "run-1"))
    assert [p.suffix for p in (tmp_path / "run-1").iterdir() if p.name.startswith("part-")] == [".json"]
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_job_result(df.selectExpr("count(*) as n"), str(tmp_path / "run-1"))


def test_a_fixture_gives_the_fields_that_are_named(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps([{"a": 1, "b": {"c": "x"}, "d": 2}, {"b": None}, {"a": 3}], indent=1))
    rows = files.read_fixture(spark, str(tmp_path / "f.json"), "a long, b struct<c:string>").collect()
    assert [(r.a, r.b and r.b.c) for r in rows] == [(1, "x"), (None, None), (3, None)]
