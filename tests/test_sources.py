from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from strataforge.sources import files, sinks


def test_jsonl_modes(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n\n{"a": 2}\n{"a": \n')
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST|parse"):
        files.jsonl(spark, str(p), "a int").collect()
    assert files.jsonl(spark, str(tmp_path / "none"), "a int", missing_ok=True).count() == 0
    row = files.line_counts(files.jsonl_lines(spark, str(p))).first()
    assert (row.n_valid, row.n_invalid) == (2, 1)


def test_markdown(spark):
    text = "# One\n| id | verdict |\n|---|---|\n| 1 | PASS |\n## Two\n| 2 | FIX |\n```json\n{}\n```\n"
    df = spark.createDataFrame([(1, text)], "id int, t string")
    assert [(r.heading, r.cells) for r in files.markdown_rows(df, "id", "t").orderBy("line").collect()] == [("One", ["id", "verdict"]), ("One", ["1", "PASS"]), ("Two", ["2", "FIX"])]
    assert files.fenced_blocks(df, "id", "t").first().content == "{}"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\tb"), (2, "c")], "id int, t string")
    sinks.tsv(df, str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).where("value = '1\ta b'").count() == 1
    sinks.routed(df, str(tmp_path / "r"), F.when(F.col("id") == 1, "kept").otherwise("failed"))
    assert spark.read.json(str(tmp_path / "r")).groupBy("route").count().count() == 2
    assert json.loads(sinks.manifest(df, {"rows": F.count("*")})) == {"rows": 2}
    sinks.write_text(spark, str(tmp_path / "m.json"), "x")
    assert (tmp_path / "m.json").read_text() == "x"


def test_documents_and_code(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text('{"k": 1}')
    (tmp_path / "y.json").write_text("{")
    assert {r.record is None for r in files.documents(spark, str(tmp_path)).select(F.col("record").isNull().alias("n"), F.expr("to_json(record)").alias("record")).collect()} == {True, False}
    assert files.code_statistics(spark, str(tmp_path), "*.json").agg(F.sum("files")).first()[0] == 2
