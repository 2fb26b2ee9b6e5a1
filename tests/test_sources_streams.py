import gzip
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.operators.screening import Rules, reject_reason
from rankloom.sources import readers, writers
from rankloom.streaming import screen

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType())])


def test_json_lines_and_arrays(spark, tmp_path):
    lines = ['{"id": "a", "text": "x"}', "", '{"text": "y"}', "[1]", '{"id": broken']
    (tmp_path / "part.jsonl").write_text("\n".join(lines), encoding="utf-8")
    with gzip.open(tmp_path / "zipped.jsonl.gz", "wt", encoding="utf-8") as f:
        f.write('{"id": "g", "text": "z"}\n')
    got = {r.text: r.id for r in readers.read_json_lines(spark, f"{tmp_path}/part.jsonl", SCHEMA).where("text is not null").collect()}
    assert got == {"x": "a", "y": "part_00000002"}
    assert readers.read_json_lines(spark, f"{tmp_path}/zipped.jsonl.gz", SCHEMA).first().id == "g"
    assert sorted(r.problem for r in readers.malformed_lines(spark, f"{tmp_path}/part.jsonl", SCHEMA).collect()) == ["json_decode", "not_object"]
    (tmp_path / "array.json").write_text("﻿" + json.dumps([{"id": "1", "text": "中"}], indent=2), encoding="utf-8")
    assert readers.read_auto(spark, f"{tmp_path}/array.json", SCHEMA).first().text == "中"
    assert readers.read_auto(spark, f"{tmp_path}/zipped.jsonl.gz", SCHEMA).first().text == "z"
    assert readers.done_keys(spark, f"{tmp_path}/missing", ["id"], SCHEMA).count() == 0
    assert readers.done_keys(spark, f"{tmp_path}/part.jsonl", ["id"], SCHEMA).count() == 1


def test_csv_text_and_listing(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿name,n\n"x, y",01\nz,2\n', encoding="utf-8")
    df = readers.read_csv(spark, f"{tmp_path}/a.csv")
    assert df.columns == ["name", "n"] and {(r.name, r.n) for r in df.collect()} == {("x, y", "01"), ("z", "2")}
    assert readers.first_rows(spark, [f"{tmp_path}/a.csv"]).first().n == "01"
    (tmp_path / "l.txt").write_text(" one \n\ntwo  three\n", encoding="utf-8")
    assert [(r.id, r.text) for r in readers.read_text_lines(spark, f"{tmp_path}/l.txt", "en").orderBy("id").collect()] == [("en_native_00001", "one"), ("en_native_00002", "two three")]
    assert readers.list_files(spark, str(tmp_path)).count() == 1
    both = readers.read_existing(spark, lambda p: readers.read_csv(spark, p), {"m": f"{tmp_path}/a.csv", "gone": f"{tmp_path}/b.csv", "own": f"{tmp_path}/a.csv"}, exclude={"own"})
    assert {r.model for r in both.collect()} == {"m"}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", " 中\n文 ", None), ("b", " ", "bad")], "id string, text string, error string")
    assert writers.write_json_lines(df, f"{tmp_path}/j") == 2 and writers.write_json_lines(df, f"{tmp_path}/j", append=True) == 2
    assert spark.read.json(f"{tmp_path}/j").count() == 4
    assert writers.write_text_lines(df, "text", f"{tmp_path}/t") == 1 and spark.read.text(f"{tmp_path}/t").first().value == "中 文"
    with pytest.raises(ValueError):
        writers.write_csv(df, f"{tmp_path}/c", ["id"])
    assert writers.write_csv(df, f"{tmp_path}/c", ["error", "id"], strict=False) == 2
    assert readers.read_csv(spark, f"{tmp_path}/c").columns == ["error", "id"]
    assert writers.split_errors(df, "error", f"{tmp_path}/good", f"{tmp_path}/bad") == (1, 1)
    writers.write_report(spark, [{"文": 1}], f"{tmp_path}/r.json")
    assert json.loads((tmp_path / "r.json").read_text(encoding="utf-8")) == [{"文": 1}]


def test_provider(spark):
    df = spark.createDataFrame([("x",), (None,)], "text string")
    got = {r.text: json.loads(r.response)["usable"] for r in readers.from_provider(df, "text", readers.dry_run).collect()}
    assert got == {"x": True, None: False}


def test_stream_equals_batch_and_resumes(spark, small, tmp_path):
    rules = Rules(min_cjk=0.0, min_marks=0)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars", "category", "published_at", "fetched_at")
    docs.where("doc_id % 2 = 0").coalesce(1).write.parquet(f"{tmp_path}/in/a")
    out = f"file://{tmp_path}/out"
    first = screen.screen_stream(spark, f"{tmp_path}/in", out, rules)
    docs.where("doc_id % 2 = 1").coalesce(1).write.parquet(f"{tmp_path}/in/b")
    second = screen.screen_stream(spark, f"{tmp_path}/in", out, rules)
    assert first["rows_read"] + second["rows_read"] == docs.where("text is not null").count()
    assert screen.screen_stream(spark, f"{tmp_path}/in", out, rules)["rows_read"] == 0
    got = spark.read.parquet(f"{out}/accepted").union(spark.read.parquet(f"{out}/rejected"))
    assert got.count() == got.select("dedupe_key").distinct().count()
    again = got.withColumn("r", reject_reason(F.col("text"), rules))
    assert again.where("not (r <=> reject_reason)").count() == 0


def test_registered_queries(spark, small):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert isinstance(entry.entry(spark).toPandas(), pd.DataFrame)


def test_line_numbers_of_text_lines_are_never_cut(spark, tmp_path):
    (tmp_path / "l.txt").write_text("x\n" * 100_001)
    ids = {r.id for r in readers.read_text_lines(spark, f"{tmp_path}/l.txt", "en").collect()}
    assert len(ids) == 100_001 and {"en_native_00001", "en_native_100001"} <= ids
