"""Queries that write tables to the shared folder in the formats of the sources and sinks, and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import replies
from ..functions import text as X
from ..operators import screening
from ..session import shared_dir, table
from ..sources import readers, writers
from .catalogue import query


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/exchange-{uuid.uuid4().hex}"


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


BASE = ["id", "source_text", "domain_subtype", "difficulty"]
EMPTIED = ", ".join(f"nullif({c}, '') AS {c}" for c in BASE)


@query(f"SELECT {', '.join(BASE)} FROM base_samples")
def q_json_array(spark, d):
    at = f"{_folder(spark)}/base.json"
    writers.write_json_array(table(spark, d, "base_samples").select(*BASE), at)
    return readers.read_json_array(spark, at, _strings(*BASE))


@query(f"SELECT {EMPTIED} FROM base_samples")
def q_csv(spark, d):
    """Strict field list; null and empty are the same in CSV."""
    at = _folder(spark)
    writers.write_csv(table(spark, d, "base_samples").select(*BASE), at, BASE)
    return readers.read_csv(spark, at).select(*BASE)


@query("SELECT id, nullif(difficulty, '') AS difficulty FROM base_samples")
def q_csv_lenient(spark, d):
    """Columns that aren't listed are left out."""
    at = _folder(spark)
    writers.write_csv(table(spark, d, "base_samples"), at, ["difficulty", "id"], strict=False)
    return readers.read_csv(spark, at).select("id", "difficulty")


@query("""SELECT s_suppkey, 0::BIGINT AS row_index, s_name AS name, 'x, ' || s_nationkey AS note FROM supplier
  UNION ALL SELECT s_suppkey, 1::BIGINT, 'say "' || s_name || '"', NULL FROM supplier""")
def q_csv_text(spark, d):
    """A small CSV made for each supplier in a column, parsed with its row index."""
    s = table(spark, d, "supplier")
    text = F.concat(F.lit("﻿name,note\n"), "s_name", F.lit(',"x, '), F.col("s_nationkey").cast("string"), F.lit('"\r\n\n"say ""'), "s_name", F.lit('""",\n'))
    return readers.read_csv_text(s.select("s_suppkey", text.alias("t")), "t", ["name", "note"], ["s_suppkey"])


@query("""SELECT r_name AS region, min((n_nationkey, n_name))[1]::VARCHAR AS n_nationkey, min((n_nationkey, n_name))[2] AS n_name, CASE WHEN n_regionkey % 2 = 0 THEN n_regionkey::VARCHAR END AS extra
  FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_regionkey""")
def q_first_rows(spark, d):
    """The first row of one summary per region, joined by column name; every other summary has a column more."""
    at, paths = _folder(spark), []
    for r in table(spark, d, "region").orderBy("r_regionkey").collect():
        own = table(spark, d, "nation").where(F.col("n_regionkey") == r.r_regionkey).orderBy("n_nationkey").withColumn("region", F.lit(r.r_name)).withColumn("extra", F.col("n_regionkey"))
        paths.append(f"{at}/{r.r_name.replace(' ', '_')}")
        writers.write_csv(own.coalesce(1), paths[-1], ["region", "n_nationkey", "n_name"] + ["extra"] * (r.r_regionkey % 2 == 0), strict=False)
    return readers.first_rows(spark, paths).select("region", "n_nationkey", "n_name", "extra")


@query("SELECT CASE WHEN doc_id % 2 = 1 THEN doc_id::VARCHAR ELSE 'made' END AS id, text, lang FROM documents")
def q_json_lines(spark, d):
    """Every other id is missing and made from the file's name and line."""
    at = _folder(spark)
    docs = table(spark, d, "documents").select(F.when(F.col("doc_id") % 2 == 1, F.col("doc_id").cast("string")).alias("id"), "text", "lang")
    writers.write_json_lines(docs, at)
    got = readers.read_json_lines(spark, at, _strings("id", "text", "lang"))
    return got.withColumn("id", F.when(F.col("id").rlike("^part-.*_[0-9]{8}$"), "made").otherwise(F.col("id")))


@query("SELECT doc_id::VARCHAR AS id, text FROM documents UNION ALL SELECT 'twice', text FROM documents WHERE doc_id % 10 = 0")
def q_json_lines_append(spark, d):
    at = _folder(spark)
    docs = table(spark, d, "documents")
    writers.write_json_lines(docs.select(F.col("doc_id").cast("string").alias("id"), "text"), at)
    writers.write_json_lines(docs.where("doc_id % 10 = 0").select(F.lit("twice").alias("id"), "text"), at, append=True)
    return readers.read_json_lines(spark, at, _strings("id", "text"))


SPACE = X.SPACE
COLLAPSED = f"trim(regexp_replace(text, '{SPACE}+', ' ', 'g'))"


@query(f"SELECT {COLLAPSED} AS text, true AS numbered FROM documents WHERE {COLLAPSED} <> ''")
def q_text_lines(spark, d):
    at = _folder(spark)
    writers.write_text_lines(table(spark, d, "documents"), "text", at)
    got = readers.read_text_lines(spark, at, "zh")
    return got.select("text", F.col("id").rlike("^zh_native_[0-9]{5,}$").alias("numbered"))


@query("SELECT lower(r_name) AS model, n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 <> 0")
def q_glob_names(spark, d):
    """One output per region, whose name comes back from the path; rows without a name are skipped."""
    at = _folder(spark)
    nation = table(spark, d, "nation")
    for r in table(spark, d, "region").collect():
        own = nation.where(F.col("n_regionkey") == r.r_regionkey).select("n_nationkey", F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")).alias("n_name"))
        writers.write_json_lines(own, f"{at}/ranked.{r.r_name.lower().replace(' ', '_')}.json")
    got = readers.with_name_part(spark.read.schema("n_nationkey int, n_name string").json(f"{at}/ranked.*.json"), r"/ranked\.([^/]+)\.json/", "model")
    return got.where("n_name is not null").select(F.replace("model", F.lit("_"), F.lit(" ")).alias("model"), "n_nationkey", "n_name")


@query("SELECT CASE WHEN n_regionkey % 2 = 0 THEN 'even' ELSE 'odd' END AS family, n_nationkey::VARCHAR AS n_nationkey FROM nation")
def q_glob_families(spark, d):
    at = _folder(spark)
    for i, family in enumerate(("even", "odd")):
        writers.write_csv(table(spark, d, "nation").where(F.col("n_regionkey") % 2 == i).select("n_nationkey"), f"{at}/p.{family}.pairwise.csv", ["n_nationkey"])
    got = readers.with_name_part(spark.read.option("header", True).csv(f"{at}/p.*.pairwise.csv"), r"/p\.([^/.]+)\.pairwise\.csv/", "family")
    return got.select("family", "n_nationkey")


@query("SELECT 'kept' AS model, r_regionkey::VARCHAR AS r_regionkey FROM region")
def q_path_map(spark, d):
    """A map of named files: one exists, one is missing, one is excluded."""
    at = _folder(spark)
    writers.write_csv(table(spark, d, "region").select("r_regionkey"), f"{at}/a", ["r_regionkey"])
    got = readers.read_existing(spark, lambda p: readers.read_csv(spark, p), {"kept": f"{at}/a", "gone": f"{at}/b", "own": f"{at}/a"}, exclude={"own"})
    return got.select("model", "r_regionkey")


FILES = ["b/two.csv", "a/ten.JSON", "a/one.csv", "c/three.txt", "c/p.cache.json"]


@query("SELECT * FROM (VALUES (0::BIGINT, 'a/one.csv', 'CSV'), (1, 'a/ten.JSON', 'JSON'), (2, 'b/two.csv', 'CSV'), (3, 'c/p.cache.json', 'JSON')) t(place, path, format)")
def q_list_files(spark, d):
    """The CSV and JSON files below a folder in the order of their paths, unread."""
    at = _folder(spark)
    for f in FILES:
        writers.write_text(spark, "{}\n", f"{at}/{f}")
    got = readers.list_files(spark, at).select(F.substring_index("path", at.rsplit("/", 1)[1] + "/", -1).alias("path"))
    got = screening.numbered(got, ["path"])
    return got.select(F.col("row_no").alias("place"), "path", F.upper(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("format"))


@query("SELECT kind, r_regionkey, r_name FROM region CROSS JOIN (VALUES ('array'), ('lines')) k(kind) UNION ALL SELECT 'object', r_regionkey, r_name FROM region WHERE r_regionkey = 0")
def q_json_or_lines(spark, d):
    """The same reader for an array, a single object over several lines, and JSON lines."""
    at, region = _folder(spark), table(spark, d, "region")
    schema = T.StructType([T.StructField("r_regionkey", T.IntegerType()), T.StructField("r_name", T.StringType())])
    writers.write_json_array(region, f"{at}/array.json")
    writers.write_json_lines(region, f"{at}/lines")
    one = region.where("r_regionkey = 0").first()
    writers.write_text(spark, f'\n{{\n "r_regionkey": {one.r_regionkey},\n "r_name": "{one.r_name}"\n}}\n', f"{at}/object.json")
    parts = [readers.read_auto(spark, f"{at}/{p}", schema).select(F.lit(kind).alias("kind"), "r_regionkey", "r_name") for kind, p in (("array", "array.json"), ("lines", "lines"), ("object", "object.json"))]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'late ' ELSE 'early ' END || c_name AS value FROM customer")
def q_cache(spark, d):
    """A cache that starts missing, is filled for two thirds of the keys, and gets the rest and some anew."""
    at, c = _folder(spark), table(spark, d, "customer")
    schema = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("value", T.StringType())])
    rows = c.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name")
    todo = rows.join(readers.read_cache(spark, at, schema, "c_custkey"), "c_custkey", "left_anti")
    writers.write_cache(todo.where("c_custkey % 3 <> 0 or c_custkey % 2 = 0").select("c_custkey", F.concat(F.lit("early "), "c_name").alias("value")), at, 1)
    todo = rows.join(readers.read_cache(spark, at, schema, "c_custkey"), "c_custkey", "left_anti").union(rows.where("c_custkey % 6 = 0"))
    writers.write_cache(todo.select("c_custkey", F.concat(F.lit("late "), "c_name").alias("value")), at, 2)
    return readers.read_cache(spark, at, schema, "c_custkey")


@query("SELECT doc_id FROM documents WHERE doc_id % 4 <> 0")
def q_resume_json_lines(spark, d):
    """Documents that an interrupted output, whose last line is broken, doesn't hold."""
    at = _folder(spark)
    docs = table(spark, d, "documents")
    writers.write_json_lines(docs.where("doc_id % 4 = 0").select("doc_id", "lang"), at)
    writers.write_text(spark, '{"doc_id": 1, "lang"\n', f"{at}/broken.json")
    done = readers.done_keys(spark, at, ["doc_id"], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType())]))
    return screening.not_done(docs.select("doc_id"), done, ["doc_id"])


@query("SELECT 'there' AS output, count(*) AS n FROM documents WHERE lang IS NOT NULL UNION ALL SELECT 'missing', 0")
def q_accepted_count(spark, d):
    at = _folder(spark)
    writers.write_json_lines(table(spark, d, "documents").where("lang is not null").select("doc_id"), at)
    return spark.createDataFrame([("there", readers.accepted_count(spark, at)), ("missing", readers.accepted_count(spark, at + "-none"))], "output string, n bigint")


@query("""SELECT doc_id, coalesce(text, '') <> '' AS usable, CASE WHEN coalesce(text, '') <> '' THEN 100 ELSE 0 END::INT AS score, CASE WHEN coalesce(text, '') <> '' THEN 'dry_run' ELSE 'reject' END AS category,
  CASE WHEN coalesce(text, '') <> '' THEN text ELSE '' END AS cleaned_text FROM documents""")
def q_dry_run_reviews(spark, d):
    """Every document reviewed by the provider that needs no network."""
    rows = readers.from_provider(table(spark, d, "documents").select("doc_id", "text"), "text", replies.with_retries(readers.dry_run))
    return rows.select("doc_id", "text", replies.review(F.col("response"), F.col("text")).alias("r")).select("doc_id", "r.usable", "r.score", "r.category", "r.cleaned_text")


@query("SELECT doc_id, 'good' AS output, NULL AS error FROM documents WHERE n_chars <= 1000 UNION ALL SELECT doc_id, 'dead', 'too long: ' || n_chars FROM documents WHERE n_chars > 1000")
def q_dead_letters(spark, d):
    at = _folder(spark)
    error = F.when(F.col("n_chars") > 1000, F.concat(F.lit("too long: "), F.col("n_chars").cast("string")))
    writers.split_errors(table(spark, d, "documents").select("doc_id", "text", error.alias("error")), "error", f"{at}/good", f"{at}/dead")
    schema = "doc_id bigint, error string"
    read = lambda kind: spark.read.schema(schema).json(f"{at}/{kind}").select("doc_id", F.lit(kind).alias("output"), "error")
    return read("good").union(read("dead"))


@query("SELECT doc_id % 5 AS bucket, 'json_decode' AS problem, count(*) AS n FROM documents WHERE doc_id % 5 = 1 GROUP BY ALL UNION ALL SELECT doc_id % 5, 'not_object', count(*) FROM documents WHERE doc_id % 5 = 2 GROUP BY ALL")
def q_poison_lines(spark, d):
    """Broken lines among good ones, by what is wrong with them."""
    at = _folder(spark)
    docs = table(spark, d, "documents")
    line = F.when(F.col("doc_id") % 5 == 1, F.concat(F.lit('{"bucket": '), F.col("doc_id") % 5)).when(F.col("doc_id") % 5 == 2, F.concat(F.lit("["), F.col("doc_id") % 5, F.lit("]"))).otherwise(F.to_json(F.struct((F.col("doc_id") % 5).alias("bucket"))))
    docs.select(line.alias("value")).write.text(at)
    bad = readers.malformed_lines(spark, at, T.StructType([T.StructField("bucket", T.LongType())]))
    return bad.groupBy(F.regexp_extract("line", "([0-9]+)", 1).cast("bigint").alias("bucket"), "problem").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS scanned, count(*) FILTER (WHERE n_chars <= 500) AS accepted, count(*) FILTER (WHERE n_chars > 500) AS rejected, 500 AS limit_chars, true AS timed FROM documents")
def q_run_metrics(spark, d):
    """The metrics record of a run, written and read back."""
    at = _folder(spark)
    rows = table(spark, d, "documents").withColumn("reason", F.when(F.col("n_chars") > 500, "length"))
    writers.run_metrics(rows, at, "reason", limit_chars=500)
    got = readers.read_json_array(spark, f"{at}/metrics.json", "scanned bigint, accepted bigint, rejected bigint, limit_chars int, started_utc string, finished_utc string")
    return got.select("scanned", "accepted", "rejected", "limit_chars", (F.col("started_utc") <= F.col("finished_utc")).alias("timed"))


@query("SELECT 'logistic' AS model, unnest(['diff_source_similarity', 'diff_entailment', 'diff_clause_depth', 'diff_log_perplexity']) AS feature, 0.01::DOUBLE AS l2")
def q_method_notes(spark, d):
    from ..operators import inference

    at = f"{_folder(spark)}/notes.json"
    writers.write_report(spark, [{"model": "logistic", "features": inference.FEATURES, "l2": inference.L2}], at)
    return readers.read_json_array(spark, at, "model string, features array<string>, l2 double").select("model", F.explode("features").alias("feature"), "l2")


@query("SELECT * FROM (VALUES ('a/one.csv', 'first/1.csv'), ('a/ten.JSON', 'first/ten.JSON'), ('b/two.csv', 'b/two.csv')) t(source, copied)")
def q_manifest(spark, d):
    """A manifest by ordered renames, caches left out; the copies are listed from the target."""
    at = _folder(spark)
    for f in FILES:
        writers.write_text(spark, f + "\n", f"{at}/in/{f}")
    rows = writers.manifest(readers.list_files(spark, f"{at}/in"), "", [("a/", "first/"), ("one", "1")])
    short = lambda c: F.regexp_replace(c, "^.*/in/", "")
    rows = rows.select("source_path", short("organised_path").alias("organised_path"))
    writers.copy_artifacts(spark, rows, f"{at}/out")
    copied = spark.read.text(f"{at}/out", recursiveFileLookup=True).select(F.col("value").alias("source"), F.regexp_replace(F.col("_metadata.file_path"), "^.*/out/", "").alias("copied"))
    return copied


@query("SELECT doc_id, lang FROM documents WHERE doc_id % 7 <> 3")
def q_stream_json_lines(spark, d):
    """Compressed JSON lines with broken ones among them, read as a stream."""
    at = _folder(spark)
    docs = table(spark, d, "documents").select("doc_id", "lang")
    line = F.when(F.col("doc_id") % 7 == 3, F.lit('{"doc_id": ')).otherwise(F.to_json(F.struct("doc_id", "lang")))
    docs.select(line.alias("value")).write.option("compression", "gzip").text(f"{at}/in")
    rows = readers.stream_json_lines(spark, f"{at}/in", T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType())]))
    run = rows.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{at}/out").select("doc_id", "lang")


@query("SELECT * FROM (SELECT 3 + row_number() OVER (ORDER BY r_regionkey) AS line, '| ' || r_regionkey || ' | ' || r_name || ' |' AS text FROM region) UNION ALL SELECT * FROM (VALUES (1::BIGINT, '# Regions'), (2, '| key | name |'), (3, '|-|-|')) t(line, text)")
def q_markdown_report(spark, d):
    at = f"{_folder(spark)}/report.md"
    rows = table(spark, d, "region").orderBy("r_regionkey").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    writers.write_markdown(rows, at, "Regions")
    return readers.read_lines_raw(spark, at).select(F.col("line_no").alias("line"), F.col("line").alias("text"))
