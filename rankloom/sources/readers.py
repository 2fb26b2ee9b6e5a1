"""Sources: JSON arrays, JSON lines, CSV, text lines, globs, directory listings, checkpoints, providers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import collapse, padded
from ..operators.screening import numbered

BOM = "\ufeff"


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Files that each hold one JSON array (or one object); a leading byte-order mark is skipped by the parser.

    One file is one task; data that outgrows a file belongs in JSON lines.
    """
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType, id_column: str = "id") -> DataFrame:
    """Plain or gzip JSON lines; malformed and non-object lines are dropped, a missing id becomes <file>_<row>.

    Rows are numbered within their file in the order the splits are read.
    """
    lines = read_lines_raw(spark, path)
    got = lines.withColumn("r", F.from_json("line", schema, {"mode": "PERMISSIVE"})).where(F.col("line").rlike(r"^\s*\{.*\}\s*$") & F.col("r").isNotNull())
    if id_column not in schema.fieldNames():
        return got.select("r.*")
    made = F.format_string("%s_%08d", stem(F.col("file")), F.col("line_no"))
    rest = [F.col(f"r.{c}").alias(c) for c in schema.fieldNames() if c != id_column]
    return got.select(F.coalesce(F.col(f"r.{id_column}").cast("string"), made).alias(id_column), *rest)


def malformed_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(file, line_no, line, problem): the rows read_json_lines leaves out, for a dead-letter sink."""
    lines = read_lines_raw(spark, path)
    problem = F.when(~F.col("line").rlike(r"^\s*\{"), "not_object").when(F.try_parse_json("line").isNull(), "json_decode")
    return lines.withColumn("problem", problem).where("problem is not null")


def read_lines_raw(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line): non-blank lines, numbered from 1 across the files in path order."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    lines = lines.where(F.trim("line") != "")
    return numbered(lines, ["file", "block", "at"]).select("file", (F.col("row_no") + 1).alias("line_no"), "line")


def read_text_lines(spark: SparkSession, path: str, language: str) -> DataFrame:
    """(id, text): trimmed non-blank lines with ids <language>_native_<n>."""
    lines = read_lines_raw(spark, path)
    return lines.select(F.concat(F.lit(f"{language}_native_"), padded(F.col("line_no"), 5)).alias("id"), collapse(F.col("line")).alias("text"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; a byte-order mark before the first header name is removed."""
    df = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)
    first = df.columns[0] if df.columns else ""
    return df.withColumnRenamed(first, first.lstrip(BOM)) if first.startswith(BOM) else df


def first_rows(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first data row of each CSV, joined by column name."""
    out = None
    for p in paths:
        row = read_csv(spark, p).limit(1).withColumn("source_file", F.lit(p))
        out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    if out is None:
        raise ValueError("no paths")
    return out


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?(?:\.gz)?$", 1)


def with_name_part(df: DataFrame, pattern: str, column: str) -> DataFrame:
    """Adds the part of the file name that the pattern's first group matches, such as a judge or feature family."""
    return df.withColumn(column, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def read_existing(spark: SparkSession, read: Callable[[str], DataFrame], paths: dict[str, str], exclude: set[str] = frozenset(), column: str = "model") -> DataFrame | None:
    """Union of the named files that exist, tagged with their name; excluded names aren't opened."""
    out = None
    for name, path in paths.items():
        if name in exclude or not exists(spark, path):
            continue
        df = read(path).withColumn(column, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def list_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("csv", "json")) -> DataFrame:
    """(path, length, modified) of the files below path with one of the suffixes, contents unread."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return df.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes)).select("path", "length", F.col("modificationTime").alias("modified"))


def read_auto(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON array, single object or JSON lines, told by the first line that isn't blank of the first file in path order."""
    files = sorted(spark.read.text(path).inputFiles())
    head = spark.read.text(files[0]).where(F.trim("value") != "").limit(1).collect() if files else []
    line = head[0][0].lstrip(BOM).strip() if head else ""
    if line.startswith("[") or line.startswith("{") and not line.endswith("}"):
        return read_json_array(spark, path, schema)
    return read_json_lines(spark, path, schema)


def read_csv_text(df: DataFrame, text: str, header: list[str], keys: list[str]) -> DataFrame:
    """keys, row_index, header: the data rows of a CSV that stands in a column, its first line being the header.

    row_index counts data rows from 0; blank lines are skipped, all values are strings, missing ones null.
    """
    lines = F.filter(F.split(F.regexp_replace(text, "^" + BOM, ""), r"\r?\n"), lambda x: F.trim(x) != "")
    rows = df.select(*keys, F.posexplode(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).alias("row_index", "_line"))
    parsed = rows.withColumn("_r", F.from_csv("_line", ", ".join(f"`{h}` string" for h in header), {"escape": '"'}))
    return parsed.select(*keys, F.col("row_index").cast("bigint").alias("row_index"), *[F.col(f"_r.{h}").alias(h) for h in header])


def stream_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stream of the rows of plain or gzip JSON lines, new files as they come; blank and malformed lines are dropped.

    _source_file and _block_start tell where a row comes from; rows have no running number, which a stream can't have.
    """
    lines = spark.readStream.text(path).select("value", F.col("_metadata.file_name").alias("_source_file"), F.col("_metadata.file_block_start").alias("_block_start"))
    rows = lines.where(F.col("value").rlike(r"^\s*\{.*\}\s*$")).withColumn("r", F.from_json("value", schema)).where(F.try_parse_json("value").isNotNull())
    return rows.select("r.*", "_source_file", "_block_start")


def read_cache(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """The latest value of each key that write_cache stored; an empty table if there is no cache yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("version", T.LongType())])).parquet(path)
    names = schema.fieldNames()
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), "version").alias("_r")).select(*[F.col(f"_r.{n}").alias(n) for n in names])


def accepted_count(spark: SparkSession, path: str) -> int:
    """Non-blank lines of an output; 0 if there is none."""
    return spark.read.text(path).where(F.trim("value") != "").count() if exists(spark, path) else 0


def done_keys(spark: SparkSession, path: str, keys: list[str], schema: T.StructType) -> DataFrame:
    """Distinct keys of an existing JSON-lines output; an empty table if there is none. Malformed lines are skipped."""
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType([schema[k] for k in keys]))
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).select(*keys).where(F.col(keys[0]).isNotNull()).distinct()


def from_provider(df: DataFrame, column: str, call: Callable[[pd.Series], pd.Series], out: str = "response") -> DataFrame:
    """Adds the provider's answer to each text; call runs in Arrow batches on the executors.

    The provider is any picklable function of a pandas Series. dry_run below answers without a network.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{out: call(pdf[column])})

    return df.mapInPandas(run, schema)


def dry_run(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: '{"usable": true, "score": 100, "category": "dry_run", "cleaned_text": ""}' if t else '{"usable": false, "score": 0}')
