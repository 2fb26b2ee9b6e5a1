"""Sinks: JSON lines, CSV, text lines, dead letters, metrics, manifests."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapse


def _counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> int:
    """One object a line, non-ASCII kept; gives the number of rows, counted while writing."""
    out, seen = _counted(df)
    out.write.mode("append" if append else "overwrite").json(path)
    return seen.get["rows"]


def write_csv(df: DataFrame, path: str, fields: list[str], strict: bool = True) -> int:
    """Fields in the given order, null as an empty field. strict refuses columns that aren't listed."""
    extra = set(df.columns) - set(fields)
    if strict and extra:
        raise ValueError(f"columns not in the field list: {sorted(extra)}")
    out, seen = _counted(df.select(*fields))
    out.write.mode("overwrite").option("header", True).option("nullValue", "").option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return seen.get["rows"]


def write_text_lines(df: DataFrame, text: str, path: str) -> int:
    """Collapsed texts, one a line; blank ones are dropped."""
    out, seen = _counted(df.select(collapse(F.col(text)).alias("value")).where("value <> ''"))
    out.write.mode("overwrite").text(path)
    return seen.get["rows"]


def _written(spark: SparkSession, path: str, lines) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        for line in lines:
            stream.write(bytearray(line.encode()))
    finally:
        stream.close()


def write_json_array(df: DataFrame, path: str) -> int:
    """One file with an indented JSON array, non-ASCII kept, fields in column order; gives the number of rows.

    For results that people read: rows pass through the driver one partition after the other, none are held.
    """
    n = 0

    def lines():
        nonlocal n
        yield "["
        for r in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator():
            yield (",\n" if n else "\n") + "\n".join("  " + x for x in json.dumps(json.loads(r.j), ensure_ascii=False, indent=2).split("\n"))
            n += 1
        yield "\n]\n" if n else "]\n"

    _written(df.sparkSession, path, lines())
    return n


def write_cache(df: DataFrame, path: str, version: int) -> None:
    """Adds or replaces keys of a cache; a version that is written again replaces itself, later versions win."""
    df.write.mode("overwrite").parquet(f"{path}/version={version}")


def run_metrics(df: DataFrame, path: str, reason: str, **config) -> dict:
    """Writes the accepted rows (reason is null) to path/accepted and the run's counters, settings and times to path/metrics.json."""
    began = datetime.now(UTC)
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("scanned"), F.count_if(F.col(reason).isNull()).alias("accepted"), F.count_if(F.col(reason).isNotNull()).alias("rejected"))
    counted.where(F.col(reason).isNull()).drop(reason).write.mode("overwrite").parquet(f"{path}/accepted")
    record = {**seen.get, **config, "output": f"{path}/accepted", "started_utc": began.isoformat(), "finished_utc": datetime.now(UTC).isoformat()}
    write_report(df.sparkSession, [record], f"{path}/metrics.json")
    return record


def write_report(spark: SparkSession, rows: list[dict], path: str) -> None:
    """A small indented JSON array in one file (method notes, run metrics)."""
    _written(spark, path, [json.dumps(rows, ensure_ascii=False, indent=2) + "\n"])


def write_markdown(df: DataFrame, path: str, title: str, notes: list[str] = ()) -> int:
    """A report for people: a heading, notes, and df as a table; gives the number of rows, which pass through the driver one by one."""
    n = 0
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")

    def lines():
        nonlocal n
        yield f"# {title}\n\n" + "".join(f"- {x}\n" for x in notes) + ("\n" if notes else "")
        yield "| " + " | ".join(df.columns) + " |\n|" + "-|" * len(df.columns) + "\n"
        for r in df.toLocalIterator():
            n += 1
            yield "| " + " | ".join(map(cell, r)) + " |\n"

    _written(df.sparkSession, path, lines())
    return n


def write_text(spark: SparkSession, text: str, path: str) -> None:
    _written(spark, path, [text])


def split_errors(df: DataFrame, error: str, good: str, bad: str) -> tuple[int, int]:
    """Rows without an error to one JSON-lines output, the others to a dead-letter output."""
    kept = write_json_lines(df.where(F.col(error).isNull()).drop(error), good)
    return kept, write_json_lines(df.where(F.col(error).isNotNull()), bad)


def manifest(files: DataFrame, root: str, renames: list[tuple[str, str]]) -> DataFrame:
    """(source_path, organised_path): literal renames in order, caches left out; copying is up to the caller."""
    to = F.replace("path", F.lit(root), F.lit(""))
    for a, b in renames:
        to = F.replace(to, F.lit(a), F.lit(b))
    return files.where(~F.col("path").contains(".cache.")).select(F.col("path").alias("source_path"), to.alias("organised_path"))


def copy_artifacts(spark: SparkSession, files: DataFrame, target: str) -> int:
    """Copies the files of a manifest below target; a list of artifacts, so the driver goes through it."""
    fs = spark._jvm.org.apache.hadoop.fs
    conf, n = spark._jsc.hadoopConfiguration(), 0
    for r in files.orderBy("source_path").toLocalIterator():
        source, to = fs.Path(r.source_path), fs.Path(target.rstrip("/") + "/" + r.organised_path.lstrip("/"))
        fs.FileUtil.copy(source.getFileSystem(conf), source, to.getFileSystem(conf), to, False, True, conf)
        n += 1
    return n
