"""Stratified samples that avoid spans already used."""

from __future__ import annotations

import importlib
import importlib.util
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut

#: Width of the position buckets of the interval join.
BUCKET = 256


def overlapping(left: DataFrame, right: DataFrame, book: str, start: str, end: str, bucket: int = BUCKET) -> DataFrame:
    """(left_id, right_id) of spans of one book that share a position; both need an id column.

    An equi-join on (book, bucket): a span is listed in every bucket it touches, and a pair counts in the
    bucket of the later start only, so no pair comes twice. Spans with a null end or start overlap nothing.
    """
    def spread(df: DataFrame, p: str) -> DataFrame:
        b = F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket)))
        return df.where(F.col(start) <= F.col(end)).select(F.col(book).alias("book"), F.col("id").alias(p + "id"), F.col(start).alias(p + "s"), F.col(end).alias(p + "e"), b.alias("b"))

    both = spread(left, "l").join(spread(right, "r"), ["book", "b"])
    meet = (F.col("ls") <= F.col("re")) & (F.col("rs") <= F.col("le")) & (F.floor(F.greatest("ls", "rs") / bucket) == F.col("b"))
    return both.where(meet).select(F.col("lid").alias("left_id"), F.col("rid").alias("right_id"))


def stratified(df: DataFrame, strata: list[str], need: int, order: Column) -> DataFrame:
    """The first need rows of each stratum in a hash order, by a window whose rows beyond need are pruned early."""
    place = F.row_number().over(W.partitionBy(*strata).orderBy(order, "id"))
    return df.withColumn("place", place).where(F.col("place") <= need)


def load(spec: str) -> Callable:
    """The function named by "package.module:function" or "/path/to/file.py:function", such as a sampler of one's own."""
    where, _, name = spec.rpartition(":")
    if not where.endswith(".py"):
        return getattr(importlib.import_module(where), name)
    found = importlib.util.spec_from_file_location(os.path.basename(where)[:-3], where)
    module = importlib.util.module_from_spec(found)
    found.loader.exec_module(module)
    return getattr(module, name)


def hash_order(seed: int, *columns: str) -> Column:
    return F.xxhash64(*columns, F.lit(seed))


def disjoint_first(df: DataFrame, order: Column, book: str, start: str, end: str, max_rounds: int = 100) -> DataFrame:
    """The rows a pass in the given order would take if it skips every row that overlaps one already taken.

    Rounds: a row with no earlier undecided neighbour is taken, its neighbours are dropped. Each round
    decides all local firsts at once, so rounds follow the longest chain of overlaps, not the rows. Raises if
    max_rounds rounds leave rows undecided.
    """
    rows = df.withColumn("_o", F.struct(order.alias("h"), F.col("id").alias("i")))
    pairs = overlapping(df, df, book, start, end).where("left_id <> right_id")
    left = rows.select(F.col("id").alias("left_id"), F.col("_o").alias("lo"))
    right = rows.select(F.col("id").alias("right_id"), F.col("_o").alias("ro"))
    edges = cut(pairs.join(left, "left_id").join(right, "right_id"))
    open_ = cut(rows.select("id"))
    taken = None
    for _ in range(max_rounds):
        held = edges.where("ro < lo").select(F.col("left_id").alias("id")).distinct()
        now = cut(open_.join(held, "id", "left_anti"))
        taken = now if taken is None else taken.union(now)
        gone = edges.join(now.select(F.col("id").alias("left_id")), "left_id", "left_semi").select(F.col("right_id").alias("id")).union(now).distinct()
        gone = cut(gone)
        open_ = cut(open_.join(gone, "id", "left_anti"))
        if not open_.take(1):
            break
        edges = cut(edges.join(gone.select(F.col("id").alias("left_id")), "left_id", "left_anti").join(gone.select(F.col("id").alias("right_id")), "right_id", "left_anti"))
    else:
        raise RuntimeError(f"rows are undecided after {max_rounds} rounds")
    return df.join(taken, "id", "left_semi")
