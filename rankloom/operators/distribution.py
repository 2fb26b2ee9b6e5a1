"""Distribution summaries of features and comparison with a baseline population."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .screening import numbered


def safe_std(c: str) -> Column:
    """Population deviation; 1 where it is 0 or undefined, so that it can divide."""
    return F.when(F.coalesce(F.stddev_pop(c), F.lit(0.0)) == 0, 1.0).otherwise(F.stddev_pop(c))


def melt(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    return df.select(*keys, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(keys, features, "feature", "value")


def quantiles(rows: DataFrame, keys: list[str], value: str, at: list[float]) -> DataFrame:
    """keys, q0, q1, ...: exact quantiles with linear interpolation.

    Distinct values are counted first. The counts are sorted by range over keys and value, so that no task holds all
    values of a key; a value's position is what lies before its row, and of each key only the values around the
    wanted positions are kept.
    """
    counts = numbered(rows.groupBy(*keys, value).agg(F.count("*").alias("_c")), [*keys, value], weight="_c")
    size = counts.groupBy(*keys).agg(F.min("row_no").alias("_low"), F.sum("_c").alias("_n"))
    near = counts.join(size, keys).select(*keys, F.col(value).alias("_v"), (F.col("row_no") - F.col("_low")).alias("_from"), "_c", "_n")
    lo, hi = ([e((F.col("_n") - 1) * q) for q in at] for e in (F.floor, F.ceil))
    holds = lambda p: (F.col("_from") <= p) & (p < F.col("_from") + F.col("_c"))
    wanted = near.where(functools.reduce(lambda a, b: a | b, [holds(p) for p in [*lo, *hi]]))
    part = lambda i: (F.col("_n") - 1) * at[i] - lo[i]
    cells = [F.max(F.when(holds(p[i]), F.col("_v"))).alias(f"_{side}{i}") for side, p in (("l", lo), ("h", hi)) for i in range(len(at))]
    got = wanted.groupBy(*keys, "_n").agg(*cells)
    return got.select(*keys, *[(F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * part(i)).alias(f"q{i}") for i in range(len(at))])


def summary(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """keys, feature, n, mean, std, p05, median, p95, min, max; quantiles interpolate linearly. Null keys form no group."""
    rows = cut(melt(df, keys, features).where("value is not null").where(" and ".join(f"{k} is not null" for k in keys)))
    got = rows.groupBy(*keys, "feature").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), safe_std("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    got = got.join(quantiles(rows, [*keys, "feature"], "value", [0.05, 0.5, 0.95]), [*keys, "feature"])
    nine = {c: F.round(c, 9).alias(c) for c in ("mean", "std", "min", "max")}
    return got.select(*keys, "feature", "n", nine["mean"], nine["std"], *[F.round(f"q{i}", 9).alias(c) for i, c in enumerate(("p05", "median", "p95"))], nine["min"], nine["max"])


def z_scores(df: DataFrame, keys: list[str], features: list[str], baseline: DataFrame, group: str) -> DataFrame:
    """keys, group, feature, value, z against the rounded statistics of the baseline of the same group."""
    base = baseline.select(group, "feature", "mean", "std")
    rows = melt(df, [*keys, group], features).where("value is not null").join(base, [group, "feature"])
    return rows.select(*keys, group, "feature", "value", F.round((F.col("value") - F.col("mean")) / F.col("std"), 9).alias("z"))


def z_summary(scored: DataFrame, keys: list[str]) -> DataFrame:
    return scored.groupBy(*keys, "feature").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(safe_std("value"), 6).alias("std"), F.round(F.avg("z"), 6).alias("mean_z")
    )
