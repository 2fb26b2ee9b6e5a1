"""Preference regression: observations, standardising, L2 logistic fits and cluster-robust errors.

Everything that grows with the data is a grouped aggregation with partial sums: gradients, Hessians and
score products per model. Only k x k systems, one row per model, are solved in Python.
"""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

L2 = 0.01
Z95 = 1.96
SIGNIFICANT = 0.05
MAX_STEPS = 60
STEP_TOLERANCE = 1e-9
#: Models fitted at once; their sums and coefficients are held by the driver.
MAX_MODELS = 20_000
FEATURES = ["diff_source_similarity", "diff_entailment", "diff_clause_depth", "diff_log_perplexity"]


def sigmoid(v: Column) -> Column:
    """Stable on both sides."""
    return F.when(v >= 0, 1 / (1 + F.exp(-v))).otherwise(F.exp(v) / (1 + F.exp(v)))


def observations(df: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """(obs_id, model, sample_id, candidate_a, candidate_b, label, features): decided comparisons, each once.

    label is 1 if candidate_a won. The winner counts if it is one of the pair, the first of the ranking
    where the winner is missing. Names are trimmed and lowered, sample ids lose padding. Rows that lack
    a feature, compare a system with itself or hold no verdict are left out.
    """
    a, b = F.lower(F.trim("candidate_a")), F.lower(F.trim("candidate_b"))
    w = F.coalesce(F.nullif(F.lower(F.trim("winner")), F.lit("")), F.lower(F.trim(F.get("ranking", F.lit(0)))))
    rows = df.select(
        "obs_id", F.lower(F.trim("model")).alias("model"), F.trim("sample_id").cast("bigint").alias("sample_id"), a.alias("candidate_a"), b.alias("candidate_b"),
        F.when(w == a, 1.0).when(w == b, 0.0).alias("label"), *[F.round(f, 6).alias(f) for f in features],
    ).where(a != b)
    return rows.na.drop().dropDuplicates(["obs_id"])


def standardised(obs: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """Features minus their model's mean, over its population deviation (1 where that is 0)."""
    stats = obs.groupBy("model").agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features])
    rows = obs.join(stats, "model")
    z = [((F.col(f) - F.col(f"m_{f}")) / F.when(F.col(f"s_{f}") == 0, 1.0).otherwise(F.col(f"s_{f}"))).alias(f) for f in features]
    return rows.select(*[c for c in obs.columns if c not in features], *z)


def gram(df: DataFrame, keys: list[str], columns: list[str], weight: Column | None = None) -> DataFrame:
    """keys, g_i_j (i <= j): sums of products of the columns, optionally weighted."""
    w = F.lit(1.0) if weight is None else weight
    n = len(columns)
    return df.groupBy(*keys).agg(*[F.sum(w * F.col(columns[i]) * F.col(columns[j])).alias(f"g_{i}_{j}") for i, j in combinations_with_replacement(range(n), 2)])


def _symmetric(row, prefix: str, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    for i, j in combinations_with_replacement(range(k), 2):
        out[i, j] = out[j, i] = row[f"{prefix}_{i}_{j}"]
    return out


def _linear(k: int) -> Column:
    return sum((F.get("beta", F.lit(i)) * F.col(f"x{i}") for i in range(1, k)), F.get("beta", F.lit(0)) * F.col("x0"))


def _design(obs: DataFrame, features: list[str]) -> DataFrame:
    return obs.select("model", "sample_id", "label", F.lit(1.0).alias("x0"), *[F.col(f).alias(f"x{i + 1}") for i, f in enumerate(features)])


def fit_logistic(obs: DataFrame, features: list[str] = FEATURES, l2: float = L2) -> DataFrame:
    """(model, beta): minimises mean log-loss + l2/2 |w|^2 (intercept free) by Newton steps.

    The penalised loss is strictly convex, so this is the point that long gradient descent approaches.
    Each step is one pass of partial sums over obs, however a model's rows are spread; cut() it first if
    it is costly to compute. The driver holds one row of sums and coefficients per model, of at most
    MAX_MODELS (checked); they go back as a broadcast table. Raises if MAX_STEPS steps don't settle.
    """
    spark, k = obs.sparkSession, len(features) + 1
    x = _design(obs, features)
    names = [r.model for r in x.select("model").distinct().limit(MAX_MODELS + 1).collect()]
    if len(names) > MAX_MODELS:
        raise ValueError(f"more than {MAX_MODELS} models")
    schema = "model string, beta array<double>"
    beta = {m: np.zeros(k) for m in names}
    grads = [F.sum((F.col("p") - F.col("label")) * F.col(f"x{i}")).alias(f"d_{i}") for i in range(k)]
    w = F.col("p") * (1 - F.col("p"))
    hess = [F.sum(w * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"g_{i}_{j}") for i, j in combinations_with_replacement(range(k), 2)]
    ridge = l2 * np.r_[0.0, np.ones(k - 1)]
    for _ in range(MAX_STEPS if names else 0):
        held = spark.createDataFrame([(m, b.tolist()) for m, b in beta.items()], schema)
        sums = x.join(F.broadcast(held), "model").withColumn("p", sigmoid(_linear(k))).groupBy("model").agg(F.count("*").alias("n"), *grads, *hess)
        most = 0.0
        for r in sums.collect():  # one row per model
            g = np.array([r[f"d_{i}"] for i in range(k)]) / r["n"] + ridge * beta[r.model]
            step = np.linalg.pinv(_symmetric(r, "g", k) / r["n"] + np.diag(ridge)) @ g
            beta[r.model] = beta[r.model] - step
            most = max(most, float(np.abs(step).max()))
        if most < STEP_TOLERANCE:
            break
    else:
        if names:
            raise RuntimeError(f"the fit has not settled after {MAX_STEPS} steps: the last step was {most}")
    return spark.createDataFrame([(m, b.tolist()) for m, b in beta.items()], schema)


def given_coefficients(obs: DataFrame, table: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """(model, beta) looked up by (model, feature) in a table (model, feature, standardized_coefficient, intercept).

    Rows with a blank feature are left out. Every model of obs needs every feature; a missing one raises.
    """
    rows = table.where(F.trim("feature") != "").select("model", "feature", F.col("standardized_coefficient").cast("double").alias("c"), F.col("intercept").cast("double").alias("b0"))
    wide = rows.groupBy("model").agg(F.max("b0").alias("b0"), *[F.max(F.when(F.col("feature") == f, F.col("c"))).alias(f"c{i}") for i, f in enumerate(features)])
    need = obs.select("model").distinct().join(wide, "model", "left")
    known = lambda c, f: F.coalesce(F.col(c), F.raise_error(F.concat(F.lit(f"no coefficient of {f} for "), F.col("model"))).cast("double"))
    return need.select("model", F.array(known("b0", "intercept"), *[known(f"c{i}", f) for i, f in enumerate(features)]).alias("beta"))


def replaced_features(features: list[str], composite: str, parts: list[str]) -> list[str]:
    """The feature list with the composite score swapped for its parts, which come last."""
    if composite not in features:
        raise ValueError(f"no feature {composite}")
    return [f for f in features if f != composite] + list(parts)


def feature_differences(ranks: DataFrame, features: DataFrame, names: list[str], digits: int | None = 6) -> DataFrame:
    """(model, sample_id, candidate_a, candidate_b, label, diff_<name>): one row per ranking and candidate pair.

    ranks: (judge, sample_id, A..F); features: (sample_id, letter, names). label is 1 if candidate_a ranks
    before candidate_b, ties go to candidate_b. A ranking of a sample whose candidates lack features raises;
    a null feature gives null differences. digits None leaves the differences unrounded.
    """
    from .judging import pair_judgements

    pairs = pair_judgements(ranks).select(F.col("judge").alias("model"), "sample_id", "candidate_a", "candidate_b", (F.col("winner") == F.col("candidate_a")).cast("double").alias("label"))
    folded = features.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("letter", F.struct(*[F.col(n).cast("double").alias(n) for n in names])))).alias("by_letter"))
    rows = pairs.join(folded, "sample_id", "left")
    kind = "struct<" + ", ".join(f"`{n}`: double" for n in names) + ">"
    of = lambda side: F.coalesce(F.col("by_letter")[F.col(side)], F.raise_error(F.concat(F.lit("missing features of sample "), F.col("sample_id").cast("string"))).cast(kind))
    rows = rows.withColumn("fa", of("candidate_a")).withColumn("fb", of("candidate_b"))
    diff = lambda n: F.col(f"fa.{n}") - F.col(f"fb.{n}")
    return rows.select("model", "sample_id", "candidate_a", "candidate_b", "label", *[(diff(n) if digits is None else F.round(diff(n), digits)).alias(f"diff_{n}") for n in names])


def pairwise_logistic(obs: DataFrame, features: list[str] = FEATURES, l2: float = L2) -> DataFrame:
    """(model, feature, standardized_coefficient, intercept, training_accuracy): the fit without cluster errors."""
    k = len(features) + 1
    beta = fit_logistic(obs, features, l2)
    rows = _design(obs, features).join(F.broadcast(beta), "model").withColumn("p", sigmoid(_linear(k)))
    right = rows.groupBy("model").agg(F.avg(((F.col("p") >= 0.5) == (F.col("label") == 1)).cast("int")).alias("a"))
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.get("beta", F.lit(i + 1)).alias("c")) for i, f in enumerate(features)])).alias("x")
    return right.join(F.broadcast(beta), "model").select("model", F.round(F.get("beta", F.lit(0)), 6).alias("intercept"), F.round("a", 6).alias("training_accuracy"), cells).select(
        "model", "x.feature", F.round("x.c", 6).alias("standardized_coefficient"), "intercept", "training_accuracy"
    )


def cluster_robust(obs: DataFrame, beta: DataFrame, features: list[str] = FEATURES, l2: float = L2) -> DataFrame:
    """Coefficient table with errors clustered by sample.

    (model, feature, coefficient, se, z, p, ci_low, ci_high, significant, accuracy, n_observations,
    n_clusters); feature "intercept" included. Bread: inverse of X'WX + n l2 I (intercept free); meat: sum
    of products of the clusters' score sums, times g/(g-1) (n-1)/(n-k). se 0 gives null z and p.
    """
    k = len(features) + 1
    rows = _design(obs, features).join(beta, "model").withColumn("p", sigmoid(_linear(k)))
    w = F.col("p") * (1 - F.col("p"))
    hit = ((F.col("p") >= 0.5) == (F.col("label") == 1)).cast("int")
    bread = rows.groupBy("model").agg(
        F.count("*").alias("n"), F.avg(hit).alias("accuracy"),
        *[F.sum(w * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"g_{i}_{j}") for i, j in combinations_with_replacement(range(k), 2)],
    )
    scores = cluster_scores(rows, k)
    meat = scores.groupBy("model").agg(
        F.count("*").alias("clusters"), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m_{i}_{j}") for i, j in combinations_with_replacement(range(k), 2)]
    )
    names = ["intercept", *features]

    def solve(batches):
        for pdf in batches:
            out = []
            for _, r in pdf.iterrows():
                b, n, g = np.array(r["beta"], float), int(r["n"]), int(r["clusters"])
                inv = np.linalg.pinv(_symmetric(r, "g", k) + n * l2 * np.diag(np.r_[0.0, np.ones(k - 1)]))
                scale = 1.0 if g <= 1 or n <= k else g / (g - 1) * (n - 1) / (n - k)
                se = np.sqrt(np.maximum(np.diag(inv @ _symmetric(r, "m", k) @ inv) * scale, 0))
                for name, c, s in zip(names, b, se):
                    z = c / s if s > 0 else None
                    p = math.erfc(abs(z) / math.sqrt(2)) if z is not None else None
                    out.append((r["model"], name, float(c), float(s), z, p, c - Z95 * s, c + Z95 * s, p is not None and p < SIGNIFICANT, r["accuracy"], n, g))
            yield pd.DataFrame(out, columns=["model", "feature", "coefficient", "se", "z", "p", "ci_low", "ci_high", "significant", "accuracy", "n_observations", "n_clusters"])

    table = bread.join(meat, "model").join(beta, "model").mapInPandas(  # one row per model
        solve, "model string, feature string, coefficient double, se double, z double, p double, ci_low double, ci_high double, significant boolean, accuracy double, n_observations bigint, n_clusters bigint"
    )
    return table.select("model", "feature", *[F.round(c, 6).alias(c) for c in ("coefficient", "se", "z", "p", "ci_low", "ci_high")], "significant", F.round("accuracy", 6).alias("accuracy"), "n_observations", "n_clusters")


def cluster_scores(rows: DataFrame, k: int) -> DataFrame:
    """(model, sample_id, s0..): per cluster the sum of x times residual."""
    return rows.groupBy("model", "sample_id").agg(*[F.sum((F.col("label") - F.col("p")) * F.col(f"x{i}")).alias(f"s{i}") for i in range(k)])


def univariate(obs: DataFrame, features: list[str] = FEATURES, l2: float = L2) -> DataFrame:
    """One model per (judge, feature): the feature alone with an intercept."""
    long = obs.unpivot(["model", "sample_id", "label"], features, "feature", "x")
    keyed = cut(long.withColumn("model", F.concat_ws("\t", "model", "feature")).select("model", "sample_id", "label", "x"))
    table = cluster_robust(keyed, fit_logistic(keyed, ["x"], l2), ["x"], l2).where("feature = 'x'")
    parts = F.split("model", "\t")
    return table.withColumn("feature", parts[1]).withColumn("model", parts[0])


def tiers(signs: DataFrame) -> DataFrame:
    """(feature, tier, dominant_sign, n_significant, n_models, n_positive, n_negative) from (feature, model, coefficient, significant)."""
    sig = F.col("significant")
    got = signs.groupBy("feature").agg(
        F.sum(sig.cast("int")).alias("n_significant"), F.count("*").alias("n_models"),
        F.sum((sig & (F.col("coefficient") > 0)).cast("int")).alias("n_positive"), F.sum((sig & (F.col("coefficient") < 0)).cast("int")).alias("n_negative"),
    )
    most = F.greatest("n_positive", "n_negative")
    tier = (
        F.when((F.col("n_significant") == F.col("n_models")) & (most == F.col("n_models")), "no_exception")
        .when((F.col("n_significant") >= F.ceil(F.col("n_models") * 0.625)) & (most >= F.ceil(F.col("n_models") * 0.75)), "mostly_supported_with_exceptions")
        .otherwise("no_stable_evidence")
    )
    sign = F.when(F.col("n_positive") >= F.col("n_negative"), "positive").otherwise("negative")
    return got.select("feature", tier.alias("tier"), sign.alias("dominant_sign"), "n_significant", "n_models", "n_positive", "n_negative")


def significant_features(table: DataFrame) -> DataFrame:
    """(model, n_significant, features): the model's significant features in order, without the intercept."""
    rows = table.where("significant and feature <> 'intercept'")
    return rows.groupBy("model").agg(F.count("*").alias("n_significant"), F.array_join(F.array_sort(F.collect_set("feature")), ",").alias("features"))
