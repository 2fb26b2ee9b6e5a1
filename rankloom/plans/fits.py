"""Queries of the preference fits, and their SQL: the same Newton steps written out one after the other."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import inference, judging, records
from ..session import cut, shared_dir, table
from ..sources import readers, writers
from .catalogue import FEATURES, LETTERS, OBS, PAIRS, RANKS, STATS, VARIANTS, _cnt, _fitted, _obs, _ranks, ORACLE, query

STEPS = 14


def _lower(k: int, g: str, prefix: str) -> list[str]:
    """Cells of the lower triangle L with L L' = g, as columns that build on each other; g takes (i, j) with i <= j."""
    out = []
    for j in range(k):
        below = lambda i: "".join(f" - {prefix}{i}_{m} * {prefix}{j}_{m}" for m in range(j))  # noqa: B023, E731
        out.append(f"sqrt({g.format(i=j, j=j)}{below(j)}) AS {prefix}{j}_{j}")
        out += [f"({g.format(i=j, j=i)}{below(i)}) / {prefix}{j}_{j} AS {prefix}{i}_{j}" for i in range(j + 1, k)]
    return out


def _solved(k: int, prefix: str, d: str, y: str, s: str) -> list[str]:
    out = [f"({d}{i}" + "".join(f" - {prefix}{i}_{m} * {y}{m}" for m in range(i)) + f") / {prefix}{i}_{i} AS {y}{i}" for i in range(k)]
    return out + [f"({y}{i}" + "".join(f" - {prefix}{m}_{i} * {s}{m}" for m in range(i + 1, k)) + f") / {prefix}{i}_{i} AS {s}{i}" for i in reversed(range(k))]


def _staged(name: str, source: str, columns: list[str]) -> str:
    """CTEs that add the columns to source one after the other, so that no expression is copied into the next."""
    out, last = [], source
    for n, c in enumerate(columns):
        out.append(f"{name}_{n} AS MATERIALIZED (SELECT *, {c} FROM {last})")
        last = f"{name}_{n}"
    return ", ".join([*out, f"{name} AS (SELECT * FROM {last})"])


def newton_sql(source: str, k: int, steps: int = STEPS, l2: float = inference.L2) -> str:
    """CTEs b0 .. b<steps> of (grp, b0..) for rows (grp, sample_id, label, x0..) of source, x0 being 1."""
    xs, pairs = range(k), [(i, j) for i in range(k) for j in range(i, k)]
    eta = " + ".join(f"b{i} * x{i}" for i in xs)
    out = [f"fit0 AS (SELECT DISTINCT grp, {', '.join(f'0.0::DOUBLE AS b{i}' for i in xs)} FROM {source})"]
    for n in range(steps):
        ridge = lambda i: f" + {l2} * b{i}" if i else ""
        sums = [f"sum((p - label) * x{i}) / count(*) AS e{i}" for i in xs] + [f"sum(p * (1 - p) * x{i} * x{j}) / count(*) AS h{i}_{j}" for i, j in pairs]
        out.append(
            f"""sum{n} AS MATERIALIZED (SELECT grp, {', '.join(sums)} FROM (SELECT {source}.*, 1 / (1 + exp(-({eta}))) AS p FROM {source} JOIN fit{n} USING (grp)) GROUP BY grp),
            pen{n} AS (SELECT grp, {', '.join(f'b{i}' for i in xs)}, {', '.join(f'e{i}{ridge(i)} AS d{i}' for i in xs)}, {', '.join(f'h{i}_{j}' + (f' + {l2}' if i == j and i else '') + f' AS g{i}_{j}' for i, j in pairs)} FROM sum{n} JOIN fit{n} USING (grp)),
            {_staged(f"step{n}", f"pen{n}", _lower(k, 'g{i}_{j}', 'l') + _solved(k, 'l', 'd', 'y', 's'))},
            fit{n + 1} AS MATERIALIZED (SELECT grp, {', '.join(f'b{i} - s{i} AS b{i}' for i in xs)} FROM step{n})"""
        )
    return ", ".join(out)


# twice the upper tail of the normal distribution, by the series of the error function with positive terms
TAIL = "CASE WHEN abs(z) > 8 THEN 0.0 ELSE greatest(0.0, 1 - exp(-z * z / 2) * list_sum(list_transform(range(0, 160), lambda n: exp((2 * n + 1) * ln(greatest(abs(z), 1e-300) / sqrt(2.0)) - lgamma(n + 1.5))))) END"


def robust_sql(source: str, fit: str, names: list[str], l2: float = inference.L2) -> str:
    """CTE robust: the coefficient table of the given fit, unrounded; names[0] is the intercept."""
    k = len(names)
    xs, pairs = range(k), [(i, j) for i in range(k) for j in range(i, k)]
    eta = " + ".join(f"b{i} * x{i}" for i in xs)
    inverse = [f"1 / l{i}_{i} AS v{i}_{i}" for i in xs]
    for gap in range(1, k):
        inverse += [f"-({' + '.join(f'l{j + gap}_{m} * v{m}_{j}' for m in range(j, j + gap))}) / l{j + gap}_{j + gap} AS v{j + gap}_{j}" for j in range(k - gap)]
    whole = [f"{' + '.join(f'v{m}_{i} * v{m}_{j}' for m in range(max(i, j), k))} AS i{i}_{j}" for i in xs for j in xs]
    cell = lambda i, j: f"m{min(i, j)}_{max(i, j)}"
    var = [f"{' + '.join(f'i{q}_{a} * {cell(a, b)} * i{b}_{q}' for a in xs for b in xs)} AS var{q}" for q in xs]
    rows = " UNION ALL ".join(f"SELECT grp, '{n}' AS feature, b{q} AS c, sqrt(greatest(var{q} * scale, 0)) AS se, accuracy, n, clusters FROM sandwich" for q, n in enumerate(names))
    return f"""pred AS MATERIALIZED (SELECT {source}.*, 1 / (1 + exp(-({eta}))) AS p FROM {source} JOIN {fit} USING (grp)),
      bread AS (SELECT grp, count(*) AS n, avg(CAST((p >= 0.5) = (label = 1) AS INT)) AS accuracy, {', '.join(f'sum(p * (1 - p) * x{i} * x{j})' + (f' + count(*) * {l2}' if i == j and i else '') + f' AS g{i}_{j}' for i, j in pairs)} FROM pred GROUP BY grp),
      score AS (SELECT grp, sample_id, {', '.join(f'sum((label - p) * x{i}) AS s{i}' for i in xs)} FROM pred GROUP BY grp, sample_id),
      meat AS (SELECT grp, count(*) AS clusters, {', '.join(f'sum(s{i} * s{j}) AS m{i}_{j}' for i, j in pairs)} FROM score GROUP BY grp),
      parts AS MATERIALIZED (SELECT *, CASE WHEN clusters <= 1 OR n <= {k} THEN 1.0 ELSE clusters / (clusters - 1) * (n - 1) / (n - {k}) END AS scale FROM bread JOIN meat USING (grp) JOIN {fit} USING (grp)),
      {_staged("sandwich", "parts", _lower(k, 'g{i}_{j}', 'l') + inverse + whole + var)},
      long_rows AS ({rows}), zed AS (SELECT *, CASE WHEN se > 0 THEN c / se END AS z FROM long_rows), robust AS (SELECT *, {TAIL} AS p FROM zed)"""


TABLE = """SELECT {keys}, round(c, 6) AS coefficient, round(se, 6) AS se, round(z, 6) AS z, round(p, 6) AS p, round(c - 1.96 * se, 6) AS ci_low, round(c + 1.96 * se, 6) AS ci_high,
  coalesce(p < 0.05, false) AS significant, round(accuracy, 6) AS accuracy, n AS n_observations, clusters AS n_clusters FROM robust"""
K = len(FEATURES) + 1
JOINT = "WITH " + OBS + STATS + ", rows AS MATERIALIZED (SELECT model AS grp, sample_id, label, 1.0::DOUBLE AS x0, " + ", ".join(f"{f} AS x{i + 1}" for i, f in enumerate(FEATURES)) + " FROM std), " + newton_sql("rows", K)
JOINT_ROBUST = JOINT + ", " + robust_sql("rows", f"fit{STEPS}", ["intercept", *FEATURES])
SINGLE_ROWS = "WITH " + OBS + STATS + ", rows AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT model || chr(9) || '{f}' AS grp, sample_id, label, 1.0::DOUBLE AS x0, {f} AS x1 FROM std" for f in FEATURES) + ")"
SINGLE_KEYS = "split_part(grp, chr(9), 1) AS model, split_part(grp, chr(9), 2) AS feature"

ORACLE["q_logistic_robust"] = JOINT_ROBUST + " " + TABLE.format(keys="grp AS model, feature")
ORACLE["q_significance_summary"] = JOINT_ROBUST + " SELECT grp AS model, count(*) AS n_significant, array_to_string(list_sort(list(DISTINCT feature)), ',') AS features FROM robust WHERE p < 0.05 AND feature <> 'intercept' GROUP BY grp"
ORACLE["q_univariate_robust"] = SINGLE_ROWS + ", " + newton_sql("rows", 2) + ", " + robust_sql("rows", f"fit{STEPS}", ["intercept", "x"]) + " " + TABLE.format(keys=SINGLE_KEYS) + " WHERE feature = 'x'"


@query(JOINT + ", right_ones AS (SELECT grp, avg(CAST((1 / (1 + exp(-(" + " + ".join(f"b{i} * x{i}" for i in range(K)) + f"))) >= 0.5) = (label = 1) AS INT)) AS a FROM rows JOIN fit{STEPS} USING (grp) GROUP BY grp) "
       + " UNION ALL ".join(f"SELECT grp AS model, '{f}' AS feature, round(b{i + 1}, 6) AS standardized_coefficient, round(b0, 6) AS intercept, round(a, 6) AS training_accuracy FROM fit{STEPS} JOIN right_ones USING (grp)" for i, f in enumerate(FEATURES)))
def q_pairwise_logistic(spark, d):
    """The fit without cluster errors."""
    return inference.pairwise_logistic(cut(inference.standardised(_obs(spark, d))))


@query(JOINT_ROBUST + """, per AS (SELECT feature, sum(CAST(coalesce(p < 0.05, false) AS INT))::BIGINT AS n_significant, count(*) AS n_models, sum(CAST(coalesce(p < 0.05, false) AND round(c, 6) > 0 AS INT))::BIGINT AS n_positive,
    sum(CAST(coalesce(p < 0.05, false) AND round(c, 6) < 0 AS INT))::BIGINT AS n_negative FROM robust WHERE feature <> 'intercept' GROUP BY feature)
  SELECT feature, CASE WHEN n_significant = n_models AND greatest(n_positive, n_negative) = n_models THEN 'no_exception'
  WHEN n_significant >= ceil(n_models * 0.625) AND greatest(n_positive, n_negative) >= ceil(n_models * 0.75) THEN 'mostly_supported_with_exceptions' ELSE 'no_stable_evidence' END AS tier,
  CASE WHEN n_positive >= n_negative THEN 'positive' ELSE 'negative' END AS dominant_sign, n_significant, n_models, n_positive, n_negative FROM per""")
def q_fitted_tiers(spark, d):
    """Stability tiers over the judges of the fitted coefficients."""
    return inference.tiers(_fitted(spark, d).where("feature <> 'intercept'").select("model", "feature", "coefficient", "significant"))


GIVEN = "(length(grp) % 5 - 2) / 10.0"


@query(SINGLE_ROWS + f", given AS (SELECT DISTINCT grp, 0.25::DOUBLE AS b0, ({GIVEN})::DOUBLE AS b1 FROM rows), " + robust_sql("rows", "given", ["intercept", "x"]) + " " + TABLE.format(keys=SINGLE_KEYS) + " WHERE feature = 'x'")
def q_family_given(spark, d):
    """Cluster-robust errors for coefficients read from a CSV, looked up by (model, feature); a blank row is left out."""
    at = f"{shared_dir(spark)}/coefficients-{uuid.uuid4().hex}"
    long = inference.standardised(_obs(spark, d)).unpivot(["model", "sample_id", "label"], FEATURES, "feature", "x")
    keyed = cut(long.withColumn("model", F.concat_ws("\t", "model", "feature")).select("model", "sample_id", "label", "x"))
    given = keyed.select("model").distinct().select("model", F.lit("x").alias("feature"), ((F.length("model") % 5 - 2) / 10).alias("standardized_coefficient"), F.lit(0.25).alias("intercept"))
    blank = given.limit(1).withColumn("feature", F.lit(" ")).withColumn("standardized_coefficient", F.lit(99.0))
    writers.write_csv(given.union(blank), at, ["model", "feature", "standardized_coefficient", "intercept"])
    got = inference.cluster_robust(keyed, inference.given_coefficients(keyed, readers.read_csv(spark, at), ["x"]), ["x"]).where("feature = 'x'")
    parts = F.split("model", "\t")
    return got.withColumn("feature", parts[1]).withColumn("model", parts[0])


SPLIT = [f for f in FEATURES if f != "diff_clause_depth"] + ["deeper", "flatter"]
HALVES = OBS.replace("obs AS (SELECT DISTINCT", "whole AS (SELECT DISTINCT") + ", obs AS (SELECT * EXCLUDE (diff_clause_depth), greatest(diff_clause_depth, 0.0) AS deeper, least(diff_clause_depth, 0.0) AS flatter FROM whole)"
SPLIT_STATS = ", stats AS (SELECT model, " + ", ".join(f"avg({f}) AS m_{f}, CASE WHEN stddev_pop({f}) = 0 THEN 1.0 ELSE stddev_pop({f}) END AS s_{f}" for f in SPLIT) + " FROM obs GROUP BY model), rows AS MATERIALIZED (SELECT obs.model AS grp, sample_id, label, 1.0::DOUBLE AS x0, " + ", ".join(f"({f} - m_{f}) / s_{f} AS x{i + 1}" for i, f in enumerate(SPLIT)) + " FROM obs JOIN stats USING (model))"


@query("WITH " + HALVES + SPLIT_STATS + ", " + newton_sql("rows", len(SPLIT) + 1) + ", " + robust_sql("rows", f"fit{STEPS}", ["intercept", *SPLIT]) + " " + TABLE.format(keys="grp AS model, feature"))
def q_subfeature_refit(spark, d):
    """A composite score swapped for its two parts, and refitted."""
    names = inference.replaced_features(FEATURES, "diff_clause_depth", ["deeper", "flatter"])
    obs = _obs(spark, d).withColumns({"deeper": F.greatest("diff_clause_depth", F.lit(0.0)), "flatter": F.least("diff_clause_depth", F.lit(0.0))})
    obs = cut(inference.standardised(obs.drop("diff_clause_depth"), names))
    return inference.cluster_robust(obs, inference.fit_logistic(obs, names), names)


FEATS = VARIANTS + f", feats AS (SELECT sample_id, letter, max(coalesce(length(translation), 0))::DOUBLE AS chars, max(coalesce({_cnt('[。！？]', 'translation')}, 0))::DOUBLE / 3 AS marks FROM variants WHERE generation_round = 1 GROUP BY ALL), seen AS (SELECT ranks.* FROM ranks WHERE sample_id IN (SELECT sample_id FROM feats GROUP BY ALL HAVING count(*) = 6))"


@query(RANKS + ", " + FEATS + " SELECT r.judge AS model, r.sample_id AS sample_id, pr[1] AS candidate_a, pr[2] AS candidate_b, CASE WHEN list_extract([A, B, C, D, E, F], ascii(pr[1]) - 64) < list_extract([A, B, C, D, E, F], ascii(pr[2]) - 64) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label, "
       "round(fa.chars - fb.chars, 6) AS diff_chars, round(fa.marks - fb.marks, 6) AS diff_marks FROM (SELECT *, unnest([" + ", ".join(f"'{a}{b}'" for a, b in PAIRS) + "]) AS pr FROM seen) r JOIN feats fa ON fa.sample_id = r.sample_id AND fa.letter = pr[1] JOIN feats fb ON fb.sample_id = r.sample_id AND fb.letter = pr[2]")
def q_feature_differences(spark, d):
    """Observations built from rankings and two features of the candidates."""
    rows = records.variants(table(spark, d, "ec_400_with_candidates"), ["sample_id", "generation_round"]).where("generation_round = 1")
    t = F.coalesce("translation", F.lit(""))
    feats = rows.groupBy("sample_id", "letter").agg(F.max(F.length(t)).cast("double").alias("chars"), (F.max(X.sentence_marks(t)) / 3).alias("marks"))
    whole = feats.groupBy("sample_id").agg(F.count("*").alias("n")).where(F.col("n") == len(LETTERS))
    return inference.feature_differences(_ranks(spark, d).join(whole.select("sample_id"), "sample_id", "left_semi").select("judge", "sample_id", *LETTERS), feats, ["chars", "marks"])


@query(RANKS + ", every AS (SELECT count(DISTINCT judge) AS n FROM ranks WHERE judge < 'c') SELECT sample_id, count(*) AS n_judges FROM ranks WHERE judge < 'c' GROUP BY sample_id HAVING count(*) = (SELECT n FROM every)")
def q_all_judges(spark, d):
    """Samples that every judge of a set ranked: those whose names come before c."""
    ranks = _ranks(spark, d).where("judge < 'c'")
    n = ranks.select("judge").distinct().count()
    return judging.judged_by_all(ranks, n).groupBy("sample_id").agg(F.count("*").alias("n_judges"))
