"""Rankings by judges: decoding, pair judgements, agreement, consensus, alignment."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .records import strict_lookup

LETTERS = "ABCDEF"
PAIRS = list(combinations(LETTERS, 2))


def decoded(df: DataFrame) -> DataFrame:
    """(judge, sample_id, rep, letters, valid): shown labels read through the row's own map, best first.

    Judge names are trimmed and lowered; re-delivered rows count once. A ranking is valid if it holds
    each of the six shown labels once; others keep what can be read, null and empty ones an empty list.
    """
    shown = F.transform(F.coalesce("ranking", F.array().cast("array<string>")), lambda x: F.upper(F.trim(x)))
    rows = df.select(F.lower(F.trim("judge")).alias("judge"), "sample_id", "rep", shown.alias("shown"), "t_map")
    known = F.array(*[F.lit(f"T{i}") for i in range(1, 7)])
    letters = F.array_join(F.transform("shown", lambda x: F.coalesce(F.col("t_map")[x], F.lit("?"))), "")
    valid = (F.size("shown") == 6) & (F.array_sort(F.array_distinct("shown")) == known)
    return rows.select("judge", "sample_id", "rep", letters.alias("letters"), F.coalesce(valid, F.lit(False)).alias("valid")).distinct()


def ranks(df: DataFrame) -> DataFrame:
    """(judge, sample_id, A..F): each candidate's rank (1 best) in the judge's first valid repetition."""
    first = decoded(df).where("valid and judge is not null and sample_id is not null").groupBy("judge", "sample_id").agg(F.min(F.struct("rep", "letters")).alias("v"))
    return first.select("judge", "sample_id", *[F.instr("v.letters", x).alias(x) for x in LETTERS])


def long_ranks(wide: DataFrame) -> DataFrame:
    return wide.unpivot(["judge", "sample_id"], list(LETTERS), "letter", "rank")


def pair_judgements(wide: DataFrame) -> DataFrame:
    """(judge, sample_id, candidate_a, candidate_b, winner); equal ranks go to candidate_b."""
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("candidate_a"), F.lit(b).alias("candidate_b"), F.when(F.col(a) < F.col(b), a).otherwise(b).alias("winner")) for a, b in PAIRS]))
    return wide.select("judge", "sample_id", pairs.alias("p")).select("judge", "sample_id", "p.*")


def _agreeing(x: str, y: str) -> Column:
    """Pairs of candidates that two joined rankings order alike."""
    same = [(F.col(f"{x}.{a}") < F.col(f"{x}.{b}")) == (F.col(f"{y}.{a}") < F.col(f"{y}.{b}")) for a, b in PAIRS]
    return sum((s.cast("int") for s in same[1:]), same[0].cast("int"))


def pairwise_agreement(wide: DataFrame) -> DataFrame:
    """(model_a, model_b, agreement, n): share of candidate pairs two judges order alike on shared samples.

    Judges are joined once per sample, not once per candidate pair.
    """
    both = wide.alias("x").join(wide.alias("y"), (F.col("x.sample_id") == F.col("y.sample_id")) & (F.col("x.judge") < F.col("y.judge")))
    got = both.groupBy(F.col("x.judge").alias("model_a"), F.col("y.judge").alias("model_b"))
    got = got.agg(F.sum(_agreeing("x", "y")).alias("agree"), (F.count("*") * len(PAIRS)).alias("n"))
    return got.select("model_a", "model_b", F.round(F.col("agree") / F.col("n"), 6).alias("agreement"), "n")


def judged_by_all(wide: DataFrame, least: int) -> DataFrame:
    """Rows of samples that at least so many judges ranked."""
    enough = wide.groupBy("sample_id").agg(F.count("*").alias("k")).where(F.col("k") >= least)
    return wide.join(enough.select("sample_id"), "sample_id", "left_semi")


def rank_sums(wide: DataFrame) -> DataFrame:
    return wide.groupBy("sample_id").agg(*[F.sum(x).alias(x) for x in LETTERS])


def consensus(wide: DataFrame) -> DataFrame:
    """(sample_id, consensus_order, top1, rank_sum_A..F): lowest rank sum first, ties by letter."""
    order = F.array_sort(F.array(*[F.struct(F.col(x).alias("s"), F.lit(x).alias("x")) for x in LETTERS]))
    names = F.transform(order, lambda e: e["x"])
    return rank_sums(wide).select("sample_id", F.array_join(names, ">").alias("consensus_order"), F.get(names, F.lit(0)).alias("top1"), *[F.col(x).alias(f"rank_sum_{x}") for x in LETTERS])


def _order(prefix: str = "") -> Column:
    return F.array_join(F.transform(F.array_sort(F.array(*[F.struct(F.col(x).alias("s"), F.lit(x).alias("x")) for x in LETTERS])), lambda e: e["x"]), ">")


def judge_vs_consensus(wide: DataFrame, cons: DataFrame | None = None) -> DataFrame:
    """(judge, top1_match, exact_match, pair_match, n_samples): how close a judge is to the consensus.

    The consensus is that of the same rankings unless another is given; a sample that it lacks stops the query.
    """
    cons = (consensus(wide) if cons is None else cons).select("sample_id", "consensus_order", "top1")
    place = {x: F.instr("consensus_order", x) for x in LETTERS}
    rows = strict_lookup(wide.withColumn("own", _order()), cons, "sample_id")
    same = [((F.col(a) < F.col(b)) == (place[a] < place[b])).cast("int") for a, b in PAIRS]
    return rows.groupBy("judge").agg(
        F.round(F.avg((F.substring("own", 1, 1) == F.col("top1")).cast("int")), 6).alias("top1_match"),
        F.round(F.avg((F.col("own") == F.col("consensus_order")).cast("int")), 6).alias("exact_match"),
        F.round(F.sum(sum(same[1:], same[0])) / (F.count("*") * len(PAIRS)), 6).alias("pair_match"),
        F.count("*").alias("n_samples"),
    )


def alignment(wide: DataFrame, marked: DataFrame) -> DataFrame:
    """(judge, n_samples, top1_count, top1_rate, top2_rate, mean_rank, random_baseline) of a marked candidate.

    marked: (sample_id, letter), the candidate to follow, for instance a human reference.
    """
    rank = F.element_at(F.create_map(*[c for x in LETTERS for c in (F.lit(x), F.col(x))]), F.col("letter"))
    rows = wide.join(marked, "sample_id").select("judge", rank.alias("r"))
    return rows.groupBy("judge").agg(
        F.count("*").alias("n_samples"),
        F.sum((F.col("r") == 1).cast("int")).alias("top1_count"),
        F.round(F.avg((F.col("r") == 1).cast("int")), 6).alias("top1_rate"),
        F.round(F.avg((F.col("r") <= 2).cast("int")), 6).alias("top2_rate"),
        F.round(F.avg("r"), 6).alias("mean_rank"),
    ).withColumn("random_baseline", F.round(F.lit(1.0) / len(LETTERS), 6))


def alignment_of_sets(by_judge: DataFrame) -> DataFrame:
    """One row: unweighted means of the judges' rounded rates."""
    return by_judge.agg(F.count("*").alias("n_judges"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("top1_rate", "top2_rate", "mean_rank")])


def pair_majorities(wide: DataFrame) -> DataFrame:
    """(sample_id, n, AB.., wins): how many judges put the first of each pair ahead."""
    return wide.groupBy("sample_id").agg(F.count("*").alias("n"), *[F.sum((F.col(a) < F.col(b)).cast("int")).alias(a + b) for a, b in PAIRS])


def condorcet(wide: DataFrame) -> DataFrame:
    """(sample_id, winner): the candidate that beats each other one with more than half of the judges; null if none does."""
    def beats(a: str, b: str) -> Column:
        return F.col(a + b) * 2 > F.col("n") if a < b else F.col(b + a) * 2 < F.col("n")

    won = F.coalesce(*[F.when(F.array_min(F.array(*[beats(x, y) for y in LETTERS if y != x])), x) for x in LETTERS])
    return pair_majorities(wide).select("sample_id", won.alias("winner"))


def contested(wide: DataFrame, least: float) -> DataFrame:
    """The samples whose disagreement is at least so high."""
    return disagreement(wide).where(F.col("disagreement") >= least)


def disagreement(wide: DataFrame) -> DataFrame:
    """(sample_id, n_judges, disagreement): mean share of judges in the minority over the candidate pairs."""
    part = [F.least(F.col(a + b), F.col("n") - F.col(a + b)) / F.col("n") for a, b in PAIRS]
    return pair_majorities(wide).select("sample_id", F.col("n").alias("n_judges"), F.round(sum(part[1:], part[0]) / len(PAIRS), 6).alias("disagreement"))


def lone_dissent(wide: DataFrame) -> DataFrame:
    """(judge, n_lone): samples on which the judge alone chose another first candidate than all others together did."""
    top = wide.select("judge", "sample_id", _order().substr(1, 1).alias("x"))
    votes = top.groupBy("sample_id", "x").agg(F.count("*").alias("c"), F.min("judge").alias("judge"))
    per = votes.groupBy("sample_id").agg(F.count("*").alias("kinds"), F.sum("c").alias("n"))
    lone = votes.where("c = 1").join(per.where("kinds = 2 and n >= 3"), "sample_id")
    return lone.groupBy("judge").agg(F.count("*").alias("n_lone"))


def blind_labels(df: DataFrame, seed: int = 42) -> DataFrame:
    """(sample_id, t_map, reverse_map): candidates shown under labels T1.. in an order that follows from ids and seed.

    The order is arithmetic, so a resumed run shows the same labels.
    """
    key = F.pmod(F.col("sample_id") * 7919 + F.ascii("letter") * 104729 + F.lit(seed) * 131, F.lit(1009))
    place = F.row_number().over(W.partitionBy("sample_id").orderBy(key, "letter"))
    rows = df.select("sample_id", "letter").distinct().select("sample_id", "letter", F.concat(F.lit("T"), place.cast("string")).alias("label"))
    pairs = lambda a, b: F.array_join(F.array_sort(F.collect_list(F.concat(F.col(a), F.lit("="), F.col(b)))), ",")
    return rows.groupBy("sample_id").agg(pairs("label", "letter").alias("t_map"), pairs("letter", "label").alias("reverse_map"))
