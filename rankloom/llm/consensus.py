"""Consensus label per item from rankings by several annotators, by iteratively reweighted voting.

Every ranking of a judge gives each candidate letter a place (1 best, 0 not ranked). A judge's accuracy at a
place is the smoothed share of its rankings that put the consensus letter there, and its vote for a letter
weighs the log-ratio of that accuracy to chance. So a careful judge counts much, a careless one nothing,
and a reversed one speaks for the letters it puts last. Rounds alternate: consensus from the current
weights; then the accuracies against the leave-one-out consensus, which leaves the judge's own votes on the
item out. They stop when no accuracy moves by more than TOLERANCE, and raise if ROUNDS rounds don't suffice;
moves are halved every DAMPING rounds, so that two consensus states can't alternate for ever. A judge's
repeated rankings of a sample are correlated and weigh less.

Re-delivered rows (same judge, sample_id, rep) count once; judges' names are compared trimmed and in
lower case. Unknown labels are skipped and a repeated label keeps its first place; where ranking
is null or empty the letter_ranking is used, and rows without any known label are no votes. A
sample without votes has no consensus row. Equal scores are resolved by the unweighted mean place,
then by letter. An item on which a judge is alone says nothing about the judge's accuracy.

Votes are counted to one row per sample and judge, with the judge's different rankings of the sample (at most
all orders of six letters) in an array. These rows are shuffled once, by sample, a sample with more than HOT
judges by parts; a round then moves only one row of sums per sample and part, and one per judge.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, stored

LETTERS = "ABCDEF"
K = len(LETTERS)
#: Pseudo-votes of chance in a judge's accuracy.
PRIOR = 6.0
#: Chance of each place, 0 (not ranked) first, and what all judges start from: better than chance in front.
CHANCE = [0.02] + [0.98 / K] * K
_LEAN = [c * math.exp(0.9 - 0.3 * p if p else 0.0) for p, c in enumerate(CHANCE)]
START = [x / sum(_LEAN) for x in _LEAN]
#: Correlation of one judge's repeated rankings of a sample; each of N repetitions weighs 1 / (1 + (N - 1) * REPEATS).
REPEATS = 0.5
ROUNDS = 120
DAMPING = 10
TOLERANCE = 1e-4
#: Judges of one sample that stay in one part.
HOT = 50_000


def votes(df: DataFrame) -> DataFrame:
    """(sample_id, judge, letters, n): counted rankings; letters are best first, each once."""
    shown = F.transform("ranking", lambda x: F.upper(F.trim(x)))
    decoded = F.filter(F.transform(shown, lambda x: F.upper(F.trim(F.col("t_map")[x]))), lambda x: x.isNotNull())
    given = F.transform("letter_ranking", lambda x: F.upper(F.trim(x)))
    known = F.array(*[F.lit(x) for x in LETTERS])

    def clean(c: Column) -> Column:
        return F.array_join(F.array_distinct(F.filter(c, lambda x: F.array_contains(known, x))), "")

    rows = df.select(
        F.col("sample_id").cast("bigint").alias("sample_id"),
        F.lower(F.trim("judge")).alias("judge"),
        F.coalesce(F.col("rep"), F.lit(-1)).alias("rep"),
        F.coalesce(F.nullif(clean(decoded), F.lit("")), clean(given)).alias("letters"),
    ).where("sample_id is not null and judge is not null and letters <> ''")
    once = rows.groupBy("sample_id", "judge", "rep").agg(F.min("letters").alias("letters"))
    return once.groupBy("sample_id", "judge", "letters").agg(F.count("*").alias("n"))


def ballots(counted: DataFrame) -> DataFrame:
    """(sample_id, judge, part, given): given holds the judge's rankings of the sample, (letters, n), repetitions discounted."""
    rows = cut(counted.groupBy("sample_id", "judge").agg(F.sum("n").alias("n"), F.collect_list(F.struct("letters", "n")).alias("given")))
    hot = rows.groupBy("sample_id").agg(F.ceil(F.count("*") / HOT).cast("int").alias("parts")).where("parts > 1")
    part = F.pmod(F.xxhash64("judge"), F.coalesce("parts", F.lit(1))).cast("int")
    each = 1 / (1 + (F.col("n") - 1) * REPEATS)
    given = F.transform(F.array_sort("given"), lambda g: F.struct(g["letters"].alias("letters"), (g["n"] * each).alias("n")))
    rows = rows.join(hot, "sample_id", "left").select("sample_id", part.alias("part"), "judge", given.alias("given"))
    return cut(rows.repartition("sample_id", "part"))


def _over(term) -> Column:
    """The sum of a term over the judge's rankings of the sample, of which most judges have one."""
    first = F.get("given", F.lit(0))
    return F.when(F.size("given") == 1, term(first["letters"], first["n"])).otherwise(
        F.aggregate("given", F.lit(0.0), lambda total, g: total + term(g["letters"], g["n"]))
    )


def _scored(rows: DataFrame, accuracy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with their own weighted votes A..F, and (sample_id, tA..tF): the sums of all judges."""
    w = F.array(*[F.log(F.get("accuracy", F.lit(p)) / CHANCE[p]) for p in range(K + 1)])
    own = rows.join(accuracy.select("judge", w.alias("w")), "judge")
    own = own.select("sample_id", "part", "judge", "given", *[_over(lambda letters, n, x=x: n * F.get("w", F.instr(letters, x))).alias(x) for x in LETTERS])
    parts = own.groupBy("sample_id", "part").agg(*[F.sum(x).alias("t" + x) for x in LETTERS])
    return own, parts.groupBy("sample_id").agg(*[F.sum("t" + x).alias("t" + x) for x in LETTERS])


def _best(score: dict[str, Column], tie: dict[str, Column] | None = None) -> Column:
    """The letter of the highest score; ties go to the lower tie value, then to the earlier letter."""
    fields = [F.struct((-F.round(score[x], 9)).alias("s"), *([tie[x].alias("m")] if tie else []), F.lit(x).alias("x")) for x in LETTERS]
    return F.array_min(F.array(*fields))["x"]


def reweighted(rows: DataFrame) -> DataFrame:
    """(judge, accuracy) by place, once the accuracies are stable; rows are ballots()."""
    places = range(K + 1)
    accuracy = stored(rows.select("judge").distinct().withColumn("accuracy", F.array(*[F.lit(x) for x in START])))
    for k in range(ROUNDS):
        own, totals = _scored(rows, accuracy)
        rest = {x: F.col("t" + x) - F.col(x) for x in LETTERS}
        spread = F.greatest(*rest.values()) - F.least(*rest.values())
        seen = own.join(totals, "sample_id").select("judge", "given", F.when(spread > 1e-9, _best(rest)).alias("label"))
        at = [_over(lambda letters, n, p=p: F.when(F.instr(letters, F.col("label")) == p, n).otherwise(0.0)).alias(f"c{p}") for p in places]
        sums = seen.select("judge", *at).groupBy("judge").agg(*[F.sum(f"c{p}").alias(f"c{p}") for p in places])
        total = sum((F.col(f"c{p}") for p in places), F.lit(0.0)) + PRIOR
        step = [((F.col(f"c{p}") + PRIOR * CHANCE[p]) / total - F.get("accuracy", F.lit(p))) / 2 ** (k // DAMPING) for p in places]
        new = F.array(*[F.get("accuracy", F.lit(p)) + step[p] for p in places])
        nxt = sums.join(accuracy.select("judge", "accuracy"), "judge").select("judge", new.alias("accuracy"), F.greatest(*[F.abs(x) for x in step]).alias("move"))
        accuracy = stored(nxt, replaces=accuracy)
        move = accuracy.agg(F.max("move")).first()[0]
        if move is None or move < TOLERANCE:
            return accuracy.select("judge", "accuracy")
    raise RuntimeError(f"the accuracies have not settled after {ROUNDS} rounds: the last move was {move}")


def labelled(counted: DataFrame, rows: DataFrame, accuracy: DataFrame) -> DataFrame:
    """(sample_id, label, margin): the consensus and its lead over the next letter."""
    place = {x: F.when(F.instr("letters", x) > 0, F.instr("letters", x)).otherwise((K + 1 + F.length("letters")) / 2) for x in LETTERS}
    mean = counted.groupBy("sample_id").agg(*[F.round(F.sum(place[x] * F.col("n")) / F.sum("n"), 9).alias("m" + x) for x in LETTERS])
    _, totals = _scored(rows, accuracy)
    top = F.sort_array(F.array(*["t" + x for x in LETTERS]), asc=False)
    best = _best({x: F.col("t" + x) for x in LETTERS}, {x: F.col("m" + x) for x in LETTERS})
    return totals.join(mean, "sample_id").select("sample_id", best.alias("label"), F.round(F.get(top, F.lit(0)) - F.get(top, F.lit(1)), 4).alias("margin"))


def found(df: DataFrame) -> DataFrame:
    """(sample_id, label)."""
    counted = cut(votes(df))
    rows = ballots(counted)
    return labelled(counted, rows, reweighted(rows)).select("sample_id", "label")


def _first_choices(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sample_id, t, same) of samples with two or more votes, and one row e: expected disagreement of their first choices."""
    first = counted.groupBy("sample_id", F.substring("letters", 1, 1).alias("x")).agg(F.sum("n").alias("c"))
    per = first.groupBy("sample_id").agg(F.sum("c").alias("t"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same")).where("t > 1")
    share = first.join(per.select("sample_id"), "sample_id", "left_semi").groupBy("x").agg(F.sum("c").alias("c"))
    return per, share.agg((1 - F.sum(F.col("c") * (F.col("c") - 1)) / (F.sum("c") * (F.sum("c") - 1))).alias("e"))


def consensus(df: DataFrame) -> DataFrame:
    """(sample_id, label, margin, n_votes, agreement, alpha).

    agreement is the share of agreeing pairs among the sample's first choices (null for one vote);
    alpha is the chance-corrected agreement of the sample for missing ratings: one minus observed over
    expected disagreement, the latter from the first choices of all samples that have two or more.
    """
    counted = cut(votes(df))
    rows = ballots(counted)
    labels = labelled(counted, rows, reweighted(rows)).join(counted.groupBy("sample_id").agg(F.sum("n").alias("n_votes")), "sample_id")
    per, expected = _first_choices(counted)
    agreement = F.col("same") / (F.col("t") * (F.col("t") - 1))
    own = per.join(F.broadcast(expected)).select("sample_id", F.round(agreement, 6).alias("agreement"), F.when(F.col("e") > 0, F.round(1 - (1 - agreement) / F.col("e"), 6)).alias("alpha"))
    return labels.join(own, "sample_id", "left")


def agreement(df: DataFrame) -> DataFrame:
    """One row (n_samples, n_votes, observed, expected, alpha): Krippendorff's alpha of the first choices, missing ratings allowed.

    Each sample with two or more votes counts with its number of votes; without such samples the figures are null.
    """
    per, expected = _first_choices(cut(votes(df)))
    observed = per.agg(F.count("*").alias("n_samples"), F.sum("t").alias("n_votes"), (F.sum(F.col("t") - F.col("same") / (F.col("t") - 1)) / F.sum("t")).alias("o"))
    return observed.join(F.broadcast(expected)).select(
        "n_samples", "n_votes", F.round("o", 6).alias("observed"), F.round("e", 6).alias("expected"), F.when(F.col("e") > 0, F.round(1 - F.col("o") / F.col("e"), 6)).alias("alpha")
    )


def reliability(df: DataFrame) -> DataFrame:
    """(judge, n_votes, accuracy, kappa): smoothed leave-one-out accuracy of the judge's first choice, and its excess over chance."""
    first = F.get("accuracy", F.lit(1))
    counted = cut(votes(df))
    accuracy = reweighted(ballots(counted))
    got = counted.groupBy("judge").agg(F.sum("n").alias("n_votes")).join(accuracy, "judge")
    return got.select("judge", "n_votes", F.round(first, 6).alias("accuracy"), F.round((first - 1 / K) / (1 - 1 / K), 6).alias("kappa"))
