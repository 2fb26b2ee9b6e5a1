"""Global ranking from pairwise verdicts by offence-defence scaling.

The smoothed win matrix A (A[i][j]: times i beat j) is balanced by Sinkhorn iterations: the offence of an
item is the sum of its row over the defences of those it beat, its defence the sum of its column over the
offences of those that beat it, and offence over defence is its strength. If A[i][j] = s_i * q_ij with any
symmetric q, as in the Bradley-Terry model with uneven numbers of comparisons, the scalings of the symmetric
part cancel and offence / defence is s, so log strengths are log-odds.

Smoothing adds SMOOTHING wins in either direction to every pair that was compared, and to every item as many
ties with itself as an item has wins on average. Both are symmetric. With the ties every pattern of
comparisons has a balanced form, and items of few comparisons don't weigh more than those of many. Items
that no chain of comparisons links can't be ranked against each other; their strengths are those within their
own part.

Both scalings are over-relaxed in logarithms by the rate at which they settle (Pace). They stop when no
log offence or defence moves by more than TOLERANCE, and raise if ROUNDS rounds don't suffice. Only the
(winner, loser) counts of systems are iterated on: on the driver if they are at most MAX_LOCAL_PAIRS
(checked, a few sparse arrays), else by the same iterations as DataFrame aggregations with the same pace,
tolerance and bound.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.screening import numbered
from ..session import cut, stored

MAX_LOCAL_PAIRS = 250_000
#: Wins added in either direction to every pair that was compared at all.
SMOOTHING = 0.1
TOLERANCE = 1e-9
ROUNDS = 20_000


def _clean(c: str) -> Column:
    return F.lower(F.trim(F.col(c)))


def verdicts(df: DataFrame) -> DataFrame:
    """(winner, loser) of each decided comparison of two different systems, one per obs_id.

    The winner counts if it is one of the pair; where it is missing, the first of the ranking counts.
    Ties, verdicts outside the pair, self-comparisons and rows without ids are no decided comparisons.
    Re-delivered rows share their obs_id and count once.
    """
    a, b, w = _clean("candidate_a"), _clean("candidate_b"), F.nullif(_clean("winner"), F.lit(""))
    first = F.lower(F.trim(F.get("ranking", F.lit(0))))
    rows = df.select("obs_id", a.alias("a"), b.alias("b"), F.coalesce(w, first).alias("w")).where(
        "obs_id is not null and a <> b and a <> '' and b <> '' and (w = a or w = b)"
    )
    once = rows.groupBy("obs_id").agg(F.min(F.struct("a", "b", "w")).alias("v")).select("v.*")
    return once.select(F.col("w").alias("winner"), F.when(F.col("w") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("loser"))


def win_counts(won: DataFrame) -> DataFrame:
    return won.groupBy("winner", "loser").agg(F.count("*").alias("n"))


class Pace:
    """The relaxation of the next round from the moves of the rounds so far.

    Plain rounds (1.0) show the rate r at which moves shrink; 2 / (1 + sqrt(1 - r)) is the best relaxation
    for it. Later the rate of the relaxed rounds is traced back to that of plain ones, and where moves
    grow the relaxation is lowered.
    """

    FIRST, AGAIN, OVER = 12, 40, 6

    def __init__(self):
        self.omega, self.moves, self.since = 1.0, [], 0

    def next(self, move: float) -> float:
        self.moves.append(move)
        self.since += 1
        if self.since < (self.FIRST if self.omega == 1 else self.AGAIN) or move == 0:
            return self.omega
        self.since = 0
        r = (move / self.moves[-1 - self.OVER]) ** (1 / self.OVER)
        if r >= 1:
            self.omega = 1 + (self.omega - 1) * 0.7
        else:
            plain = r if self.omega == 1 else (r + self.omega - 1) ** 2 / (self.omega**2 * r)
            self.omega = 2 / (1 + np.sqrt(1 - min(plain, 0.999999)))
        return self.omega


def scale_local(counts: list[tuple[str, str, float]], smoothing: float = SMOOTHING) -> dict[str, float]:
    """Log strength by item, mean 0."""
    items = sorted({x for w, l, _ in counts for x in (w, l)})
    if not items:
        return {}
    at = {x: k for k, x in enumerate(items)}
    size = len(items)
    w, l = (np.array([at[c[k]] for c in counts], np.int64) for k in (0, 1))
    cell, where = np.unique(np.r_[w * size + l, l * size + w], return_inverse=True)
    v = np.bincount(where, np.r_[[float(c[2]) for c in counts], np.zeros(len(counts))]) + smoothing
    i, j = cell // size, cell % size
    ties = v.sum() / size
    offence, defence = np.zeros(size), np.full(size, np.log(ties))
    pace, omega = Pace(), 1.0
    for _ in range(ROUNDS):
        up = np.log(np.bincount(i, v * np.exp(-defence[j]), size) + ties * np.exp(-defence)) - offence
        offence = offence + omega * up
        down = np.log(np.bincount(j, v * np.exp(-offence[i]), size) + ties * np.exp(-offence)) - defence
        defence = defence + omega * down
        move = float(max(np.abs(up).max(), np.abs(down).max()))
        if move < TOLERANCE:
            break
        omega = pace.next(move)
    else:
        raise RuntimeError(f"the scaling has not settled after {ROUNDS} rounds: the last move was {move}")
    s = offence - defence
    return {x: float(v) for x, v in zip(items, s - s.mean())}


def scale_distributed(counts: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """(system, log_strength) by the same scaling, for more pairs than the driver should hold.

    Each round is two sums over the pairs, joined with one row per item; its state replaces the one before.
    """
    both = counts.select(F.col("winner").alias("i"), F.col("loser").alias("j"), "n").union(counts.select("loser", "winner", F.lit(0).cast("bigint")))
    A = cut(both.groupBy("i", "j").agg((F.sum("n") + smoothing).alias("v")))
    items = A.groupBy(F.col("i").alias("x")).agg(F.sum("v").alias("v"))
    total = items.agg(F.sum("v") / F.count("*")).first()[0]
    if total is None:
        return counts.sparkSession.createDataFrame([], "system string, log_strength double")
    ties = float(total)
    state = stored(items.select("x", F.lit(0.0).alias("o"), F.lit(float(np.log(ties))).alias("d")))
    pace, omega = Pace(), 1.0
    for _ in range(ROUNDS):
        by_j = state.select(F.col("x").alias("j"), "d")
        rows = A.join(by_j, "j").groupBy(F.col("i").alias("x")).agg(F.sum(F.col("v") * F.exp(-F.col("d"))).alias("t"))
        up = F.log(F.col("t") + ties * F.exp(-F.col("d"))) - F.col("o")
        off = state.join(rows, "x").select("x", "d", (F.col("o") + omega * up).alias("o"), F.abs(up).alias("up"))
        by_i = off.select(F.col("x").alias("i"), "o")
        cols = A.join(by_i, "i").groupBy(F.col("j").alias("x")).agg(F.sum(F.col("v") * F.exp(-F.col("o"))).alias("t"))
        down = F.log(F.col("t") + ties * F.exp(-F.col("o"))) - F.col("d")
        nxt = off.join(cols, "x").select("x", "o", (F.col("d") + omega * down).alias("d"), F.greatest("up", F.abs(down)).alias("move"))
        state = stored(nxt, replaces=state)
        move = state.agg(F.max("move")).first()[0]
        if move < TOLERANCE:
            break
        omega = float(pace.next(move))
    else:
        raise RuntimeError(f"the scaling has not settled after {ROUNDS} rounds: the last move was {move}")
    mean = state.agg(F.avg(F.col("o") - F.col("d"))).first()[0]
    return state.select(F.col("x").alias("system"), (F.col("o") - F.col("d") - mean).alias("log_strength"))


def strengths(counts: DataFrame) -> DataFrame:
    """(system, log_strength) from (winner, loser, n)."""
    spark = counts.sparkSession
    rows = counts.limit(MAX_LOCAL_PAIRS + 1).collect()
    if len(rows) > MAX_LOCAL_PAIRS:
        return scale_distributed(counts)
    got = scale_local([(r.winner, r.loser, float(r.n)) for r in rows])
    return spark.createDataFrame(sorted(got.items()), "system string, log_strength double")


def global_ranking(df: DataFrame) -> DataFrame:
    """(place, system, log_strength, strength, decided): strongest first, ties by name; six digits."""
    counts = win_counts(verdicts(df))
    s = strengths(counts)
    n = counts.select(F.col("winner").alias("system"), "n").union(counts.select("loser", "n")).groupBy("system").agg(F.sum("n").alias("decided"))
    rows = s.join(n, "system").select("system", F.round("log_strength", 6).alias("log_strength"), "decided").withColumn("weakness", -F.col("log_strength"))
    return numbered(rows, ["weakness", "system"]).select(
        (F.col("row_no") + 1).alias("place"), "system", "log_strength", F.round(F.exp("log_strength"), 6).alias("strength"), "decided"
    )


def stronger_pairs(df: DataFrame, gap: float = 0.75) -> DataFrame:
    """(system_a, system_b, stronger) for every pair of systems whose log strengths differ by more than gap.

    Strengths fall into cells of width gap. A system is listed once for each later cell, of which there are as
    many as the range of strengths has gaps, and meets the systems of that cell by an equi-join; only those of
    the next cell can be too close.
    """
    s = strengths(win_counts(verdicts(df))).withColumn("cell", F.floor(F.col("log_strength") / gap))
    last = s.agg(F.max("cell")).first()[0]
    later = F.explode(F.sequence(F.col("cell") + 1, F.lit(last or 0)))
    weak = s.where(F.col("cell") < F.lit(last or 0)).select(F.col("system").alias("weak"), F.col("log_strength").alias("low"), later.alias("cell"))
    pairs = weak.join(s, "cell").where(F.col("log_strength") - F.col("low") > gap)
    return pairs.select(F.least("weak", "system").alias("system_a"), F.greatest("weak", "system").alias("system_b"), F.col("system").alias("stronger"))
