import math
import random

import pytest

from rankloom.llm import consensus, ranking

SCHEMA = "judge string, sample_id bigint, rep int, t_map map<string,string>, reverse_map map<string,string>, ranking array<string>, letter_ranking array<string>, tokens bigint"


def row(judge, sample, rep, order, shown=None):
    labels = {x: f"T{i + 1}" for i, x in enumerate("CAFEBD")}
    t = {v: k for k, v in labels.items()}
    return (judge, sample, rep, t, labels, shown if shown is not None else [labels[x] for x in order], None, 1)


def simulated(rng, samples=150):
    best, rows = {}, []
    skill = {f"good{i}": 0.85 for i in range(3)} | {f"mid{i}": 0.45 for i in range(4)} | {f"noise{i}": 1 / 6 for i in range(3)}
    for s in range(samples):
        best[s] = rng.choice("ABCDEF")
        for j in rng.sample([*skill, "reversed"], 7):
            rest = [x for x in "ABCDEF" if x != best[s]]
            rng.shuffle(rest)
            if j == "reversed":
                order = rest + [best[s]]
            elif rng.random() < skill[j]:
                order = [best[s]] + rest
            else:
                at = rng.randrange(1, 6)
                order = rest[:at] + [best[s]] + rest[at:]
            rows.append(row(j, s, 1, order))
    return best, rows


def test_consensus_recovers_the_best_letter(spark):
    best, rows = simulated(random.Random(2))
    df = spark.createDataFrame(rows + rows[:20], SCHEMA)
    got = {r.sample_id: r.label for r in consensus.consensus(df).collect()}
    assert sum(got[s] == x for s, x in best.items()) / len(best) >= 0.93
    plain = {}
    for r in rows:
        plain.setdefault(r[1], []).append(r[3][r[5][0]])
    majority = sum(max(sorted(set(v)), key=v.count) == best[s] for s, v in plain.items()) / len(best)
    assert sum(got[s] == x for s, x in best.items()) / len(best) > majority
    rel = {r.judge: r.accuracy for r in consensus.reliability(df).collect()}
    assert rel["good0"] > rel["mid0"] > rel["reversed"]


def test_dirty_rankings(spark):
    good = [row(f"j{i}", 1, 1, "ABCDEF") for i in range(3)]
    dirty = [
        row("j1", 1, 1, "ABCDEF"),  # delivered again
        row("J2 ", 2, 1, "", ["t2", "T9", "t1", "T1"]),  # spelling, unknown and repeated labels: A, C
        row("j3", 3, 1, "", []), row("j4", 3, 1, "", None)[:5] + (None, None, 1), row(None, 4, 1, "ABCDEF"), row("j5", None, 1, "ABCDEF"),
        row("j6", 5, 1, "", [])[:6] + (["D", "A"], 1),
    ]
    df = spark.createDataFrame(good + dirty, SCHEMA)
    counted = {(r.sample_id, r.judge): r.letters for r in consensus.votes(df).collect()}
    assert counted[(2, "j2")] == "AC" and counted[(5, "j6")] == "DA" and (3, "j3") not in counted
    got = {r.sample_id: (r.label, r.n_votes, r.agreement) for r in consensus.consensus(df).collect()}
    assert got[1][:2] == ("A", 3) and got[1][2] == 1.0 and got[2][0] == "A" and got[5][0] == "D" and set(got) == {1, 2, 5}
    empty = spark.createDataFrame([], SCHEMA)
    assert consensus.consensus(empty).count() == 0 and consensus.reliability(empty).count() == 0


def test_hot_samples_are_split_and_the_result_is_the_same(spark, monkeypatch):
    _, rows = simulated(random.Random(4), 20)
    rows += [row(f"extra{i}", 0, 1, "BACDEF") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = {r.sample_id: (r.label, r.margin) for r in consensus.consensus(df).collect()}
    assert len(whole) == 20
    monkeypatch.setattr(consensus, "HOT", 7)
    assert {r.sample_id: (r.label, r.margin) for r in consensus.consensus(df).collect()} == whole
    assert consensus.ballots(consensus.votes(df)).where("sample_id = 0").select("part").distinct().count() > 1


def test_unsettled_accuracies_raise(spark, monkeypatch):
    _, rows = simulated(random.Random(5), 20)
    monkeypatch.setattr(consensus, "ROUNDS", 1)
    with pytest.raises(RuntimeError, match="not settled"):
        consensus.found(spark.createDataFrame(rows, SCHEMA))


def test_overall_agreement(spark):
    rows = [row("j1", 1, 1, "ABCDEF"), row("j2", 1, 1, "ABCDEF"), row("j3", 1, 1, "BACDEF"), row("j1", 2, 1, "CABDEF"), row("j2", 2, 1, "CABDEF"), row("j1", 3, 1, "ABCDEF")]
    got = consensus.agreement(spark.createDataFrame(rows, SCHEMA)).first()
    # coincidences: sample 1 disagrees in 4 of 6 ordered pairs, sample 2 in none; values A A B C C
    observed, expected = (4 / 2 + 0) / 5, 1 - (2 + 0 + 2) / 20
    assert (got.n_samples, got.n_votes) == (2, 5) and abs(got.observed - observed) < 1e-6 and abs(got.alpha - (1 - observed / expected)) < 1e-6
    none = consensus.agreement(spark.createDataFrame([], SCHEMA)).first()
    assert none.n_samples == 0 and none.alpha is None


OBS = "obs_id bigint, model string, candidate_a string, candidate_b string, winner string, ranking array<string>"


def test_scaling_recovers_strengths_from_uneven_counts():
    s = {"a": 1.5, "b": 0.4, "c": -0.3, "d": -1.6}
    counts = []
    for x in s:
        for y in s:
            if x != y:
                n = 10_000 * (1 + 30 * ({x, y} == {"a", "b"}))
                counts.append((x, y, n / (1 + math.exp(s[y] - s[x]))))
    got = ranking.scale_local(counts)
    assert all(abs(got[x] - v) < 0.01 for x, v in s.items())
    assert ranking.scale_local([]) == {}


def likely(counts):
    """The most likely strengths, by plain ascent."""
    items = sorted({x for w, l, _ in counts for x in (w, l)})
    s = dict.fromkeys(items, 0.0)
    for _ in range(4000):
        g = dict.fromkeys(items, 0.0)
        for w, l, n in counts:
            p = n / (1 + math.exp(s[w] - s[l]))
            g[w] += p
            g[l] -= p
        s = {x: v + 0.004 * g[x] for x, v in s.items()}
    mean = sum(s.values()) / len(s)
    return {x: v - mean for x, v in s.items()}


def test_scaling_is_near_the_most_likely_fit_of_noisy_counts():
    rng = random.Random(8)
    counts = [(x, y, rng.randrange(1, 60)) for x in "abcdef" for y in "abcdef" if x != y and (x, y) not in (("a", "f"), ("f", "a"))]
    smooth = [(x, y, n + ranking.SMOOTHING) for x, y, n in counts]
    want, got = likely(smooth), ranking.scale_local(counts)
    assert all(abs(want[x] - got[x]) < 0.15 for x in want)  # a standard error is about as large


def test_rows_and_columns_are_balanced():
    rng = random.Random(9)
    counts = [(x, y, rng.randrange(1, 60)) for x in "abcdef" for y in "abcdef" if x < y or rng.random() < 0.5 and x != y]
    s = ranking.scale_local(counts)
    cell = {}
    for w, l, n in counts:
        for pair, c in (((w, l), n), ((l, w), 0)):
            cell[pair] = cell.get(pair, ranking.SMOOTHING) + c
    ties = sum(cell.values()) / len(s)
    cell |= {(x, x): ties for x in s}
    off, dfn = dict.fromkeys(s, 1.0), dict.fromkeys(s, 1.0)
    for _ in range(5000):  # plain Sinkhorn, one cell after the other
        off = {x: sum(v / dfn[j] for (i, j), v in cell.items() if i == x) for x in s}
        dfn = {x: sum(v / off[i] for (i, j), v in cell.items() if j == x) for x in s}
    mean = sum(math.log(off[x] / dfn[x]) for x in s) / len(s)
    assert all(abs(math.log(off[x] / dfn[x]) - mean - s[x]) < 1e-7 for x in s)


def chain(n):
    pairs = [(f"i{k:03}", f"i{k + 1:03}") for k in range(n - 1)]
    return [(a, b, 3) for a, b in pairs] + [(b, a, 1) for a, b in pairs]


def test_long_chain_settles():
    s = ranking.scale_local(chain(61))
    gaps = [s[f"i{k:03}"] - s[f"i{k + 1:03}"] for k in range(60)]
    assert all(abs(g - math.log(3.1 / 1.1)) < 1e-5 for g in gaps)


def test_unsettled_scaling_raises(spark, monkeypatch):
    monkeypatch.setattr(ranking, "ROUNDS", 3)
    with pytest.raises(RuntimeError, match="not settled"):
        ranking.scale_local(chain(30))
    with pytest.raises(RuntimeError, match="not settled"):
        ranking.scale_distributed(spark.createDataFrame(chain(30), "winner string, loser string, n bigint"))


def test_star_of_comparisons():
    got = ranking.scale_local([("hub", "a", 30), ("a", "hub", 10), ("hub", "b", 10), ("b", "hub", 30)], smoothing=0.0)
    assert abs(got["b"] - got["hub"] - math.log(3)) < 0.01 and abs(got["hub"] - got["a"] - math.log(3)) < 0.01


def test_local_and_distributed_agree(spark, monkeypatch):
    counts = [("a", "b", 3), ("b", "a", 2), ("b", "c", 4), ("c", "b", 3), ("a", "c", 5)]
    df = spark.createDataFrame(counts, "winner string, loser string, n bigint")
    near = ranking.scale_local(counts)
    monkeypatch.setattr(ranking, "MAX_LOCAL_PAIRS", 2)
    far = {r.system: r.log_strength for r in ranking.strengths(df).collect()}
    assert far.keys() == near.keys() and all(abs(far[x] - near[x]) < 1e-8 for x in near)


def test_verdicts(spark):
    rows = [
        (1, "j", "s1", "s2", " S1", None), (1, "j", "s1", "s2", " S1", None), (2, "j", "s1", "s2", None, ["s2", "s1"]), (3, "j", "s1", "s2", "tie", None),
        (4, "j", "s1", "s1", "s1", None), (5, "j", "s1", "s2", "s9", None), (6, "j", "s1", "s2", None, None), (None, "j", "s1", "s2", "s1", None), (7, "j", None, "s2", "s2", None),
        (8, "j", "s1", "s2", "", ["S1 ", "s2"]),
    ]
    df = spark.createDataFrame(rows, OBS)
    assert sorted(map(tuple, ranking.verdicts(df).collect())) == [("s1", "s2"), ("s1", "s2"), ("s2", "s1")]
    assert [r.system for r in ranking.global_ranking(df).orderBy("place").collect()] == ["s1", "s2"]
    assert ranking.stronger_pairs(spark.createDataFrame([], OBS)).count() == 0
    won = spark.createDataFrame([(i, "j", "x", "y", "x", None) for i in range(9)], OBS)
    assert [tuple(r) for r in ranking.stronger_pairs(won).collect()] == [("x", "y", "x")]
