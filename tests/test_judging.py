import random

from pyspark.sql import functions as F

from rankloom.operators import judging, records
from rankloom.operators.components import connected_components

SCHEMA = "judge string, sample_id bigint, rep int, t_map map<string,string>, ranking array<string>"


def row(judge, sample, order, rep=1):
    t = {f"T{i + 1}": x for i, x in enumerate("FEDCBA")}
    back = {v: k for k, v in t.items()}
    return (judge, sample, rep, t, [back[x] for x in order])


def test_decoding_and_validity(spark):
    rows = [row("j1", 1, "ABCDEF"), row("J1 ", 1, "ABCDEF"), row("j2", 1, "ABC"), ("j3", 1, 1, {"T1": "A"}, None), ("j4", 1, 1, {"T1": "A"}, ["t1", "T9"])]
    got = {(r.judge, r.letters): r.valid for r in judging.decoded(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("j1", "ABCDEF"): True, ("j2", "ABC"): False, ("j3", ""): False, ("j4", "A?"): False}


def test_agreement_properties(spark):
    rng = random.Random(1)
    rows = [row(j, s, rng.sample("ABCDEF", 6)) for s in range(20) for j in ("a", "b", "c")] + [row("d", s, "ABCDEF") for s in range(20)] + [row("e", s, "ABCDEF") for s in range(20)]
    wide = judging.ranks(spark.createDataFrame(rows, SCHEMA))
    got = {(r.model_a, r.model_b): (r.agreement, r.n) for r in judging.pairwise_agreement(wide).collect()}
    assert got[("d", "e")] == (1.0, 300) and len(got) == 10 and all(a < b for a, b in got)
    sums = judging.rank_sums(wide).collect()
    assert all(sum(r[x] for x in "ABCDEF") == 5 * 21 for r in sums)


def test_consensus_condorcet_and_dissent(spark):
    rows = [row("a", 1, "ABCDEF"), row("b", 1, "ABDCEF"), row("c", 1, "BACDEF"), row("a", 2, "ABCDEF"), row("b", 2, "BCADEF"), row("c", 2, "CABDEF")]
    wide = judging.ranks(spark.createDataFrame(rows, SCHEMA)).cache()
    cons = {r.sample_id: r.consensus_order for r in judging.consensus(wide).collect()}
    assert cons == {1: "A>B>C>D>E>F", 2: "A>B>C>D>E>F"}
    assert {r.sample_id: r.winner for r in judging.condorcet(wide).collect()} == {1: "A", 2: None}
    assert {r.judge: r.n_lone for r in judging.lone_dissent(wide).collect()} == {"c": 1}
    exact = {r.judge: r.exact_match for r in judging.judge_vs_consensus(wide).collect()}
    assert exact == {"a": 1.0, "b": 0.0, "c": 0.0}
    assert judging.pair_judgements(wide).count() == 6 * 15


def test_blind_labels_are_stable_permutations(spark):
    df = spark.createDataFrame([(s, x) for s in range(5) for x in "ABCDEF"], "sample_id bigint, letter string")
    one = sorted(map(tuple, judging.blind_labels(df).collect()))
    assert one == sorted(map(tuple, judging.blind_labels(df.orderBy(F.desc("letter"))).collect())) and len({m for _, m, _ in one}) > 1


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 360)] + [(None, 3), (7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def test_variant_parser_survives_bare_quotes():
    good = '{"variants": [' + ", ".join(f'{{"id": "{x}", "translation": "t{x}"}}' for x in "ABCDEF") + "]}"
    assert records.parse_variants(good) == [(x, f"t{x}") for x in "ABCDEF"]
    assert records.parse_variants("```json\n" + good + "\n```") == records.parse_variants(good)
    broken = good.replace('"tC"', '"he said "yes" twice"')
    assert dict(records.parse_variants(broken))["C"] == 'he said "yes" twice'
    assert records.parse_variants(good.replace('"F"', '"E"')) is None and records.parse_variants(None) is None and records.parse_variants("no") is None
