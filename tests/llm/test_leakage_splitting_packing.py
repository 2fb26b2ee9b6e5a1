import random

import numpy as np
import pytest

from rankloom.llm import leakage, packing, splitting, tokens
from rankloom.llm.textform import fold_codes


def brute(docs, items):
    out = set()
    for d, text in docs.items():
        f = "".join(map(chr, fold_codes(text)))
        for i, item in items.items():
            g = "".join(map(chr, fold_codes(item)))
            n = (len(g) + 1) // 2
            if g and any(g[p : p + n] in f for p in range(len(g) - n + 1)):
                out.add((d, i))
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    items = {k: " ".join(word() for _ in range(n)) for k, n in enumerate([3, 6, 9, 14, 20, 40, 90])} | {90: "", 91: "…"}
    docs = {}
    for d in range(120):
        body = [word() for _ in range(60)]
        item = items[rng.randrange(7)]
        cut = rng.randrange(30, 101) * len(item) // 100
        at = rng.randrange(0, len(item) - cut + 1)
        docs[d] = " ".join(body[:30]) + " " + item[at : at + cut].upper().replace(" ", ",​\n") + " " + " ".join(body[30:])
    docs[500] = ""
    df = spark.createDataFrame([(k, v, 1) for k, v in docs.items()] + [(501, None, 1), (None, "abc", 1)], "doc_id bigint, text string, item_id int")
    it = spark.createDataFrame(list(items.items()) + [(92, None)], "item_id bigint, text string")
    got = {(r.doc, r.item_id) for r in leakage.leaked(df, it, "doc_id", "text", "item_id", "text").collect()}
    assert got == brute(docs, items)


def test_any_number_of_items_by_shuffled_blocks(spark, monkeypatch):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    shared = " ".join(word() for _ in range(12))
    items = {k: " ".join(word() for _ in range(n)) for k, n in enumerate([2, 3, 6, 9, 14, 20, 40, 90])} | {20: f"{shared} one end", 21: f"{shared} another end", 90: "", 91: "x"}
    docs = {}
    for d in range(60):
        body = [word() for _ in range(50)]
        item = items[rng.choice([*range(8), 20])]
        size = rng.randrange(35, 101) * len(item) // 100
        at = rng.randrange(0, len(item) - size + 1)
        docs[d] = " ".join(body[:25]) + " " + item[at : at + size].upper() + " " + " ".join(body[25:])
    df = spark.createDataFrame([*docs.items(), (100, None), (101, "")], "doc_id bigint, text string")
    it = spark.createDataFrame([*items.items(), (92, None), (5, items[5])], "item_id bigint, text string")
    search = lambda: {tuple(r) for r in leakage.leaked(df, it, "doc_id", "text", "item_id", "text").collect()}
    whole = search()
    monkeypatch.setattr(leakage, "ITEMS_PER_PASS", 2)
    split = search()
    assert {r[:2] for r in split} == brute(docs, items) and {r[:4] for r in split} == {r[:4] for r in whole}
    assert leakage.leaked(df.limit(0), it, "doc_id", "text", "item_id", "text").count() == 0
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert leakage.leaked(df, none, "doc_id", "text", "item_id", "text").count() == 0


TEXTS = {
    "prose": "The bank left its rate at 3.5 percent. Nobody was surprised, said its head.\n" * 120,
    "one word": "x" * 5000,
    "chinese": "央行维持利率不变，市场并不恐慌。" * 300,
    "no marks": "字" * 4000,
    "emoji": "🙂" * 2000,
    "short": "Hello.",
}


@pytest.mark.parametrize("name", TEXTS)
@pytest.mark.parametrize("overlap", [0, 32])
def test_pieces(name, overlap):
    text, limit = TEXTS[name], 300
    got = splitting.split(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for a, b, n in got:
        assert n == tokens.count(text[a:b]) <= limit
    for (_, end, _), (start, _, _) in zip(got, got[1:]):
        assert start <= end
        if overlap:
            assert overlap <= tokens.count(text[start:end]) <= overlap + 8
    assert "".join(text[max(a, p) : b] for (a, b, _), p in zip(got, [0] + [e for _, e, _ in got])) == text


def test_installed_ranks_need_no_file(spark):
    with open(tokens.RANKS, "rb") as f:
        contents = f.read()
    tokens.install("/nowhere/ranks", contents)
    assert tokens.count("A sentence of words.", "/nowhere/ranks") == tokens.count("A sentence of words.")
    assert tokens.held(spark, tokens.RANKS).value == contents


def test_cuts_fall_on_sentences():
    text = TEXTS["prose"]
    for _, end, _ in splitting.split(text, 300, 32)[:-1]:
        assert text[:end].rstrip()[-1] in ".\n"


def test_cuts_are_the_best_of_all():
    text = "Ab c, de. Fg hi; jk"
    ends, cost = tokens.char_ends(text), splitting.penalties(text)
    n, limit, overlap = len(ends) - 1, 6, 1
    assert 8 <= n <= 16

    def price(at):
        total, pieces = 0.0, int(np.ceil((n - overlap) / (limit - overlap)))
        mean, last = (n + (pieces - 1) * overlap) / pieces, 0
        for t in (*at, n):
            if t - last > limit or t - last <= 0:
                return np.inf
            total += splitting.IMBALANCE * ((t - last - mean) / mean) ** 2 + (cost[ends[t]] if t < n else 0)
            last = t - overlap
        return total

    best = min(price([t for t in range(1, n) if bits >> t & 1]) for bits in range(0, 1 << n, 2))
    got = splitting.cuts(cost, ends, limit, overlap)
    assert abs(price([b for _, b in got[:-1]]) - best) < 1e-9


def test_pieces_never_exceed_the_limit(monkeypatch):
    monkeypatch.setattr(splitting.tokens, "count", lambda text, ranks=None: 400)
    with pytest.raises(ValueError):
        splitting.split(TEXTS["prose"], 300, 32)


def test_split_table(spark):
    rows = [(1, TEXTS["prose"]), (2, "short"), (3, None), (4, ""), (None, TEXTS["prose"])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = splitting.split_oversized(df, "doc_id", "text", 300, 32).collect()
    assert {r.doc for r in got} == {1} and [r.piece_no for r in sorted(got, key=lambda r: r.piece_no)] == list(range(len(got)))
    assert splitting.split("", 300, 32) == [] and splitting.split(None, 300, 32) == []
    with pytest.raises(ValueError):
        splitting.split("abc", 32, 32)


def check_bins(sizes, sources, clusters, capacity, bins):
    load, seen = {}, {}
    for n, c, b in zip(sizes, clusters, bins):
        load[b] = load.get(b, 0) + n
        if c is not None:
            assert c not in seen.setdefault(b, set())
            seen[b].add(c)
    assert max(load.values()) <= capacity
    return len(load)


def test_packing_is_tight_and_free_of_conflicts():
    rng = random.Random(4)
    sizes = [rng.randrange(1, 700) for _ in range(3000)]
    sources = [f"s{rng.randrange(60)}" if rng.random() > 0.3 else "hot" for _ in sizes]
    clusters = [rng.randrange(400) if rng.random() < 0.5 else None for _ in sizes]
    used = check_bins(sizes, sources, clusters, 2048, packing.pack(sizes, sources, clusters, 2048))
    assert used <= 1.03 * sum(sizes) / 2048 + 1


def mates(sources, bins):
    held = {}
    for s, b in zip(sources, bins):
        if s is not None:
            held[s, b] = held.get((s, b), 0) + 1
    return held


def test_sources_are_kept_apart():
    rng = random.Random(6)
    sizes = [rng.randrange(50, 700) for _ in range(2000)]
    even = [f"s{rng.randrange(40)}" for _ in sizes]
    bins = packing.pack(sizes, even, [None] * 2000, 2048)
    assert max(mates(even, bins).values()) == 1
    third = [f"s{rng.randrange(60)}" if rng.random() < 0.66 else "hot" for _ in sizes]
    bins = packing.pack(sizes, third, [None] * 2000, 2048)
    least = -(-sum(sizes) // 2048)
    held = mates(third, bins)
    assert third.count("hot") > least and max(n for (s, _), n in held.items() if s != "hot") == 1
    assert max(held.values()) <= 4 * -(-third.count("hot") // least)
    assert len(set(bins)) <= least / (1 - packing.WASTE) + 1


def test_given_groups_are_clusters(spark):
    df = spark.createDataFrame([(i, f"text number {i}", None) for i in range(6)], "doc_id bigint, text string, source string")
    groups = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 3)], "doc bigint, group_id bigint")
    got = {r.doc: r for r in packing.fill_containers(df, "doc_id", "text", "source", 300, groups=groups).collect()}
    assert len({got[i].container_id for i in (0, 1, 2)}) == 3 and len({r.container_id for r in got.values()}) == 3
    assert all(r.source_mates == 0 for r in got.values())


def test_packing_of_one_cluster_takes_a_bin_each():
    bins = packing.pack([10] * 50, [None] * 50, ["c"] * 50, 100)
    assert len(set(bins)) == 50
    assert packing.pack([], [], [], 100) == [] and packing.pack([100], ["s"], [None], 100) == [0]


def test_containers(spark):
    rows = [(1, TEXTS["prose"], "a"), (2, "short", None), (3, "short", "b"), (4, None, "a"), (5, "", "a"), (6, "other words", "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = packing.fill_containers(df, "doc_id", "text", "source", 300, shard_items=4).collect()
    load = {}
    for r in got:
        load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
    assert {r.doc for r in got} == {1, 2, 3, 6} and max(load.values()) <= 300
    assert len({r.container_id for r in got if r.doc in (2, 3)}) == 2
    assert sum(r.n_tokens for r in got if r.doc == 2) == tokens.count("short")
