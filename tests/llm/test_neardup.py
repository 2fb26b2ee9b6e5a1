import random

import numpy as np
import pytest

from rankloom.llm import neardup
from rankloom.llm.textform import fold_codes


def similarity(a, b):
    x, y = set(neardup.runs(fold_codes(a)).tolist()), set(neardup.runs(fold_codes(b)).tolist())
    return len(x & y) / max(1, len(x | y))


def edited(rng, words, share):
    out = list(words)
    for _ in range(max(1, int(len(words) * share))):
        out[rng.randrange(len(out))] = "".join(rng.choice("abcdefghij") for _ in range(6))
    return out


def brute(texts):
    ids = sorted(texts)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and similarity(texts[i], texts[j]) >= neardup.THRESHOLD:
                parent[find(j)] = find(i)
    groups = {}
    for i in ids:
        groups.setdefault(find(i), []).append(i)
    return {tuple(sorted(g)) for g in groups.values()}


@pytest.mark.parametrize("length", [12, 60, 400])
def test_groups_equal_brute_force(spark, length):
    rng = random.Random(length)
    vocabulary = ["".join(rng.choice("klmnopqrst") for _ in range(7)) for _ in range(3000)]
    texts, n = {}, 0
    for _ in range(12):
        words = [rng.choice(vocabulary) for _ in range(length)]
        for share in (0, 0.02, 0.05, 0.1):
            texts[n] = " ".join(edited(rng, words, share) if share else words)
            n += 1
    df = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "doc_id bigint, text string, h string")
    got = {}
    for r in neardup.near_duplicates(df, "doc_id", "text").collect():
        got.setdefault(r.group_id, []).append(r.doc)
    assert {tuple(sorted(g)) for g in got.values()} == brute(texts)


def test_edges(spark):
    rows = [(1, "abc"), (2, "ABC!"), (3, ""), (4, ""), (5, "…"), (6, None), (7, "x" * 300_000), (7, "x" * 300_000), (None, "abc")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc: r.group_id for r in neardup.near_duplicates(df, "doc_id", "text").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 7: 7}
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert neardup.near_duplicates(empty, "doc_id", "text").count() == 0


def test_large_bucket_goes_through_its_hub(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BUCKET", 3)
    rng = random.Random(5)
    words = ["".join(rng.choice("klmnopqrst") for _ in range(7)) for _ in range(80)]
    texts = {i: " ".join(edited(rng, words, 0.04)) for i in range(12)}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {}
    for r in neardup.near_duplicates(df, "doc_id", "text").collect():
        got.setdefault(r.group_id, []).append(r.doc)
    assert {tuple(sorted(g)) for g in got.values()} == brute(texts)


def test_links_of_large_buckets_are_all_counted(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BUCKET", 3)
    monkeypatch.setattr(neardup, "BLOCK", 5)
    rng = random.Random(6)
    texts = {}
    for family in range(2):
        words = ["".join(rng.choice("klmnopqrst") for _ in range(7)) for _ in range(80)]
        texts |= {100 * family + i: " ".join(edited(rng, words, 0.05)) for i in range(16)}
    want = {i: sum(similarity(t, u) >= neardup.THRESHOLD for j, u in texts.items() if i != j) for i, t in texts.items()}
    rows = [*texts.items(), (300, texts[0])]  # a copy is no link
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc: r.n_links for r in neardup.near_duplicates(df, "doc_id", "text").collect()}
    assert got == want | {300: want[0]} and 0 < sum(want.values())


def test_overlaps(monkeypatch):
    monkeypatch.setattr(neardup, "CHUNK", 7)
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, k).astype(np.uint64)) for k in (0, 1, 9, 30, 40)]
    want = [[len(np.intersect1d(x, y)) for y in sets[1:]] for x in sets]
    assert neardup.overlaps(sets, sets[1:]).tolist() == want


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(3)
    missed = 0
    for _ in range(400):
        n = int(rng.integers(100, 3000))
        a = rng.integers(0, 2**64, n, dtype=np.uint64)
        k = int(n * 0.3 / 1.7) + 1  # similarity just under 0.7 at worst
        b = np.r_[a[k:], rng.integers(0, 2**64, k - 2, dtype=np.uint64)]
        missed += not set(neardup.signatures(np.unique(a)).tolist()) & set(neardup.signatures(np.unique(b)).tolist())
    assert missed <= 4


@pytest.mark.parametrize(("small", "large"), [(14, 20), (35, 50), (140, 200), (1000, 1428)])
def test_sets_of_neighbouring_bands_share_a_signature(small, large):
    rng = np.random.default_rng(small)
    missed = 0
    for _ in range(500):
        b = np.unique(rng.integers(0, 2**64, large, dtype=np.uint64))
        a = np.sort(rng.choice(b, small, replace=False))  # contained, so similarity is the ratio of sizes
        missed += not set(neardup.signatures(a).tolist()) & set(neardup.signatures(b).tolist())
    assert missed <= 1


def test_sketch_agreement():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**64, 2000, dtype=np.uint64))
    b = np.unique(np.r_[a[350:], rng.integers(0, 2**64, 350, dtype=np.uint64)])
    x, y = (np.frombuffer(neardup.sketch(s), np.uint8) for s in (a, b))
    same = neardup.SKETCH - int(np.bitwise_count(x ^ y).sum())
    assert same > neardup.SKETCH * 0.75


@pytest.mark.parametrize(("small", "large"), [(12, 12), (12, 17), (23, 32), (32, 32), (45, 64), (63, 63), (90, 128), (127, 127), (180, 256), (370, 520), (740, 1040), (2100, 3000)])
def test_misses_at_the_threshold(small, large):
    rng = np.random.default_rng(large + small)
    both = min(small, -(-7 * (small + large) // 17))
    missed = 0
    for _ in range(400):
        f = np.unique(rng.integers(0, 2**64, small + large - both, dtype=np.uint64))
        rng.shuffle(f)
        missed += not set(neardup.signatures(f[:small]).tolist()) & set(neardup.signatures(np.r_[f[:both], f[small:]]).tolist())
    assert missed == 0


def test_signatures_name_band_partition_subset_and_content():
    rng = np.random.default_rng(7)
    a = np.unique(rng.integers(0, 2**64, 200, dtype=np.uint64))
    assert len(set(neardup.signatures(a).tolist())) == len(neardup.signatures(a)) > 50
    b = np.unique(rng.integers(0, 2**64, 200, dtype=np.uint64))
    assert not set(neardup.signatures(a).tolist()) & set(neardup.signatures(b).tolist())
    assert neardup.signatures(np.zeros(0, np.uint64)).size == 0


def test_blocks_of_far_document_numbers(spark):
    rows = [(i * 10**12 - 5, "one text about the harbour at night" if i % 2 else f"other words {i} " * 5) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc: r.group_id for r in neardup.near_duplicates(df, "doc_id", "text").collect()}
    odd = [i * 10**12 - 5 for i in (1, 3, 5)]
    assert {got[d] for d in odd} == {odd[0]} and len(got) == 6
