"""Evaluation passages inside a corpus, by SimHash windows and multi-index Hamming blocks.

Texts are compared in their folded form (consistent form, case ignored, letters and digits only). A
document contains an item if a run of at least half of the item's letters and digits stands in it.

Windows are sized by the item: of m blocks of STEP letters, m as large as a run of half the item still
covers at least one whole window of a grid of STEP letters in the document, wherever the run starts.
Documents are fingerprinted on that grid, items at every offset, both by a 64-bit SimHash of the
window's shingles. Fingerprints are looked up in BLOCKS disjoint bit blocks: two that differ in fewer
than BLOCKS bits agree in a whole block, so none within radius BLOCKS - 1 is missed. Candidates whose
window reaches the exact weighted-shingle similarity are extended letter by letter to the run itself.
Items too short for a window are looked up by all their runs of half length.

The corpus is scanned once for any number of items. Up to ITEMS_PER_PASS items (counted) their index is
broadcast and documents are searched where they stand. Beyond, fingerprints of items are a table; what is
broadcast are bitmaps of its bit blocks, whose size the bits bound. Only windows of documents with a known
block are shuffled; different fingerprints meet once, however many documents or items share them, and the
candidates they lead to are verified in the same way. Null texts, and items without letters or digits, match
nothing.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .neardup import mix
from .textform import fold_codes

STEP = 16
SHINGLE = 5
WINDOWS = (1, 2, 4, 8, 16)
BLOCKS = ((0, 21), (21, 21), (42, 22))
SIMILARITY = 0.8
ITEMS_PER_PASS = 5000
#: Bits of the hash of a short item's run that are looked up first.
RUN_BITS = 22
_K = np.uint64(0x9E3779B97F4A7C15)


def shingles(codes: np.ndarray) -> np.ndarray:
    """A hash per position of the run of SHINGLE letters that starts there."""
    n = len(codes) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    c = codes.astype(np.uint64)
    h = c[:n].copy()
    for i in range(1, SHINGLE):
        h = h * _K + c[i : n + i]
    return mix(h)


def needed(letters: int) -> int:
    """Letters of an item that a run must have."""
    return (letters + 1) // 2


def window_blocks(letters: int) -> int:
    """Blocks of the item's windows; 0 if even one block is too long."""
    room = (needed(letters) - SHINGLE + 1 - (STEP - 1)) // STEP
    return max([m for m in WINDOWS if m <= room], default=0)


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _pack(on: np.ndarray) -> np.ndarray:
    return np.packbits(on, axis=1, bitorder="little").view(np.uint64).ravel()


class Index:
    """Fingerprints of all windows of the items, by window size and bit block."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.codes = [], []
        for item, text in items:
            codes = fold_codes(text)
            if len(codes):
                self.ids.append(item)
                self.codes.append(codes)
        self.need = [needed(len(c)) for c in self.codes]
        self.hash = [shingles(c) for c in self.codes]
        spread: dict[int, int] = {}
        for h in self.hash:
            for x in np.unique(h).tolist():
                spread[x] = spread.get(x, 0) + 1
        self.weight = [np.array([1 / spread[x] for x in h.tolist()]) for h in self.hash]
        self.tables: dict[int, tuple] = {}
        self.short = ahocorasick.Automaton()
        self.short_any = False
        by_size: dict[int, list[int]] = {}
        for i, c in enumerate(self.codes):
            m = window_blocks(len(c))
            if m:
                by_size.setdefault(m, []).append(i)
                continue
            s = c.tobytes().decode("utf-32-le")
            for p in range(len(s) - self.need[i] + 1):
                run = s[p : p + self.need[i]]
                got = self.short.get(run, ())
                self.short.add_word(run, (*got, i) if i not in got else got)
                self.short_any = True
        if self.short_any:
            self.short.make_automaton()
        for m, own in by_size.items():
            finger, at, who = [], [], []
            for i in own:
                total = np.zeros((len(self.hash[i]) + 1, 64), np.int32)
                np.cumsum(_bits(self.hash[i]), axis=0, out=total[1:])
                w = m * STEP
                finger.append(_pack((total[w:] - total[:-w]) * 2 > w))
                at.append(np.arange(len(finger[-1]), dtype=np.int32))
                who.append(np.full(len(finger[-1]), i, np.int32))
            f, a, o = map(np.concatenate, (finger, at, who))
            blocks = []
            for lo, size in BLOCKS:
                key = (f >> np.uint64(lo)) & np.uint64((1 << size) - 1)
                order = np.argsort(key, kind="stable")
                key = key[order]
                known = np.zeros(1 << size, bool)
                known[key] = True
                blocks.append((np.uint64(lo), np.uint64((1 << size) - 1), known, key, order))
            self.tables[m] = (f, a, o, blocks)

    def candidates(self, h: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(item index, offset in the item, position in the document, window) within the radius."""
        n = len(h) // STEP
        if not n:
            return
        bits = _bits(h[: n * STEP]).reshape(n, STEP, 64)
        block = np.zeros((n + 1, 64), np.int32)
        np.cumsum(bits.sum(axis=1, dtype=np.uint8), axis=0, out=block[1:])
        for m, (f, a, o, blocks) in self.tables.items():
            if n < m:
                continue
            w = m * STEP
            finger = _pack((block[m:] - block[:-m]) * 2 > w)
            for lo, mask, known, key, order in blocks:
                k = (finger >> lo) & mask
                hit = np.flatnonzero(known[k])
                if not len(hit):
                    continue
                left, right = np.searchsorted(key, k[hit], "left"), np.searchsorted(key, k[hit], "right")
                for p, x, y in zip(hit.tolist(), left.tolist(), right.tolist()):
                    j = order[x:y]
                    j = j[np.bitwise_count(f[j] ^ finger[p]) < len(BLOCKS)]
                    for q in j.tolist():
                        yield int(o[q]), int(a[q]), p * STEP, w

    def found(self, text: str) -> dict[int, tuple[int, float]]:
        """Item index -> (letters of the longest run, similarity of its window)."""
        codes = fold_codes(text)
        out: dict[int, tuple[int, float]] = {}
        if len(codes) == 0:
            return out
        if self.short_any:
            for _, who in self.short.iter(codes.tobytes().decode("utf-32-le")):
                for i in who:
                    out[i] = (self.need[i], 1.0)
        h = shingles(codes)
        done: dict[int, set] = {}
        for i, at, pos, w in self.candidates(h):
            if pos - at in done.setdefault(i, set()):
                continue
            wt, mine = self.weight[i][at : at + w], self.hash[i][at : at + w]
            sim = float(wt[np.isin(mine, h[pos : pos + w])].sum() / wt.sum())
            if sim < SIMILARITY:
                continue
            n = run_through(codes, self.codes[i], pos - at, pos, pos + w)
            if n >= self.need[i]:
                done[i].add(pos - at)
                if n > out.get(i, (0, 0))[0]:
                    out[i] = (n, sim)
        return out


def run_through(doc: np.ndarray, item: np.ndarray, shift: int, lo: int, hi: int) -> int:
    """The longest run of equal letters, item laid over the document at shift, that meets [lo, hi)."""
    a, b = max(0, shift), min(len(doc), shift + len(item))
    same = doc[a:b] == item[a - shift : b - shift]
    edge = np.flatnonzero(np.diff(np.r_[0, same.view(np.int8), 0]))
    starts, ends = edge[::2] + a, edge[1::2] + a
    meets = (starts < hi) & (ends > lo)
    return int((ends - starts)[meets].max(initial=0))


@functools.lru_cache(maxsize=2)
def _index(items: tuple[tuple[int, str], ...]) -> Index:
    return Index(list(items))


def _search(items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(items.value)
        for batch in batches:
            rows = [
                (doc, index.ids[i], n, n / len(index.codes[i]), sim)
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                if text
                for i, (n, sim) in index.found(text).items()
            ]
            cols = list(zip(*rows)) or [(), (), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))],
                ["doc", "item_id", "run_letters", "share", "similarity"],
            )

    return run


def run_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of the run of k letters at each position."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    c = codes.astype(np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * _K + c[i : n + i] + np.uint64(1)
    return mix(h)


def window_prints(h: np.ndarray, m: int, step: int = 1) -> np.ndarray:
    """Fingerprints of the windows of m blocks of shingles, at every step-th position."""
    w = m * STEP
    if len(h) < w:
        return np.zeros(0, np.uint64)
    total = np.zeros((len(h) + 1, 64), np.int32)
    np.cumsum(_bits(h), axis=0, out=total[1:])
    return _pack((total[w:] - total[:-w])[::step] * 2 > w)


def _blocks(size: int) -> tuple[tuple[int, int], ...]:
    return BLOCKS if size > 0 else ((0, RUN_BITS),)


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(size, print, item_id, at): windows of size blocks; of short items, their half-length runs with minus their length as size."""
    for batch in batches:
        cols = [[], [], [], []]
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            codes = fold_codes(text)
            m = window_blocks(len(codes))
            k = needed(len(codes))
            p = window_prints(shingles(codes), m) if m else run_hashes(codes, k) if k else np.zeros(0, np.uint64)
            for c, x in zip(cols, (np.full(len(p), m or -k), p.view(np.int64), np.full(len(p), item), np.arange(len(p)))):
                c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *c]).astype(np.int64)) for c in cols], ["size", "print", "item_id", "at"])


def _doc_windows(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            cols = [[], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = fold_codes(text)
                h = shingles(codes)
                for size, maps in known.items():
                    step = STEP if size > 0 else 1
                    p = window_prints(h, size, step) if size > 0 else run_hashes(codes, -size)
                    hit = np.zeros(len(p), bool)
                    for (lo, bits), words in zip(_blocks(size), maps):
                        key = (p >> np.uint64(lo)) & np.uint64((1 << bits) - 1)
                        hit |= (words[key >> np.uint64(6)] >> (key & np.uint64(63))) & np.uint64(1) == 1
                    at = np.flatnonzero(hit)
                    for c, x in zip(cols, (np.full(len(at), doc), np.full(len(at), size), p[at].view(np.int64), at * step)):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *c]).astype(np.int64)) for c in cols], ["doc", "size", "print", "pos"])

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns doc, item_id, document text, item text, (shingle, spread) of the item, (size, pos, at) of its candidates."""
    for batch in batches:
        rows = []
        for doc, item, text, passage, spread, places in zip(*(batch.column(i).to_pylist() for i in range(6))):
            codes, own = fold_codes(text), fold_codes(passage)
            h, mine, need = shingles(codes), shingles(own), needed(len(own))
            share = {x["x"]: 1 / x["n"] for x in spread or []}
            weight = np.array([share[x] for x in mine.view(np.int64).tolist()])
            best = None
            for c in places:
                size, pos, at = c["size"], c["pos"], c["at"]
                if size < 0:
                    got = (need, 1.0) if np.array_equal(codes[pos : pos + need], own[at : at + need]) else None
                else:
                    w = size * STEP
                    sim = float(weight[at : at + w][np.isin(mine[at : at + w], h[pos : pos + w])].sum() / weight[at : at + w].sum())
                    n = run_through(codes, own, pos - at, pos, pos + w) if sim >= SIMILARITY else 0
                    got = (n, sim) if n >= need else None
                best = max(filter(None, (best, got)), default=None)
            if best:
                rows.append((doc, item, best[0], best[0] / len(own), best[1]))
        cols = list(zip(*rows)) or [()] * 5
        types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc", "item_id", "run_letters", "share", "similarity"])


def _item_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [np.unique(shingles(fold_codes(t))).view(np.int64) for t in batch.column(1).to_pylist()]
        item = [np.full(len(a), i) for a, i in zip(x, batch.column(0).to_pylist())]
        none = [np.zeros(0, np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(none + item).astype(np.int64)), pa.array(np.concatenate(none + x))], ["item_id", "x"])


def _by_blocks(df: DataFrame) -> DataFrame:
    """One row per bit block of a fingerprint: size, print, block, key."""
    cells = [F.struct(F.lit(b).alias("block"), F.shiftrightunsigned("print", lo).bitwiseAND(F.lit((1 << bits) - 1)).alias("key")) for b, (lo, bits) in enumerate(BLOCKS)]
    runs = F.array(F.struct(F.lit(0).alias("block"), F.col("print").bitwiseAND(F.lit((1 << RUN_BITS) - 1)).alias("key")))
    return df.select("size", "print", F.explode(F.when(F.col("size") > 0, F.array(*cells)).otherwise(runs)).alias("c")).select("size", "print", "c.*")


SCHEMA = "doc long, item_id long, run_letters long, share double, similarity double"


def leaked_by_blocks(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The same as a search of the broadcast index, by shuffled blocks; rows: (doc, text), wanted: (i, t)."""
    spark = rows.sparkSession
    index = cut(wanted.mapInArrow(_item_windows, "size long, print long, item_id long, at long"))
    prints = index.select("size", "print").distinct()
    word = F.shiftright("key", 6)
    bits = _by_blocks(prints).groupBy("size", "block", word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(key % 64 as int))")).alias("bits"))
    known: dict[int, list[np.ndarray]] = {}
    for r in bits.toLocalIterator():  # at most two to the 16th words a block, sizes and run lengths being few
        maps = known.setdefault(r["size"], [np.zeros((1 << b) // 64, np.uint64) for _, b in _blocks(r["size"])])
        maps[r.block][r.word] = np.uint64(r.bits % (1 << 64))
    hits = cut(rows.mapInArrow(_doc_windows(spark.sparkContext.broadcast(known)), "doc long, size long, print long, pos long"))
    theirs = _by_blocks(hits.select("size", "print").distinct())
    ours = _by_blocks(prints).withColumnRenamed("print", "own")
    near = F.when(F.col("size") > 0, F.bit_count(F.col("print").bitwiseXOR(F.col("own"))) < len(BLOCKS)).otherwise(F.col("print") == F.col("own"))
    match = theirs.join(ours, ["size", "block", "key"]).where(near).select("size", "print", "own").distinct()
    places = hits.join(match, ["size", "print"]).join(index.withColumnRenamed("print", "own"), ["size", "own"])
    places = cut(places.groupBy("doc", "item_id").agg(F.collect_set(F.struct("size", "pos", "at")).alias("places")))
    shingled = wanted.join(places.select(F.col("item_id").alias("i")).distinct(), "i", "left_semi").mapInArrow(_item_shingles, "item_id long, x long")
    spread = wanted.mapInArrow(_item_shingles, "item_id long, x long").groupBy("x").agg(F.count("*").alias("n"))
    weights = shingled.join(spread, "x").groupBy("item_id").agg(F.collect_list(F.struct("x", "n")).alias("spread"))
    texts = wanted.select(F.col("i").alias("item_id"), F.col("t").alias("passage"))
    found = places.join(rows, "doc").join(texts, "item_id").join(weights, "item_id", "left")
    return found.select("doc", "item_id", "text", "passage", "spread", "places").mapInArrow(_verified, SCHEMA)


def leaked(docs: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str) -> DataFrame:
    """(doc, item_id, run_letters, share, similarity): documents with an item, the run's letters and their share of the item."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")
    wanted = items.select(F.col(item_key).cast("bigint").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").distinct()
    few = wanted.orderBy("i", "t").limit(ITEMS_PER_PASS + 1).collect()
    if len(few) <= ITEMS_PER_PASS:
        out = rows.mapInArrow(_search(spark.sparkContext.broadcast(tuple((r.i, r.t) for r in few))), SCHEMA)
    else:
        out = leaked_by_blocks(rows, cut(wanted))
    return out.groupBy("doc", "item_id").agg(*[F.max(c).alias(c) for c in ("run_letters", "share", "similarity")])
