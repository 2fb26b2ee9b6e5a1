"""Near-duplicate groups by PartEnum signatures.

The features of a text are the distinct five-character runs of its folded form (consistent form, case
ignored, letters and digits only). Sizes fall into bands of ratio two. A set is enumerated for its own band,
and for the next one too if a similar larger set may lie there, so that two sets that are similar enough are
always enumerated for the larger one's band. Within a band the feature domain is cut by hash into GROUPS
first-level partitions of SECOND second-level partitions each, the latter with about PER_PART features of the
largest sets. In each first-level partition every subset of its second-level partitions is enumerated whose
features in the set number LEAST to MOST; the signature is (band, first-level partition, subset, exact content
of the subset). Sets that agree on such a subset share the signature, whatever else differs. In bands of large
sets the domain is first thinned by hash, since a part of it tells enough; bands of small sets are cut in
several independent ways instead, and sets of a few features are their own signatures, feature by feature.

Guaranteed cover (more first-level partitions than differing features) would need partitions of one or two
features at similarity 0.7, which all texts share. Here a pair of similarity 0.7 has ten or more common
signatures in the mean; the README gives the measured misses for all sizes. Candidates whose sketches disagree
more than a similar pair's would by SLACK standard deviations are dropped, the others verified exactly,
and groups are the connected components of the verified links.

Signatures are moved in packed blocks, one per batch and bucket of the signature space, and looked through a
bucket at a time; only documents that share one go on.

Texts without letters or digits have no features: those of one consistent form are one group. Texts
of fewer than five letters have one feature, the whole of it. Null texts belong to no group.
Repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import cut, drop_stored, stored
from .textform import canonical, fold_codes

WIDTH = 5
THRESHOLD = 0.7
#: First-level partitions of a band, second-level partitions of each, and features of the largest sets in one of these.
GROUPS = 112
SECOND = 2
PER_PART = 5.0
#: Features of an enumerated subset, one less at least in the smallest band. Chance agreement of unrelated texts falls about fivefold with each feature more.
LEAST, MOST = 5, 9
#: Independent cuts of a small band, at most.
TURNS = 24
#: Largest size of the bands whose features are signatures themselves.
TINY = 16
#: Signatures that one bucket is meant to hold.
PER_BUCKET = 250_000
#: Bytes of a signature within its bucket, where two different ones of a full bucket agree by chance.
SIG_BYTES = 5

#: Bits of a sketch, and how far below the expected agreement (in standard deviations) a pair is left out unverified.
SKETCH = 256
SLACK = 7.0
_EDGES = (np.arange(SKETCH, dtype=np.float64) * (2.0**64 / SKETCH)).astype(np.uint64)
#: Buckets up to this many members are compared pairwise; larger ones through a hub first.
BUCKET = 64
#: Members of large buckets are counted against each other in blocks of about so many.
BLOCK = 256
#: Features whose columns of a block are multiplied at once.
CHUNK = 8192

_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * _K2
    x = x ^ (x >> np.uint64(27))
    x = x * _K3
    return x ^ (x >> np.uint64(31))


def runs(codes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the runs of the given width."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.uint64)
    if n < width:
        return np.array([xxhash.xxh3_64_intdigest(codes.tobytes())], np.uint64)
    c = codes.astype(np.uint64)
    h = c[: n - width + 1].copy()
    for i in range(1, width):
        h = h * _K1 + c[i : n - width + 1 + i]
    h = np.sort(mix(h))
    return h[np.r_[True, h[1:] != h[:-1]]]


_SUBSETS = np.array([[m >> i & 1 for m in range(1, 1 << SECOND)] for i in range(SECOND)], np.int64)  # one column per subset


def signatures(features: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """The PartEnum signatures of a set for its band, and the next if a similar set may lie there."""
    n = len(features)
    if not n:
        return np.zeros(0, np.uint64)
    whole = GROUPS * SECOND * PER_PART
    own = mix(features ^ _K1)  # contents are sums of these, in halves that stay exact as floats
    low, high = (own & np.uint64(0xFFFFFFFF)).astype(np.float64), (own >> np.uint64(32)).astype(np.float64)
    out = []
    for band in range(n.bit_length() - 1, int(n / threshold + 1e-9).bit_length()):
        top = 2 << band
        if top <= TINY:
            out.append(mix(features + np.uint64(band * 1_000_003 + 17)))
            continue
        keep = min(1.0, whole / top)
        groups = GROUPS if keep < 1 else max(1, round(top / (SECOND * PER_PART)))
        cells = groups * SECOND
        for turn in range(1 if keep < 1 else min(TURNS, round(whole / top))):
            # partitions are equal slices of a hash
            cell = (mix(features + np.uint64(int(_K3) * (1 + band % 2 + 2 * turn) % 2**64)) * (cells / keep / 2.0**64)).astype(np.int64)
            lo, hi = low, high
            if keep < 1:
                use = np.flatnonzero(cell < cells)
                cell, lo, hi = cell[use], low[use], high[use]
            held = np.bincount(cell, minlength=cells)[:cells].reshape(groups, SECOND) @ _SUBSETS
            group, subset = np.nonzero((held >= min(LEAST, top // 8)) & (held <= MOST))
            lo, hi = (np.bincount(cell, x, cells)[:cells].astype(np.uint64).reshape(groups, SECOND) @ _SUBSETS.astype(np.uint64) for x in (lo, hi))
            content = lo[group, subset] + (hi[group, subset] << np.uint64(32))
            place = (group * _SUBSETS.shape[1] + subset + 1).astype(np.uint64)
            out.append(mix(content + np.uint64(band * 1_000_003 + turn * 7919) + place * _K2))
    return np.concatenate(out)


def sketch(features: np.ndarray) -> bytes:
    """SKETCH bits: of each of as many slices of the hash domain, one bit of its smallest feature.

    Sets of similarity s agree in about (1 + s) / 2 of the bits, unrelated ones in half.
    """
    edges = np.searchsorted(features, _EDGES)
    first = features[np.minimum(edges, max(len(features) - 1, 0))] if len(features) else np.zeros(SKETCH, np.uint64)
    empty = edges == np.r_[edges[1:], len(features)]
    bits = ((mix(first ^ _K3) & np.uint64(1)) == 1) & ~empty
    return np.packbits(bits).tobytes()


def _texts(batch: pa.RecordBatch, i: int) -> list:
    return batch.column(i).to_pylist()


def content_key(text: str, codes: np.ndarray) -> int:
    """Equal for texts of one folded form; of texts without letters or digits, for those of one consistent form."""
    return xxhash.xxh3_64_intdigest(codes.tobytes() if len(codes) else b"\0" + canonical(text).encode())


def _sign(buckets: int):
    """Per batch and bucket one block: signatures in order, and the document of each as its distance from the batch's first."""
    names = ["bucket", "first", "n", "sig", "doc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, doc, seen = [], [], set()
            for d, text in zip(_texts(batch, 0), _texts(batch, 1)):
                codes = fold_codes(text)
                if len(codes) and (h := content_key(text, codes)) not in seen:
                    seen.add(h)
                    s = signatures(runs(codes))
                    sig.append(s)
                    doc.append(np.full(len(s), d, np.int64))
            if not sig:
                continue
            sig, doc = np.concatenate(sig), np.concatenate(doc)
            order = np.argsort(sig)
            sig, doc = sig[order], doc[order]
            first = int(doc.min())
            width = max(1, -(-(int(doc.max()) - first).bit_length() // 8))
            far = (doc - first).view(np.uint8).reshape(-1, 8)[:, :width]
            share = np.uint64((1 << 64) // buckets + 1)
            own = (sig // share).astype(np.int64)
            rest = mix(sig).view(np.uint8).reshape(-1, 8)[:, :SIG_BYTES]
            starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            ends = np.append(starts[1:], len(sig))
            cols = [
                pa.array(own[starts], pa.int64()), pa.array(np.full(len(starts), first), pa.int64()), pa.array(ends - starts, pa.int64()),
                pa.array([rest[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()), pa.array([far[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _wide(packed: bytes, n: int) -> np.ndarray:
    """n numbers of equal width, packed low byte first, as 64-bit integers."""
    out = np.zeros((n, 8), np.uint8)
    own = np.frombuffer(packed, np.uint8).reshape(n, -1)
    out[:, : own.shape[1]] = own
    return out.view(np.int64).ravel()


def _collide(block: pa.Table) -> pa.Table:
    """(a, b, sig): pairs of documents that share a signature, each once, with a null sig; of signatures with more than BUCKET documents, the documents."""
    sig, doc = [], []
    for first, n, s, d in zip(*(block.column(c).to_pylist() for c in ("first", "n", "sig", "doc"))):
        sig.append(_wide(s, n).view(np.uint64))
        doc.append(_wide(d, n) + first)
    sig, doc = np.concatenate(sig), np.concatenate(doc)
    order = np.argsort(sig, kind="stable")
    sig, doc = sig[order], doc[order]
    starts = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
    size = np.diff(np.append(starts, len(sig)))
    left, right, large = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    for k in np.unique(size[(size > 1) & (size <= BUCKET)]):
        rows = doc[starts[size == k][:, None] + np.arange(k)]
        i, j = np.triu_indices(k, 1)
        left.append(rows[:, i].ravel())
        right.append(rows[:, j].ravel())
    for a, n in zip(starts[size > BUCKET], size[size > BUCKET]):
        large.append(np.arange(a, a + n))
    left, right = np.concatenate(left), np.concatenate(right)
    pair = np.unique(np.stack([np.minimum(left, right), np.maximum(left, right)]), axis=1)
    pair = pair[:, pair[0] != pair[1]]
    at = np.concatenate([np.zeros(0, np.int64), *large])
    n, m = pair.shape[1], len(at)
    return pa.table({
        "bucket": pa.array(np.full(n + m, block.column("bucket")[0].as_py()), pa.int64()),
        "a": pa.array(np.concatenate([pair[0], doc[at]]), pa.int64()),
        "b": pa.array(np.concatenate([pair[1], np.zeros(m, np.int64)]), pa.int64(), mask=np.arange(n + m) >= n),
        "sig": pa.array(np.concatenate([np.zeros(n, np.int64), sig[at].view(np.int64)]), pa.int64(), mask=np.arange(n + m) < n),
    })


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = _texts(batch, 1)
        codes = [fold_codes(t) for t in texts]
        h = np.array([content_key(t, c) for t, c in zip(texts, codes)], np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([c.tobytes().decode("utf-32-le") for c in codes], pa.string())], ["h", "folded"])


def _promising(threshold: float):
    least = SKETCH * (1 + threshold) / 2 - SLACK * np.sqrt(SKETCH * (1 - threshold**2) / 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(_texts(batch, i)), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
                same = SKETCH - np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
                keep = pa.array(same >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return run


def _similar(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _texts(batch, 0), _texts(batch, 1)
            ok, last, left = [], None, None
            for (x, y), s, t in zip(zip(a, b), _texts(batch, 2), _texts(batch, 3)):
                if x != last:
                    last, left = x, runs(np.frombuffer(s.encode("utf-32-le"), np.int32))
                right = runs(np.frombuffer(t.encode("utf-32-le"), np.int32))
                both = len(np.intersect1d(left, right, assume_unique=True))
                ok.append(both >= threshold * (len(left) + len(right) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["a", "b", "near"])

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = _texts(batch, 1)
        codes = [fold_codes(t) for t in texts]
        h = np.array([content_key(t, c) for t, c in zip(texts, codes)], np.uint64)
        size = [max(0, len(c) - WIDTH + 1) or int(len(c) > 0) for c in codes]  # runs, repeated ones too: no set is larger
        sketches = pa.array([sketch(runs(c)) for c in codes], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h.view(np.int64)), pa.array(size, pa.int64()), sketches], ["doc", "h", "runs", "sketch"])


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of those pairs whose exact similarity reaches the threshold; a document that stands there twice has its text twice."""
    left = texts.select(F.col("h").alias("a"), F.col("folded").alias("s"))
    right = texts.select(F.col("h").alias("b"), F.col("folded").alias("t"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "s", "t")
    return rows.mapInArrow(_similar(threshold), "a long, b long, near boolean").where("near").select("a", "b").distinct()


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Common features of each set of the left with each of the right, as a matrix."""
    flat = [np.concatenate([*x, np.zeros(0, np.uint64)]) for x in (left, right)]
    row = [np.repeat(np.arange(len(x)), [len(f) for f in x]) for x in (left, right)]
    both = np.intersect1d(*flat)
    at = [np.searchsorted(both, f) for f in flat]
    out = np.zeros((len(left), len(right)))
    for begin in range(0, len(both), CHUNK):
        cells = []
        for x, f, r, i in zip((left, right), flat, row, at):
            use = np.flatnonzero((i >= begin) & (i < min(begin + CHUNK, len(both))))
            use = use[both[i[use]] == f[use]]
            m = np.zeros((len(x), CHUNK), np.float32)
            m[r[use], i[use] - begin] = 1
            cells.append(m)
        out += cells[0] @ cells[1].T
    return out


def _block_degrees(threshold: float):
    def run(block: pa.Table) -> pa.Table:
        h, own, x, y = (np.array(block.column(c).to_pylist()) for c in ("h", "own", "x", "y"))
        features = [runs(np.frombuffer(t.encode("utf-32-le"), np.int32)) for t in block.column("folded").to_pylist()]
        size = np.array([len(f) for f in features], np.float64)
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        both = overlaps([features[i] for i in left], [features[i] for i in right])
        near = both >= threshold * (size[left][:, None] + size[right][None] - both) - 1e-9
        near &= h[left][:, None] != h[right][None]
        # a block met with itself has every link in its row and in its column
        ends = [(left, near.sum(1))] + ([(right, near.sum(0))] if x[0] != y[0] else [])
        return pa.table({"h": pa.array(np.concatenate([h[i] for i, _ in ends]), pa.int64()), "n": pa.array(np.concatenate([n for _, n in ends]), pa.int64())})

    return run


def inner_degrees(inner: DataFrame, folded: DataFrame, threshold: float) -> DataFrame:
    """(h, n): to how many others of its component each content is linked, all of them compared.

    inner: (h, component); folded: (h, folded). Contents go to blocks by hash and every two blocks of a component meet
    in one group, so no task holds a whole component, and what is shuffled grows with the blocks, not the pairs.
    """
    blocks = inner.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k"))
    rows = inner.join(blocks, "component").withColumn("own", F.pmod(F.xxhash64("h"), F.col("k")).cast("int")).join(folded, "h")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    rows = rows.select("component", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "h", "folded")
    return rows.groupBy("component", "x", "y").applyInArrow(_block_degrees(threshold), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def links(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(doc, h) membership of content classes, (a, b) verified links between different contents, and h near a hub.

    The links join all similar contents, but two contents that are both near the hub of a large bucket may not be
    linked directly; without large buckets the third is None. docs: (doc, text) without null texts.
    """
    members = cut(docs.mapInArrow(_keyed, "doc long, h long, runs long, sketch binary"))
    # at most two bands of so many signatures for each run of a text, and no more than the partitions give
    most = 2 * GROUPS * _SUBSETS.shape[1]
    total = members.agg(F.sum(F.least(F.col("runs") * TURNS, F.lit(most)))).first()[0] or 0
    buckets = max(24, -(-int(total) // PER_BUCKET))
    blocks = docs.mapInArrow(_sign(buckets), "bucket long, first long, n long, sig binary, doc binary")
    met = cut(blocks.groupBy("bucket").applyInArrow(_collide, "bucket long, a long, b long, sig long"))
    keys = members.select("doc", "h").distinct()
    ends = [keys.select(F.col("doc").alias(d), F.col("h").alias(h)) for d, h in (("a", "x"), ("b", "y"))]
    small = met.where("sig is null").select("a", "b").distinct().join(ends[0], "a").join(ends[1], "b").select("x", "y")
    large = met.where("sig is not null").select("bucket", "sig", "a").join(ends[0], "a").select(F.xxhash64("bucket", "sig").alias("sig"), F.col("x").alias("h")).distinct()
    hot = bool(large.take(1))
    if hot:
        large = cut(large.join(large.groupBy("sig").agg(F.min("h").alias("hub"), F.count("*").alias("n")).where("n > 1"), "sig"))
        few = large.where(F.col("n") <= BUCKET)
        small = small.union(few.select("sig", F.col("h").alias("x")).join(few.select("sig", F.col("h").alias("y")), "sig").select("x", "y"))
        large = large.where(F.col("n") > BUCKET)
        small = small.union(large.select(F.col("hub").alias("x"), F.col("h").alias("y")))
    pairs = small.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    # written tables have a known size, by which Spark decides whether to broadcast them
    reps = stored(members.groupBy("h").agg(F.min(F.struct("doc", "sketch")).alias("r")).select("h", "r.doc", "r.sketch"))

    def promising(p: DataFrame) -> DataFrame:
        x, y = (reps.select(F.col("h").alias(e), F.col("sketch").alias("s" + e)) for e in ("a", "b"))
        return cut(p.join(x, "a").join(y, "b").select("a", "b", "sa", "sb").mapInArrow(_promising(threshold), "a long, b long"))

    def texts_of(p: DataFrame) -> DataFrame:
        need = stored(p.select(F.col("a").alias("h")).union(p.select("b")).distinct().join(reps, "h").select("doc"))
        out = cut(docs.join(need, "doc", "left_semi").mapInArrow(_folded, "h long, folded string"))
        drop_stored(need)
        return out

    pairs = promising(pairs)
    found = cut(_verified(pairs, texts_of(pairs), threshold))
    inner = None
    if hot:  # members of a large bucket that are not near its hub are compared with all its members
        both = found.union(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.select(F.col("a").alias("hub"), F.col("b").alias("h"))
        far = large.where("h <> hub").join(near, ["hub", "h"], "left_anti")
        inner = cut(large.where("h <> hub").join(near, ["hub", "h"], "left_semi").select("h").distinct())
        rest = far.select("sig", F.col("h").alias("x")).join(large.select("sig", F.col("h").alias("y")), "sig").where("x <> y")
        rest = promising(rest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti"))
        found = cut(found.union(_verified(rest, texts_of(rest), threshold)))
    return members.select("doc", "h"), found, inner


def degrees(docs: DataFrame, members: DataFrame, found: DataFrame, inner: DataFrame | None, comp: DataFrame, threshold: float) -> DataFrame:
    """(h, n_links) of the contents that have links."""
    both = found.union(found.select("b", "a"))
    if inner is None:
        return both.groupBy(F.col("a").alias("h")).agg(F.count("*").alias("n_links"))
    # links between two contents near a hub are counted among all such contents of the component, the others are all found
    flag = [inner.select(F.col("h").alias(e), F.lit(1).alias("i" + e)) for e in ("a", "b")]
    outer = both.join(flag[0], "a", "left").join(flag[1], "b", "left").where("ia is null or ib is null")
    first = members.join(inner, "h", "left_semi").groupBy("h").agg(F.min("doc").alias("doc"))
    folded = docs.join(first.select("doc"), "doc", "left_semi").mapInArrow(_folded, "h long, folded string").dropDuplicates(["h"])
    within = inner_degrees(inner.join(comp, "h"), folded, threshold)
    return outer.groupBy(F.col("a").alias("h")).agg(F.count("*").alias("n")).union(within).groupBy("h").agg(F.sum("n").alias("n_links"))


def near_duplicates(df: DataFrame, key: str, text: str, threshold: float = THRESHOLD, counted: bool = True) -> DataFrame:
    """(doc, group_id, n_links): one row per document; group_id is the smallest document of its group.

    n_links counts the different contents its own content is linked to; exact copies are no links. Unless counted, it is left out.
    """
    docs = df.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")
    members, found, inner = links(docs, threshold)
    comp = connected_components(found, "a", "b").select(F.col("node").alias("h"), "component")
    first = members.groupBy("h").agg(F.min("doc").alias("first"))
    linked = comp.join(first, "h")
    linked = linked.join(linked.groupBy("component").agg(F.min("first").alias("group_id")), "component").select("h", "group_id")
    if counted:
        linked = linked.join(degrees(docs, members, found, inner, comp, threshold), "h", "left")
    rows = members.distinct().join(first, "h").join(linked, "h", "left")
    out = rows.select("doc", F.coalesce("group_id", "first").alias("group_id"), *([F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links")] if counted else []))
    return out


def grouped_pairs(groups: DataFrame) -> DataFrame:
    """(doc_a, doc_b): pairs of documents of one group."""
    b = groups.select("group_id", F.col("doc").alias("doc_b"))
    return groups.select("group_id", F.col("doc").alias("doc_a")).join(b, "group_id").where("doc_a < doc_b").select("doc_a", "doc_b")
