"""Items packed into containers of fixed capacity by conflict-constrained best fit.

Sizes are tokens of a public tokenizer. A text larger than the capacity is first split at natural
boundaries without overlap; no other text is split. Items go to shards by a hash, about SHARD_ITEMS in
each however the keys are distributed, and each shard is packed on its own, largest items first. Bins
are kept in order of their residual space and carry bitmaps of the sources and duplicate clusters of
their items. The search starts at the smallest residual that holds the item and goes on to the next
until it finds a compatible bin, which is therefore the tightest; if there is none, a bin is opened.

Two items of one duplicate cluster never share a bin. Two items of one source don't either, as far as space
allows: a source that has more items in the shard than the least number of bins may put as many into a bin as
an even spread needs. If that leaves more than WASTE of the space unused, the shard is packed again with
twice, four times ... as many items a bin for the sources with more items than a fourth of those bins, until the
waste is within bounds or no bound on them is left; each item reports its source_mates.
Clusters are texts of one folded form, or those of a given table of groups (that of the near-duplicate
operator, say). Null texts and texts without tokens take no space and get no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import tokens
from .neardup import content_key
from .splitting import split
from .textform import fold_codes

SHARD_ITEMS = 8000
#: Unused share of the space above which sources are kept less strictly apart.
WASTE = 0.03


def pack(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """The bin number of each item; sources and clusters may be None for items without one."""
    least = max(1, -(-sum(sizes) // capacity))
    held = pd.Series(sources, dtype=object).value_counts()
    best, times = None, 1
    while True:
        room = {s: -(-int(c) // least) * (times if c > least / 4 else 1) for s, c in held.items()}
        bins = _pack(sizes, sources, clusters, capacity, room)
        used = max(bins, default=-1) + 1
        if best is None or used < best[0]:
            best = (used, bins)
        free = all(room[s] >= c for s, c in held.items() if c > least / 4)
        if used <= least / (1 - WASTE) + 1 or free:
            return best[1]
        times *= 2


def _pack(sizes: list[int], sources: list, clusters: list, capacity: int, room: dict) -> list[int]:
    """Best fit with at most room[s] items of source s in a bin."""
    n = len(sizes)
    bit = {s: 1 << k for k, s in enumerate(room)}
    copies = pd.Series(clusters, dtype=object).value_counts()
    twin = {c: 1 << k for k, c in enumerate(copies[copies > 1].index)}
    order = sorted(range(n), key=lambda i: (-sizes[i], i))
    at: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by residual
    some = 0  # bit r is set if there is a bin of residual r
    of_source: list[int] = []  # sources that a bin takes no more of
    of_cluster: list[int] = []
    taken: dict[tuple[int, int], int] = {}  # items of a source in a bin, where it takes several
    out = [0] * n
    for i in order:
        size, s, c = sizes[i], bit.get(sources[i], 0), twin.get(clusters[i], 0)
        rest, found = some >> size, -1
        r = size
        while rest:
            step = (rest & -rest).bit_length() - 1
            r += step
            for k, b in enumerate(at[r]):
                if not (of_cluster[b] & c or of_source[b] & s):
                    found = k
                    break
            if found >= 0:
                break
            rest >>= step + 1
            r += 1
        if found >= 0:
            b = at[r].pop(found)
            if not at[r]:
                some &= ~(1 << r)
            left = r - size
        else:
            b, left = len(of_source), capacity - size
            of_source.append(0)
            of_cluster.append(0)
        if s:
            most = room[sources[i]]
            if most > 1:
                taken[b, s] = taken.get((b, s), 0) + 1
            if most == 1 or taken[b, s] >= most:
                of_source[b] |= s
        of_cluster[b] |= c
        at[left].append(b)
        some |= 1 << left
        out[i] = b
    return out


def _items(capacity: int, ranks: str, held: Broadcast):
    names = ["doc", "piece_no", "start_pos", "end_pos", "n_tokens", "source", "cluster"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.install(ranks, held.value)
        for batch in batches:
            rows = []
            for doc, text, source in zip(*(batch.column(i).to_pylist() for i in range(3))):
                key = content_key(text, fold_codes(text)) - (1 << 63)
                n = tokens.count(text, ranks)
                pieces = [(0, len(text), n)] if n <= capacity else split(text, capacity, 0, ranks)
                rows += [(doc, no, a, b, size, source, (key + no) % (1 << 63)) for no, (a, b, size) in enumerate(pieces) if size]
            cols = list(zip(*rows)) or [()] * 7
            types = [pa.int64()] * 5 + [pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return run


def fill_containers(
    df: DataFrame, key: str, text: str, source: str, capacity: int, ranks: str = tokens.RANKS, shard_items: int = SHARD_ITEMS, groups: DataFrame | None = None
) -> DataFrame:
    """(doc, piece_no, start_pos, end_pos, n_tokens, source_mates, container_id) for every item.

    container_id is "<shard>-<bin>"; source_mates counts the other items of the container from the same source.
    Items are the same at every size; the number of shards follows the number of items. groups: (doc, group_id),
    one row per document, replaces the clusters of equal folded texts.
    """
    rows = df.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("t"), F.col(source).cast("string").alias("s"))
    rows = rows.where("doc is not null and t is not null and t <> ''")
    items = rows.mapInArrow(_items(capacity, ranks, tokens.held(df.sparkSession, ranks)), "doc long, piece_no long, start_pos long, end_pos long, n_tokens long, source string, cluster long")
    if groups is not None:
        items = items.join(groups.select("doc", "group_id"), "doc", "left")
        items = items.withColumn("cluster", F.when(F.col("group_id").isNotNull(), F.xxhash64("group_id", "piece_no")).otherwise(F.col("cluster"))).drop("group_id")
    items = cut(items)
    shards = max(1, -(-items.count() // shard_items))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc", "piece_no"], ignore_index=True)
        pdf["bin"] = pack(pdf.n_tokens.tolist(), pdf.source.tolist(), pdf.cluster.tolist(), capacity)
        pdf["source_mates"] = (pdf.groupby(["bin", "source"]).doc.transform("size") - 1).fillna(0).astype("int64")
        pdf["container_id"] = [f"{pdf.shard[0]}-{b}" for b in pdf.bin]
        return pdf[["doc", "piece_no", "start_pos", "end_pos", "n_tokens", "source_mates", "container_id"]]

    sharded = items.withColumn("shard", F.pmod(F.xxhash64("doc", "piece_no"), F.lit(shards)))
    return sharded.groupBy("shard").applyInPandas(place, "doc long, piece_no long, start_pos long, end_pos long, n_tokens long, source_mates long, container_id string")
