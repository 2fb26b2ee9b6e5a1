"""Oversized texts cut into pieces at natural boundaries, by dynamic programming.

Sizes are tokens of a public tokenizer. Every token offset that falls between two characters may be a cut;
its penalty is that of the best boundary it lies on: paragraph, sentence, clause, word, none. Each piece after
the first starts overlap_tokens before the cut (a token more where that offset lies inside a character). The
cuts minimise, over all such offsets, the sum of the penalties and of the squared deviations of the pieces
from the mean size, subject to the limit. A piece is counted again on its own; if a token at its start splits
differently and the piece exceeds the limit, the text is cut again under a smaller one. If no smaller limit
works, ValueError is raised; no piece is ever larger than the limit.

A text within the limit is one piece; null and empty texts give no piece. Repeated rows give their
pieces once per row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

PARAGRAPH, SENTENCE, CLAUSE, WORD, NONE = 0.0, 0.15, 0.6, 1.5, 6.0
IMBALANCE = 4.0
_ENDS = (
    (WORD, regex.compile(r"\s+|(?<=\p{Han}|\p{Hiragana}|\p{Katakana})")),
    (CLAUSE, regex.compile(r"[,;:、，；：]+[»”’\"'」』）)]*\s*(?!\d)")),
    (SENTENCE, regex.compile(r"(?:[!?。！？…]|\.(?!\d))+[»”’\"'」』）)]*\s*")),
    (PARAGRAPH, regex.compile(r"\s*\n\s*")),
)


def penalties(text: str) -> np.ndarray:
    """The penalty of a cut before each character, and after the last."""
    out = np.full(len(text) + 1, NONE)
    for cost, pattern in _ENDS:
        for m in pattern.finditer(text):
            out[m.end()] = min(out[m.end()], cost)
    return out


def _program(at: np.ndarray, start: np.ndarray, price: np.ndarray, mean: float, limit: int) -> tuple[float, list[int]]:
    """The least total over cuts at the offsets at, and the indexes of these cuts; infinite if no cuts keep the limit."""
    size = (start + mean) / mean
    best = np.full(len(at), np.inf)
    best[0] = 0
    prev = np.full(len(at), -1)
    firsts = np.searchsorted(start, at - limit)  # the first cut whose piece up to here keeps the limit
    for k in range(1, len(at)):
        first = firsts[k]
        if first >= k:
            continue
        off = at[k] / mean - size[first:k]
        total = best[first:k] + IMBALANCE * off * off
        j = int(np.argmin(total))
        best[k] = total[j] + price[k]
        prev[k] = first + j
    path, k = [], len(at) - 1
    while k > 0 and np.isfinite(best[-1]):
        path.append(k)
        k = int(prev[k])
    return float(best[-1]), path[::-1]


def cuts(cost: np.ndarray, ends: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Token spans (start, end) of the pieces; ends[t] is the character offset of token offset t or -1.

    Boundaries are admitted kind by kind. A total that is no larger than the penalty of the next kind
    can't be bettered by any cut of that kind or a worse one, so the rest needn't be looked at.
    """
    n = len(ends) - 1
    if n <= limit:
        return [(0, n)]
    price = np.where(ends >= 0, cost[np.maximum(ends, 0)], np.inf)
    price[0] = price[n] = 0
    whole = np.flatnonzero(ends >= 0)
    pieces = int(np.ceil((n - overlap) / (limit - overlap)))
    mean = (n + (pieces - 1) * overlap) / pieces
    for kind, worse in ((SENTENCE, CLAUSE), (CLAUSE, WORD), (WORD, NONE), (NONE, np.inf)):
        at = np.flatnonzero(price <= kind)
        # where the piece after a cut starts: overlap tokens before it, or the nearest character start below
        start = whole[np.searchsorted(whole, np.maximum(at - overlap, 0), "right") - 1]
        total, path = _program(at, start, price[at], mean, limit)
        if np.isfinite(total) and total <= worse:
            return [(int(start[j]), int(at[k])) for j, k in zip([0, *path], path)]
    raise ValueError("the limit is smaller than one character and the overlap")


def split(text: str, limit: int, overlap: int, ranks: str = tokens.RANKS) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of the pieces in characters; none for an empty text."""
    if not text:
        return []
    if limit <= overlap or limit < 4:
        raise ValueError("the limit must exceed the overlap")
    ends = tokens.char_ends(text, ranks)
    if len(ends) - 1 <= limit:
        return [(0, len(text), len(ends) - 1)]
    cost = penalties(text)
    most = limit
    while most > overlap:
        spans = [(int(ends[a]), int(ends[b])) for a, b in cuts(cost, ends, most, overlap)]
        sizes = [tokens.count(text[a:b], ranks) for a, b in spans]
        if max(sizes) <= limit:
            return [(a, b, n) for (a, b), n in zip(spans, sizes)]
        most -= max(sizes) - limit
    raise ValueError("no cuts keep all pieces within the limit")


def _split(limit: int, overlap: int, ranks: str, held: Broadcast):
    schema = ["doc", "piece_no", "start_pos", "end_pos", "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.install(ranks, held.value)
        for batch in batches:
            rows = [
                (doc, no, *piece)
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for pieces in (split(text, limit, overlap, ranks),)
                if len(pieces) > 1
                for no, piece in enumerate(pieces)
            ]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema)

    return run


def limit_of(limits: DataFrame, name: str) -> tuple[int, int]:
    """(capacity, overlap) of the named limit; the table is a handful of settings."""
    row = limits.where(F.col("limit_name") == name).select("capacity_tokens", "overlap_tokens").orderBy("capacity_tokens").first()
    if row is None or row[0] is None:
        raise ValueError(f"no limit named {name}")
    return int(row[0]), int(row[1] or 0)


def split_oversized(df: DataFrame, key: str, text: str, limit: int, overlap: int, ranks: str = tokens.RANKS) -> DataFrame:
    """(doc, piece_no, start_pos, end_pos, n_tokens) of the texts larger than the limit.

    A byte-level tokenizer makes no more tokens than bytes, so texts of fewer bytes aren't tokenized.
    """
    rows = df.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("t")).where((F.octet_length("t") > limit) & F.col("doc").isNotNull())
    return rows.mapInArrow(_split(limit, overlap, ranks, tokens.held(df.sparkSession, ranks)), "doc long, piece_no long, start_pos long, end_pos long, n_tokens long")
