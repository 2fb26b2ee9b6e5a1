"""Token counts and token boundaries by a public byte-level tokenizer; its files stay outside the repository."""

from __future__ import annotations

import base64
import functools
import os

import numpy as np
import tiktoken
from pyspark import Broadcast
from pyspark.sql import SparkSession

#: A rank file whose path is a parameter of every operator that measures tokens. The driver reads it; executors get its
#: contents, a megabyte or two, by broadcast.
RANKS = os.environ.get("RANKLOOM_RANKS", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: the published pre-tokenizer pattern that goes with the rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


MAX_BYTES = 64 << 20
_installed: dict[str, bytes] = {}


def held(spark: SparkSession, ranks: str) -> Broadcast:
    """The contents of the rank file, to be passed to the executors; they install() it."""
    if os.path.getsize(ranks) > MAX_BYTES:
        raise ValueError("this is no rank file")
    with open(ranks, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def install(ranks: str, contents: bytes) -> None:
    _installed.setdefault(ranks, contents)


def _contents(ranks: str) -> bytes:
    if ranks in _installed:
        return _installed[ranks]
    with open(ranks, "rb") as f:
        return f.read()


@functools.lru_cache(maxsize=2)
def encoding(ranks: str = RANKS) -> tiktoken.Encoding:
    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, _contents(ranks).splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


def count(text: str | None, ranks: str = RANKS) -> int:
    return len(encoding(ranks).encode_ordinary(text)) if text else 0


def char_ends(text: str, ranks: str = RANKS) -> np.ndarray:
    """For token offsets 0..n the number of whole characters before them, or -1 inside a character."""
    enc = encoding(ranks)
    pieces = enc.decode_tokens_bytes(enc.encode_ordinary(text))
    ends = np.r_[0, np.cumsum([len(p) for p in pieces], dtype=np.int64)]
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    starts = (raw & 0xC0) != 0x80
    before = np.r_[0, np.cumsum(starts)]
    at = before[ends]
    inside = np.r_[~starts, False][ends]
    return np.where(inside, -1, at)
