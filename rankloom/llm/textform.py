"""One consistent form for texts that look alike, as array operations over code points.

Fixed values: the look-alike letters below map a letter of another script to the Latin letter
drawn with the same shape, as in the published confusables data; letters that only resemble a Latin one
(small Greek alpha, say) are left alone. Invisible characters are, by rule, all default-ignorable ones.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np
import regex

# Cyrillic, Greek, Armenian and Cherokee letters drawn like Latin ones.
LOOKALIKE_FROM = "АВЕЅІЈКМНОРСТУХаеѕіјорсухԁԛԝһӀΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳՍՏՕհոսօᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏙᏚᏞᏟᏢᏦᏴ"
LOOKALIKE_TO = "ABESIJKMHOPCTYXaesijopcyxdqwhIABEZHIKMNOPTYXovcjUSOhnuoDRTAJEWMHGZVSLCPKB"
# Hyphens drawn alike, blanks other than line ends.
HYPHENS = "\u2010\u2011"
BLANKS = "\t\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


@functools.cache
def invisible() -> str:
    """All default-ignorable characters: zero-width ones, soft hyphens, direction marks, fillers, variation selectors, tags."""
    return "".join(regex.findall(r"\p{Default_Ignorable_Code_Point}", "".join(map(chr, [*range(0xD800), *range(0xF900, 0x110000)]))))


def compatibility_pairs() -> dict[str, str]:
    """Width forms, ligatures, Roman numerals and radicals with the ordinary characters they stand for, by rule.

    The rule: every character of these blocks whose compatibility decomposition differs.
    """
    out = {}
    for lo, hi in ((0x2160, 0x217F), (0x2F00, 0x2FD5), (0xFB00, 0xFB06), (0xFF01, 0xFFEE), (0x2E80, 0x2EF3)):
        for cp in range(lo, hi + 1):
            to = unicodedata.normalize("NFKC", chr(cp))
            if to != chr(cp):
                out[chr(cp)] = to
    return out


@functools.cache
def single_map() -> dict[str, str]:
    """Characters replaced by exactly one character or by nothing."""
    out = {a: b for a, b in zip(LOOKALIKE_FROM, LOOKALIKE_TO)}
    out |= {a: b for a, b in compatibility_pairs().items() if len(b) == 1}
    return out | {c: "-" for c in HYPHENS} | {c: " " for c in BLANKS} | {c: "" for c in invisible()}


def multi_map() -> dict[str, str]:
    """Characters replaced by several (ligatures)."""
    return {a: b for a, b in compatibility_pairs().items() if len(b) > 1}


@functools.cache
def skeleton_map() -> dict[str, str]:
    """single_map() with accents dropped: by rule, a character with a canonical decomposition becomes its
    base letter, combining marks and Hangul (whose syllables decompose into several letters) vanish."""
    out = {}
    for cp in [*range(0xA0, 0xD800), *range(0xF900, 0xFB00)]:
        ch = chr(cp)
        base = unicodedata.normalize("NFD", ch)
        if unicodedata.combining(ch) or 0x1100 <= cp <= 0x11FF or 0xAC00 <= cp <= 0xD7A3:
            out[ch] = ""
        elif base[0] != ch:
            out[ch] = base[0]
    single = single_map()
    for a, b in single.items():
        out[a] = out.get(b, b) if b else ""
    return {a: single.get(b, b) for a, b in out.items()}


@functools.cache
def _canonical_table() -> dict[int, str]:
    return {ord(a): b for a, b in (single_map() | multi_map()).items()}


def canonical(text: str | None) -> str | None:
    """The consistent form of one text: composed accents, ordinary width, blanks, letters; case is kept."""
    if text is None:
        return None
    return unicodedata.normalize("NFC", text.translate(_canonical_table()))


@functools.cache
def _fold_table() -> np.ndarray:
    """Code point -> folded letter or digit; 0 drops it; -1 needs the slow path (it maps to several)."""
    lut = np.zeros(sys.maxunicode + 1, np.int32)
    table = _canonical_table()
    # ideographs and Hangul syllables fold to themselves; planes 4 and up hold no letters
    for lo, hi in ((0x3400, 0xA000), (0xAC00, 0xD7A4), (0x20000, 0x2F800), (0x30000, 0x40000)):
        known = np.fromiter(map(str.isalnum, map(chr, range(lo, hi))), bool, hi - lo)
        lut[lo:hi] = np.where(known, np.arange(lo, hi), 0)
    rest = [*range(0x3400), *range(0xA000, 0xAC00), *range(0xD7A4, 0xD800), *range(0xF900, 0x20000), *range(0x2F800, 0x30000)]
    # what composes with a letter before it needs the slow path: vowel signs and jamo, besides combining marks
    joins = {p[-1] for cp in rest if len(p := unicodedata.decomposition(chr(cp)).split()) == 2 and p[0][0] != "<"}
    second = {int(x, 16) for x in joins} | set(range(0x1160, 0x1200))
    for cp in rest:
        ch = chr(cp)
        if cp in second or unicodedata.combining(ch):
            lut[cp] = -1
            continue
        to = "".join(c for c in unicodedata.normalize("NFC", table.get(cp, ch)).casefold() if c.isalnum())
        lut[cp] = ord(to) if len(to) == 1 else 0 if not to else -1
    return lut


def fold_slow(text: str) -> str:
    """Consistent form, case ignored, only letters and digits."""
    return "".join(c for c in canonical(text).casefold() if c.isalnum())


def fold_codes(text: str | None) -> np.ndarray:
    """The letters and digits of the consistent form, case ignored, as code points.

    Null gives an empty array, and so does a text without letters or digits.
    """
    if not text:
        return np.zeros(0, np.int32)
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), np.int32)
    got = _fold_table()[raw]
    if (got < 0).any():
        slow = fold_slow(text)
        return np.frombuffer(slow.encode("utf-32-le", "replace"), np.int32)
    return got[got > 0]
