"""Sentence units in any script, with period statistics learned unsupervised per language.

Learning counts, per language, each word with and without a final period, what follows the period
(lower case, digit, a capitalised word that is also known in lower case, another capitalised word, the
end of a line) and which word follows. From the counts come, by log-likelihood ratios:
  * leads: words whose period is mostly followed by a number;
  * abbreviations: words bound to their period more than chance explains, weighed by shortness and by
    inner periods; an abbreviation whose next words are capitalised names only is a title;
  * collocations: a number or initial and the word after its period that belong together;
  * starters: words that stand after sure boundaries more often than elsewhere.
Every period is then classified by these statistics; other marks and quotations follow fixed rules:
line breaks end a unit; commas, semicolons and colons never do; a quotation is not cut inside, stays
with words that follow it if it opens the unit, and ends the unit with its own mark if words introduced
it and neither lower case nor hiragana follows. An ellipsis ends no unit except before a known starter.

Positions count code points of the original text. Look-alike and invisible characters are read in their
consistent form, so they don't hide a word. Null texts and units without a letter or digit give no row.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .textform import BLANKS, multi_map, single_map

LINE_ENDS = "\n\r\u2028\u2029\x85\v\f"
FULL_MARKS = "。！？｡‼⁇⁈⁉।॥؟۔።។"
MARKS = ".!?．" + FULL_MARKS
ELLIPSIS = "…⋯"
# Opening quotation marks and what closes them.
QUOTES = {"“": "”", "„": "“”", "«": "»", "»": "«", "「": "」", "『": "』", '"': '"', "〝": "〞", "＂": "＂"}
CLOSERS = "”“»«」』\"〞＂)）]】〉》’'"
OPENERS = "¿¡“„«「『\"(（[【〈《‘'"
ABBREVIATION = 0.3
COLLOCATION = 7.88
STARTER = 30.0
# Frequent words that tell the Latin-script languages apart.
STOPWORDS = {
    "en": "the of and to in for at by from said was with on",
    "fr": "le la les des du une est dans pour par au en sur",
    "de": "der die das und im den von für mit auf ein eine um",
    "es": "el los las del una en por para con su al que un",
}
_BY_WORD = {w: {k for k, v in STOPWORDS.items() if w in v.split()} for v in STOPWORDS.values() for w in v.split()}
_WORD = regex.compile(r"\d+(?:[.,]\d+)*|[\p{L}\p{M}--[\p{Han}\p{Hiragana}\p{Katakana}]]+(?:[.'’-][\p{L}\p{M}--[\p{Han}\p{Hiragana}\p{Katakana}]]+)*", regex.V1)
_LINE = regex.compile(f"[{LINE_ENDS}]")
_STOP = regex.compile(f"[{regex.escape(MARKS + ELLIPSIS + LINE_ENDS)}\"“„«»「『〝＂]")


@functools.cache
def _read_map() -> dict[str, str]:
    keep = {a: b for a, b in single_map().items() if b == "" or b.isalnum()}
    return keep | {a: b for a, b in multi_map().items() if b.isalpha()} | {c: " " for c in BLANKS}


def readable(text: str) -> tuple[str, list[int] | None]:
    """The text with look-alike letters replaced and invisible characters left out, and where each character came from."""
    table = _read_map()
    if text.isascii() and "\t" not in text or table.keys().isdisjoint(text):
        return text, None
    out, at = [], []
    for i, c in enumerate(text):
        to = table.get(c, c)
        out.append(to)
        at += [i] * len(to)
    return "".join(out), at


_SCRIPTS = {"hani": "\u4e00-\u9fff", "kana": "\u3040-\u30ff", "cyrl": "\u0400-\u052f", "latn": "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"}
_BY_SCRIPT = {k: regex.compile(f"[{v}]+") for k, v in _SCRIPTS.items()}
_OTHER = regex.compile(f"[\\p{{L}}--[{''.join(_SCRIPTS.values())}]]+", regex.V1)


def language(text: str) -> str:
    """A language or script tag: enough to keep statistics of different languages apart."""
    if text.isascii():
        seen = {"latn": sum(map(len, _BY_SCRIPT["latn"].findall(text)))}
    else:
        seen = {k: sum(map(len, p.findall(text))) for k, p in (*_BY_SCRIPT.items(), ("other", _OTHER))}
    if not any(seen.values()):
        return "none"
    if seen.get("kana", 0) > 0.05 * sum(seen.values()):
        return "ja"
    top = max(seen, key=seen.get)
    if top != "latn":
        return top
    found = Counter(w for w in text.lower().split() if w in _BY_WORD)
    votes: Counter = Counter()
    for w, n in found.items():
        for k in _BY_WORD[w]:
            votes[k] += n
    return min(votes, key=lambda k: (-votes[k], k)) if votes else "latn"


def caseless(text: str) -> bool:
    if text.isascii() and text.upper() != text and text.lower() != text and sum(map(str.islower, text[:40])) > 8:
        return False  # forty characters with so many small letters: only a long text could still be caseless
    upper = sum(map(str.isupper, text))
    return upper > 0 and upper > 4 * sum(map(str.islower, text))


class _Words:
    """The patterns of words, words before a period, and words after a sure boundary."""

    def __init__(self, module, word: str, letter: str, **flags):
        self.word = module.compile(word, **flags)
        self.dotted = module.compile(f"((?>{word}))\\.(?!\\.)", **flags)
        self.sure = module.compile(f"(?:^|[!?{LINE_ENDS}{FULL_MARKS}]){letter}*({word})", **flags)


# The letters of words, as code points that the quicker engine of the standard library can tell; texts with
# combining marks, which belong to their words, go through the other one.
_CJK = "\u2e80-\u2fdf\u3005-\u3007\u3021-\u3029\u3038-\u303b\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U000323af"
_PLAIN_LETTER = f"[^\\W\\d_{_CJK}]"
_MARK = regex.compile(r"\p{M}")
_PLAIN = _Words(re, f"\\d+(?:[.,]\\d+)*|{_PLAIN_LETTER}+(?:[.'’-]{_PLAIN_LETTER}+)*", "[\\W_]")
_MARKED = _Words(regex, _WORD.pattern, "[^\\p{L}\\d]", flags=regex.V1)


def observe(text: str, counts: Counter) -> None:
    """Adds (kind, word, what) counts: 'w' plain and 'l' lower-case uses, '.' followers of a period, 'p' pairs, 's' sure starts."""
    text, _ = readable(text)
    if caseless(text):
        return
    p = _MARKED if not text.isascii() and _MARK.search(text) else _PLAIN
    plain: Counter = Counter()
    for w, n in Counter(p.word.findall(text)).items():
        low = w.lower()
        if w[0].isdigit():
            plain["#" if len(w) <= 2 else "##"] += n  # "#": may be an ordinal
        else:
            plain[low] += n
            counts["l" if w[0].islower() else "u", low, ""] += n
    if not plain:
        return
    for w in p.sure.findall(text):
        if not w[0].isdigit():
            counts["s", w.lower(), ""] += 1
    for m in p.dotted.finditer(text) if "." in text else ():
        w = m[1].lower()
        kind = w if not w[0].isdigit() else "#" if len(w) <= 2 else "##"
        plain[kind] -= 1
        k = m.end()
        stripped = text[k : k + 39].lstrip(" \t")
        nxt = p.word.search(text, k, k + 5)
        nxt = p.word.match(text, nxt.start()) if nxt else None
        if not stripped or stripped[0] in LINE_ENDS:
            what = "end"
        elif stripped[0] in ",;:":
            what = "in"
        elif nxt is None or any(c in text[k : nxt.start()] for c in LINE_ENDS):
            what = "end"
        elif nxt[0][0].isdigit():
            what = "digit"
        elif nxt[0][0].islower():
            what = "lower"
        else:
            what = "upper"
        counts[".", kind, what] += 1
        if nxt is not None and what in ("lower", "upper"):
            counts["p" if what == "upper" else "q", kind, nxt[0].lower()] += 1
    for kind, n in plain.items():
        if n > 0:
            counts["w", kind, ""] += n


@dataclass
class Model:
    """What was learned of one language."""

    abbreviations: set = field(default_factory=set)
    titles: set = field(default_factory=set)
    leads: set = field(default_factory=set)  # words whose period is mostly followed by a number
    collocations: set = field(default_factory=set)
    inner: set = field(default_factory=set)  # (abbreviation, lower-case word seen after it)
    starters: set = field(default_factory=set)


EMPTY = Model()


def _ends_here(text: str, m: Model, dot: int, begin: int, flat: bool) -> bool:
    """Whether the single period at dot ends a unit; no closing mark or line end follows it directly."""
    n = len(text)
    prev = text[dot - 1] if dot > begin else " "
    k = dot + 1
    nxt = text[k] if k < n else " "
    blank = nxt.isspace()
    while k < n and (text[k].isspace() or text[k] in OPENERS):
        if text[k] in LINE_ENDS:
            return True
        k += 1
    if k >= n:
        return True
    c = text[k]
    if not blank and prev.isdigit() and nxt.isdigit():
        return False
    if c in ",;:、，；：" or c in CLOSERS and not c in QUOTES:
        return False
    if "⺀" <= prev <= "鿿" or "぀" <= prev <= "ヿ":
        return True
    j = dot
    while j > begin and (text[j - 1].isalnum() or text[j - 1] in ".'’-,"):
        j -= 1
    word = text[j:dot].strip(".,'’-").lower()
    follow = _WORD.match(text, k)
    after = follow[0].lower() if follow else ""
    abbr = word in m.abbreviations
    if word[-1:].isdigit():
        if text[begin:dot].strip().isdigit() and dot - begin <= 3:
            return False
        if len(word) <= 2 and ("#", after) in m.collocations:
            return False
        return c.isupper() or c.isdigit() and blank or not c.isalnum() or ord(c) > 0x2E80
    if not blank and len(word.rsplit(".", 1)[-1]) < 2 and not (abbr and "." in word):
        return False
    if len(word) == 1 and word.isalpha() and prev.isupper() and (word, after) in m.collocations:
        return False
    if c.islower():
        return False
    if c.isdigit():
        return not (abbr or word in m.leads)
    if text[k - 1] in "(（[" and abbr:
        return False
    if not abbr:
        return True
    if word in m.titles:
        return False
    return not (flat and (word, after) in m.inner)


@functools.cache
def _closing(close: str):
    return regex.compile(f"[{regex.escape(close + LINE_ENDS)}]")


def spans(text: str | None, model: Model = EMPTY) -> list[tuple[int, int]]:
    """(start, end) of the units, in code points of the text."""
    if not text:
        return []
    read, at = readable(text)
    flat = caseless(read)
    n = len(read)
    out: list[tuple[int, int]] = []
    begin = 0  # of the unit
    close = ""  # what closes the open quotation
    opened = False  # the unit began with its quotation
    colon = False

    def end_unit(stop: int) -> None:
        nonlocal begin, close, opened
        a, b = begin, stop
        while a < b and read[a].isspace():
            a += 1
        while b > a and read[b - 1].isspace():
            b -= 1
        if any(map(str.isalnum, read[a:b])):
            out.append((a, b))
        begin, close, opened = stop, "", False

    i = 0
    while True:
        hit = (_closing(close) if close else _STOP).search(read, i)
        if hit is None:
            break
        p = hit.start()
        c = read[p]
        if c in LINE_ENDS:
            end_unit(p)
            begin = i = p + 1
            continue
        if close:  # the quotation ends here
            close = ""
            i = p + 1
            inner = read[:p].rstrip()[-1:]
            if not inner or inner not in MARKS + ELLIPSIS:
                continue
            k = i
            while k < n and read[k] in CLOSERS and read[k] not in QUOTES:
                k += 1
            i = k
            while k < n and read[k].isspace() and read[k] not in LINE_ENDS:
                k += 1
            if k >= n or read[k] in LINE_ENDS:
                continue
            nxt = read[k]
            if nxt in QUOTES or nxt in OPENERS:
                end_unit(i)
            elif opened or nxt.islower() or "ぁ" <= nxt <= "ゟ" or nxt in MARKS + ELLIPSIS + ",;:、，；：)）—–-":
                pass
            else:
                end_unit(i)
            continue
        if c in QUOTES:
            close = QUOTES[c]
            opened = not any(x.isalnum() for x in read[begin:p])
            i = p + 1
            continue
        k = p
        while k < n and read[k] in MARKS + ELLIPSIS:
            k += 1
        run = read[p:k]
        dots = set(run) <= set("." + ELLIPSIS) and (len(run) > 2 or any(x in ELLIPSIS for x in run))
        stop = k
        while stop < n and read[stop] in CLOSERS and read[stop] not in QUOTES:
            stop += 1
        if stop < n and read[stop] in '"”»」』' and not any(x in '"' for x in read[begin:p]) and read[stop] != '"':
            stop += 1
        q = stop
        while q < n and read[q].isspace() and read[q] not in LINE_ENDS:
            q += 1
        last = q >= n or read[q] in LINE_ENDS
        if last:
            i = k
            continue
        word = _WORD.match(read, q)
        if dots:
            yes = bool(word) and word[0][0].isupper() and not flat and word[0].lower() in model.starters
        elif any(x in FULL_MARKS for x in run):
            yes = read[q] not in ",;:、，；："
        elif any(x in "!?．" for x in run):
            yes = not (read[q].islower() or read[q] in ",;:、，；：" or q == stop and run == "．" and read[q].isdigit())
        elif len(run) == 2:
            yes = not read[q].islower()
        else:
            yes = stop > k and not read[q].islower() and read[q] not in ",;:" or stop == k and _ends_here(read, model, p, begin, flat)
        if yes:
            end_unit(stop)
        i = stop
    end_unit(n)
    if at is None:
        return out
    return [(at[a], at[b - 1] + 1) for a, b in out]


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, Counter] = {}
        for text in batch.column(0).to_pylist():
            if text:
                observe(text, counts.setdefault(language(text), Counter()))
        rows = [(lang, *key, n) for lang, c in counts.items() for key, n in c.items()]
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string()] * 4 + [pa.int64()])], ["lang", "kind", "a", "b", "n"])


LLR_SQL = """
SELECT *, 2 * (
  CASE WHEN k > 0 THEN k * ln(k / (x * y / t)) ELSE 0 END
  + CASE WHEN x > k THEN (x - k) * ln((x - k) / (x * (t - y) / t)) ELSE 0 END
  + CASE WHEN y > k THEN (y - k) * ln((y - k) / ((t - x) * y / t)) ELSE 0 END
  + CASE WHEN t - x - y + k > 0 THEN (t - x - y + k) * ln((t - x - y + k) / ((t - x) * (t - y) / t)) ELSE 0 END) AS llr
FROM (SELECT *, cast(k0 AS double) AS k, cast(x0 AS double) AS x, cast(y0 AS double) AS y, cast(t0 AS double) AS t FROM {counts})
"""


def _llr(counts: DataFrame) -> DataFrame:
    """Adds llr for k joint events of x and y out of t (columns k0, x0, y0, t0)."""
    return counts.sparkSession.sql(LLR_SQL, counts=counts.where("t0 > x0 and t0 > y0 and x0 > 0 and y0 > 0"))


def learn(texts: DataFrame) -> dict[str, Model]:
    """Models by language from a one-column table of texts; statistics cover all of them."""
    raw = texts.mapInArrow(_observe, "lang string, kind string, a string, b string, n long")
    n = cut(raw.groupBy("lang", "kind", "a", "b").agg(F.sum("n").alias("n")))
    dot = n.where("kind = '.'")
    plain = n.where("kind = 'w'").groupBy("lang", "a").agg(F.sum("n").alias("plain"))
    known = n.where("kind = 'l'").select("lang", F.col("a").alias("b")).distinct().withColumn("common", F.lit(True))
    pairs = n.where("kind = 'p'").drop("kind").join(known, ["lang", "b"], "left")
    by_word = dot.groupBy("lang", "a").agg(
        F.sum("n").alias("dotted"),
        *[F.sum(F.when(F.col("b") == x, F.col("n")).otherwise(0)).alias(x) for x in ("end", "lower", "digit", "upper", "in")],
    )
    common = pairs.groupBy("lang", "a").agg(F.sum(F.when(F.col("common"), F.col("n")).otherwise(0)).alias("common"), F.count("*").alias("followers"))
    by_word = by_word.join(plain, ["lang", "a"], "left").join(common, ["lang", "a"], "left").na.fill(0, ["plain", "common", "followers"])
    totals = n.where("kind in ('w', '.')").groupBy("lang").agg(F.sum("n").alias("t0"), F.sum(F.when(F.col("kind") == ".", F.col("n")).otherwise(0)).alias("y0"))
    scored = _llr(by_word.join(totals, "lang").selectExpr("*", "dotted as k0", "dotted + plain as x0"))
    letters = F.length(F.regexp_replace("a", "[.]", ""))
    inner = F.length("a") - letters
    excess = F.when(F.col("k") / F.col("x") > F.col("y") / F.col("t"), F.col("llr")).otherwise(0.0)
    score = excess * F.exp(-letters.cast("double")) * (inner + 1) * F.pow(letters.cast("double"), -F.col("plain"))
    # a period that goes on in lower case, with a digit or a comma inside the sentence is further evidence
    open_ = F.col("lower") + F.col("digit") + F.col("in")
    score = score + F.when((open_ > 0) & (F.col("plain") <= open_) & (letters <= 5), F.lit(ABBREVIATION)).otherwise(0.0)
    title = (F.col("upper") > 0) & (F.col("followers") >= F.least(0.3 * F.col("upper"), F.lit(3.0))) & (F.col("common") <= 0.05 * F.col("upper")) & (F.col("end") + F.col("lower") + F.col("in") <= 0.02 * F.col("dotted"))
    abbr = scored.where("a not in ('#', '##')").select("lang", "a", score.alias("score"), title.alias("title"), (F.col("plain") + F.col("dotted")).alias("n")).where(F.col("score") >= ABBREVIATION)
    leads = by_word.where("a not in ('#', '##') and digit >= 2 and digit >= 0.5 * dotted")
    # starters: after a sure boundary more often than elsewhere
    use = n.where("kind in ('l', 'u', 's')").groupBy("lang", "a").agg(
        F.sum(F.when(F.col("kind") != "s", F.col("n")).otherwise(0)).alias("x0"), F.sum(F.when(F.col("kind") == "s", F.col("n")).otherwise(0)).alias("k0")
    )
    whole = use.groupBy("lang").agg(F.sum("x0").alias("t0"), F.sum("k0").alias("y0"))
    starters = _llr(use.join(whole, "lang")).where(f"llr >= {STARTER} and k / x > y / t")
    # collocations of numbers and initials with the next word
    after = n.where("kind in ('p', 'q') and (a = '#' or length(a) = 1)").groupBy("lang", "a", "b").agg(F.sum("n").alias("k0"))
    left = by_word.select("lang", "a", F.col("dotted").alias("x0"))
    right = use.select("lang", F.col("a").alias("b"), F.col("x0").alias("y0"))
    pairs2 = _llr(after.join(left, ["lang", "a"]).join(right, ["lang", "b"]).join(whole.select("lang", "t0"), "lang"))
    colloc = pairs2.where(f"llr >= {COLLOCATION} and k / x > y / t and k >= 5")
    inside = n.where("kind = 'q'").join(abbr.select("lang", "a"), ["lang", "a"])
    out: dict[str, Model] = {}
    for r in abbr.toLocalIterator():
        m = out.setdefault(r.lang, Model())
        m.abbreviations.add(r.a)
        if r.title:
            m.titles.add(r.a)
    for r in leads.toLocalIterator():
        out.setdefault(r.lang, Model()).leads.add(r.a)
    for r in starters.select("lang", "a").toLocalIterator():
        out.setdefault(r.lang, Model()).starters.add(r.a)
    for r in colloc.select("lang", "a", "b").toLocalIterator():
        if r.b not in out.get(r.lang, EMPTY).starters:
            out.setdefault(r.lang, Model()).collocations.add((r.a, r.b))
    for r in inside.select("lang", "a", "b").toLocalIterator():
        out.setdefault(r.lang, Model()).inner.add((r.a, r.b))
    return out


def _cut(models):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = models.value
        for batch in batches:
            keep, start, end = [], [], []
            for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                for a, b in spans(text, known.get(language(text or ""), EMPTY)):
                    keep.append(i)
                    start.append(a)
                    end.append(b)
            rows = batch.take(pa.array(keep, pa.int64())).columns[:-1]
            yield pa.RecordBatch.from_arrays([*rows, pa.array(start, pa.int64()), pa.array(end, pa.int64())], [*batch.schema.names[:-1], "start_pos", "end_pos"])

    return run


def sentences(df: DataFrame, keys: list[str], text: str, models: dict[str, Model] | None = None) -> DataFrame:
    """keys, start_pos, end_pos: one row per sentence unit of each distinct row; models are learned from the same texts if none are given.

    Statistics count a repeated row as often as it stands there, which spares a shuffle of all texts.
    """
    rows = df.select(*keys, F.col(text).alias("text")).where(F.col("text").isNotNull())
    if models is None:
        models = learn(rows.select("text"))
    rows = rows.distinct()
    held = rows.sparkSession.sparkContext.broadcast(models)
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", start_pos bigint, end_pos bigint"
    return rows.mapInArrow(_cut(held), schema)


def parts(df: DataFrame) -> DataFrame:
    """(sample_id, generation_round, text_part, text): the source and every variant's translation."""
    variants = df.select("sample_id", "generation_round", F.explode("variants").alias("v"))
    rows = df.select("sample_id", "generation_round", F.lit("source_text").alias("text_part"), F.col("source_text").alias("text")).union(
        variants.select("sample_id", "generation_round", F.upper(F.trim("v.id")), F.col("v.translation"))
    )
    return rows.where("text is not null and text_part is not null")
