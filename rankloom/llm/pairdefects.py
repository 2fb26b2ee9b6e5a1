"""Defective prompt-response pairs: empty, truncated, refused, copied or foreign responses.

Every variant answers a source text. Features of a variant come from its own text, the source and the
other variants of the row (which render the same content). From the features noisy labelling functions
vote on each defect: present, absent, or abstain where their evidence is missing. One label model per
defect is fitted by expectation maximization on the counts of vote patterns, of which there are at most
three to the power of the number of functions, however many rows there are. The posterior of each
pattern labels all rows with it. A variant keeps every defect whose posterior exceeds the cutoff: the
lowest one whose flagged set has an expected error within MAX_ERROR, also if every flag is judged by a model
that was fitted without its half of the records.

A refusal shows in its wording, for which there are lists, and whatever its wording in its relation to the
rest: sentences that neither the source nor the other variants account for, and responses that are
nothing but such sentences, much shorter than a rendering would be and without the source's numbers.

Null and blank responses are empty. A null source leaves the functions that need it abstaining. Rows
without variants give no row; re-delivered rows count once. defect() reports one defect per variant:
the first in the order of DEFECTS among those retained, since an unusable response needs no further type.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .sentences import FULL_MARKS, spans
from .textform import canonical

DEFECTS = ("empty", "refusal", "copied_source", "other_language", "truncated")
MAX_ERROR = 0.02
#: No cutoff lies below this posterior.
FLOOR = 0.9
ROUNDS = 200
#: Starting values of the label model: sensitivity and false alarms of a function, share of defective rows.
START = (0.7, 0.01, 0.02)

_NO_LETTER = re.compile(r"[\W_]+")
# Runs of Han characters, by the blocks of the script; of kana; of small Latin letters.
_HAN = re.compile("[\u2e80-\u2fd5\u3005\u3007\u3021-\u3029\u3038-\u303b\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufad9\U00020000-\U000323af]+")
_KANA = re.compile("[\u3041-\u3096\u309d-\u309f\u30a1-\u30fa\u30fd-\u30ff\u31f0-\u31ff\uff66-\uff6f\uff71-\uff9d]+")
_LATIN = re.compile("[a-z\u00df-\u024f]+")
_DIGIT = regex.compile(r"\p{Nd}")
_QUOTED = regex.compile(r"“[^”]*(?:”|$)|「[^」]*(?:」|$)|\"[^\"]*(?:\"|$)|«[^»]*(?:»|$)|„[^“”]*(?:[“”]|$)")
_LEAD = regex.compile(r"^\s*(?:[\[【(（][^\]】)）]{1,24}[\]】)）]\s*[:：]?|[^:：\n\d]{1,24}[:：])\s*|^[^\n\d]{1,24}\n")
_MARKS = FULL_MARKS + ".!?．"
_CLOSE = "”\"」』»)）]】’'"

# Wordings that stand for a missing text.
PLACEHOLDER = regex.compile(
    r"(?i)^\W*(?:n\s*/?\s*a|null|nil|none|nan|undefined|empty|blank|missing|tbd|tba|todo|placeholder|untranslated|no (?:text|translation|content|output|answer|data|response)"
    r"|(?:text|translation|content) (?:missing|unavailable|not available)|not available|not translated|空|空白|无|暂无|缺失|缺|待补|待译|待翻译|未翻译|未提供|无译文|无内容|暂无译文|暂无内容|译文缺失|内容缺失|此处为空|略)\W*$"
)
# Wordings of refusals, by kind of evidence.
SELF = regex.compile(r"(?i)(?:作为|身为)[^，。,.]{0,8}(?:模型|助手|人工智能|AI|系统|译者)|\bas an? [a-z ]{0,20}(?:model|system|assistant|ai|translator)\b|译者|\bI(?:'|’)?m an? (?:ai|language|translation)")
CANNOT = regex.compile(
    r"(?i)(?:无法|不能|不便|不会|无权|没有办法|没办法|暂不|不予|恕|拒绝|未能|难以|不宜|不在我|更希望|不方便|谢绝)[^。！？]{0,30}(?:译|版本|要求|作答|请求|材料|文字|内容|处理|帮助|提供|话题|范围|此段|本段|该段)"
    r"|(?:请求|要求)[^。]{0,6}拒绝"
    r"|(?:can(?:'|’)?t|can ?not|could not|unable|won(?:'|’)?t|will not|do not|don(?:'|’)?t|not able|decline|refus|must not|outside what|no version|no translation)[^.!?]{0,60}(?:assist|help|translat|request|version|produce|proceed|provide|passage|start|complet|offer|given|content|\.|$)"
)
POLICY = regex.compile(r"(?i)相关规定|内容限制|安全考虑|受限信息|政策|规定|合规|敏感|持证|违反|guideline|polic(?:y|ies)|violat|regulat|restricted|not permitted|licensed")
OFFER = regex.compile(r"(?i)请先补充|信息不足|不足以|感谢理解|敬请谅解|请谅解|请见谅|如需帮助|请告诉我|您可以|您好|可以帮您|建议咨询|其他话题|请提供|please try|please provide|could you|can you (?:share|provide)|clarify|different passage|regrettably|unfortunately|sorry|apologi[sz]e|抱歉|对不起|不好意思|遗憾")
META = regex.compile(r"(?i)翻译|译文|译者|版本|话题|原文|请求|作答|该段|此段|这段|该内容|材料|此类|处理|能力|translat|request|passage|\bversion\b|assist|source first|this (?:text|content)")
_CUT = regex.compile(r"[\p{Han}]\d*$")
_SCALE = {"million": 6, "billion": 9, "trillion": 12, "万": 4, "亿": 8}
_NUMBER = regex.compile(r"(\d[\d,]*(?:\.\d+)?)\s*(million|billion|trillion|万|亿)?")
_TIME = regex.compile(r"(?i)\b\d{1,2}(?:[.:]\d{2})?\s*[ap]\.m\.|\bsigned on \p{L}+\.? \d{1,2}")

FUNCTIONS: dict[str, list[str]] = {
    "empty": ["e_null", "e_bare", "e_word", "e_tiny"],
    "refusal": ["r_self", "r_cannot", "r_policy", "r_offer", "r_meta", "r_alien", "r_void"],
    "copied_source": ["c_share", "c_latin", "c_words"],
    "other_language": ["o_script", "o_own", "o_kana", "o_words"],
    "truncated": ["t_open", "t_dots", "t_number", "t_recall", "t_tail", "t_short", "t_goes_on", "t_hanging"],
}


def numbers(text: str) -> set[str]:
    out = set()
    for digits, scale in _NUMBER.findall(text):
        digits = digits.replace(",", "").rstrip(".")
        whole, _, part = digits.partition(".")
        shift = _SCALE.get(scale.lower(), 0)
        part = part.ljust(shift, "0")
        whole, part = whole + part[:shift], part[shift:].rstrip("0")
        out.add((whole.lstrip("0") or "0") + ("." + part if part else ""))
    return out


def letters(text: str) -> str:
    return _NO_LETTER.sub("", text.casefold())


def grams(s: str, n: int) -> list[str]:
    return list(map("".join, zip(*(s[i:] for i in range(n)))))


def _unquoted(text: str) -> str:
    return _QUOTED.sub(" ", text)


def _count(pattern, s: str) -> int:
    """How many characters of s belong to the runs that the pattern finds."""
    return sum(map(len, pattern.findall(s)))


class _Text:
    """What is computed once per variant."""

    def __init__(self, raw: str | None):
        self.raw = raw
        self.text = canonical(raw) or ""
        self.letters = letters(self.text)
        self.n = len(self.letters) - sum(map(str.isdigit, self.letters))
        self.han, self.kana, self.latin = _count(_HAN, self.letters), _count(_KANA, self.letters), _count(_LATIN, self.letters)
        self.chinese = self.n > 0 and self.han > 0.5 * self.n and self.kana <= 0.03 * self.n
        pairs = grams(self.letters, 2) if self.chinese else []
        self.pairs = frozenset(pairs)
        self.tail = frozenset(pairs[-max(6, len(self.letters) // 6) :])


def votes(source: str | None, texts: list[str | None]) -> list[dict[str, int]]:
    """For each variant the vote of every labelling function: 1 present, 0 absent, -1 abstains."""
    src = canonical(source) or ""
    src_letters = letters(src)
    src_grams = set(grams(src_letters, 5))
    src_words = set(regex.findall(r"\p{L}+", src.casefold()))
    ended = src.rstrip()[-1:] in _MARKS + _CLOSE if src.strip() else None
    timeless = [_TIME.sub(" ", src[a:b]) for a, b in spans(src)]
    last_numbers = next((n for u in reversed(timeless) if (n := numbers(u))), set())
    all_numbers = numbers(" ".join(timeless))
    t = [_Text(x) for x in texts]
    able = [v.chinese and v.n >= 0.07 * len(src_letters) for v in t]  # variants that can speak for the content
    held = Counter(chain.from_iterable(v.pairs for v, ok in zip(t, able) if ok))
    by_count: list[set[str]] = [set() for _ in range(len(t) + 2)]  # grams of exactly so many variants
    for g, n in held.items():
        by_count[n].add(g)
    least = [set().union(*by_count[n:]) for n in range(len(t) + 2)]  # of at least so many
    out = []
    for i, v in enumerate(t):
        peers = [p for j, p in enumerate(t) if j != i and able[j]]
        mine_too = v.pairs if able[i] else frozenset()  # grams of held that are the variant's own count one less
        several = least[2] if able[i] else least[1]  # grams of other variants, but for those that only a cut of this one makes
        known = lambda g: held[g] - (g in mine_too) > 0  # noqa: B023, E731
        f: dict[str, int] = {}
        blank = not v.letters
        # empty
        f["e_null"] = int(v.raw is None or not v.text.strip())
        f["e_bare"] = int(blank)
        f["e_word"] = int(blank or len(v.text) < 80 and bool(PLACEHOLDER.match(v.text.strip())))
        f["e_tiny"] = int(len(v.letters) <= 8 and not _DIGIT.search(v.letters) and not any(known(g) for g in grams(v.letters, 2)) and bool(f["e_word"] or len(v.letters) < 3))
        if blank or f["e_word"]:
            out.append(f | {k: 0 for d in DEFECTS[1:] for k in FUNCTIONS[d]})
            continue
        # refusal: only sentences that neither the source nor the other variants account for can be one
        lead = _LEAD.match(v.text)
        body = v.text[lead.end() :] if lead and letters(v.text[lead.end() :]) else v.text
        strange, alien, rendered = [], False, False
        for a, b in spans(body):
            u = _unquoted(body[a:b])
            w = letters(u)
            if _DIGIT.search(w):
                rendered = True
                continue
            c = _count(_HAN, w)
            own = grams(w, 2) if c else grams(w, 5)
            if not own:
                continue
            han = c > 0.5 * len(w)
            share = sum(map((several if han else src_grams).__contains__, own)) / len(own)
            if han and share < 0.6:
                share = sum(map(known, own)) / len(own)
            if han and peers and share >= 0.6 or not han and src_grams and share >= 0.4:
                rendered = True
                continue
            strange.append(u)
            alien |= len(w) >= 6 and (han and bool(peers) and share < 0.3 or not han and bool(src_grams) and share < 0.12 and w.isascii())
        plain = " ".join(strange)
        if plain:
            f["r_self"], f["r_cannot"], f["r_policy"] = (int(bool(p.search(plain))) for p in (SELF, CANNOT, POLICY))
            f["r_offer"], f["r_meta"] = (int(bool(p.search(plain))) for p in (OFFER, META))
        else:
            f |= dict.fromkeys(("r_self", "r_cannot", "r_policy", "r_offer", "r_meta"), 0)
        f["r_alien"] = int(alien) if peers or src_grams else -1
        body_letters = letters(body)
        if not (peers and src_grams):
            f["r_void"] = -1
        elif alien and not rendered:
            size = sorted(len(p.letters) for p in peers)[len(peers) // 2]
            f["r_void"] = int(len(body_letters) < (0.45 * size if v.chinese else 0.5 * len(src_letters)))
        else:
            f["r_void"] = 0
        # copy and language
        foreign = v.n - v.han
        mostly_latin = v.latin > 0.5 * v.n
        own = [g for g in grams(body_letters, 5) if not _HAN.search(g)] if foreign > 0.2 * v.n else []
        share = sum(map(src_grams.__contains__, own)) / len(own) if own else 0.0
        words = regex.findall(r"\p{Latin}+", body.casefold()) if foreign > 0 else []
        same = sum(w in src_words for w in words) / len(words) if words else 0.0
        f["c_share"] = int(mostly_latin and share >= 0.85) if src_grams else -1
        f["c_latin"] = int(mostly_latin and share >= 0.8 and len(own) >= 5) if src_grams else -1
        f["c_words"] = int(mostly_latin and same >= 0.88 and share >= 0.6) if src_words else -1
        meta = bool(f["r_self"] + f["r_cannot"] + f["r_policy"] + f["r_offer"] >= 1 and f["r_meta"] + f["r_cannot"] + f["r_alien"] >= 2 or f["r_void"] == 1)
        f["o_script"] = int(foreign > 0.5 * v.n and not (mostly_latin and share >= 0.8) and not meta)
        f["o_own"] = int(mostly_latin and share < 0.8 and not meta) if src_grams else -1
        f["o_kana"] = int(v.kana > 0.05 * v.n or (foreign - v.latin) > 0.3 * v.n)
        f["o_words"] = int(not v.chinese and not meta and same < 0.95 and share < 0.8)
        # truncation, of Chinese only
        if not v.chinese:
            f |= {k: 0 for k in FUNCTIONS["truncated"]}
            out.append(f)
            continue
        bare = v.text.rstrip()
        core = bare.rstrip(_CLOSE)
        f["t_open"] = -1 if ended is False else int(core[-1:] not in _MARKS + "…⋯" and bare[-1:] not in _CLOSE)
        f["t_dots"] = int(core.endswith(("…", "...", "⋯")))
        mine = numbers(v.text)
        f["t_number"] = int(not (last_numbers & mine)) if last_numbers and len(all_numbers) > 0 else -1
        if len(peers) >= 2:
            most = max(2, math.ceil(0.6 * len(peers)))  # of the others; the variant's own grams count one more
            only_others = by_count[most] - mine_too if able[i] else least[most]
            both = least[most + 1] if able[i] else set()
            total = len(both) + len(only_others)
            got = len(v.pairs & both) + len(v.pairs & only_others)
            f["t_recall"] = int(got < 0.85 * total) if total else -1
            tail = frozenset().union(*(p.tail for p in peers))
            tail = (tail & both) | (tail & only_others)
            f["t_tail"] = int(len(tail & v.pairs) < 0.6 * len(tail)) if tail else -1
            sizes = sorted(len(p.letters) for p in peers)
            f["t_short"] = int(len(v.letters) < 0.78 * sizes[len(sizes) // 2])
        else:
            f["t_recall"] = f["t_tail"] = -1
            f["t_short"] = int(len(v.letters) < 0.2 * len(src_letters)) if src_letters else -1
        end = core.rstrip("…⋯.")[-4:]
        f["t_goes_on"] = -1
        if len(end) == 4 and end[-1:].isalnum() and peers:
            for size in (4, 3):
                after = [p.text[k + size : k + size + 1] for p in peers for k in _places(p.text, end[-size:])]
                if after:
                    f["t_goes_on"] = int(all(a.isalnum() or a in "·%.％" for a in after if a) and all(after))
                    break
        opens = sum(map(core.count, "“「『《（"))
        closes = sum(map(v.text.count, "”」』》）"))
        f["t_hanging"] = int(opens > closes or bare[-1:] in "，,、：:；;·“「（(" or bool(_CUT.search(core)) and f["t_goes_on"] == 1)
        out.append(f)
    return out


def _places(text: str, part: str) -> list[int]:
    """Where the part stands in the text, overlaps left out."""
    out, k = [], text.find(part)
    while k >= 0:
        out.append(k)
        k = text.find(part, k + len(part))
    return out


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["sample_id", "generation_round", "variant_id", *DEFECTS]
    for batch in batches:
        rows = []
        for sample, round_, source, variants in zip(*(batch.column(i).to_pylist() for i in range(4))):
            known = [v for v in variants or [] if v is not None]
            for v, f in zip(known, votes(source, [v["translation"] for v in known])):
                rows.append((sample, round_, (v["id"] or "").strip().upper() or None, *(pattern(f, d) for d in DEFECTS)))
        cols = list(zip(*rows)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64()] + [pa.string()] * (1 + len(DEFECTS)))], names)


def fit(patterns: dict[str, int], rounds: int = ROUNDS) -> dict[str, float]:
    """Posterior of the defect for every vote pattern, by expectation maximization.

    Votes are independent given the class; '?' is an abstention and carries no evidence. Every function
    is held better than chance, so that the classes can't change places.
    """
    if not patterns:
        return {}
    width = len(next(iter(patterns)))
    hit, false, prior = [START[0]] * width, [START[1]] * width, START[2]
    post: dict[str, float] = {}
    for _ in range(rounds):
        moved = 0.0
        for p in patterns:
            a, b = math.log(prior), math.log(1 - prior)
            for k, c in enumerate(p):
                if c != "?":
                    a += math.log(hit[k] if c == "1" else 1 - hit[k])
                    b += math.log(false[k] if c == "1" else 1 - false[k])
            new = 1 / (1 + math.exp(min(700, b - a)))
            moved = max(moved, abs(new - post.get(p, -1)))
            post[p] = new
        total = sum(patterns.values())
        prior = min(0.5, max(1e-6, (sum(post[p] * n for p, n in patterns.items()) + 0.5) / (total + 1)))
        for k in range(width):
            pos = [(post[p] * n, (1 - post[p]) * n, p[k]) for p, n in patterns.items() if p[k] != "?"]
            yes, no = sum(x for x, _, _ in pos), sum(y for _, y, _ in pos)
            hit[k] = (sum(x for x, _, c in pos if c == "1") + 7) / (yes + 10)
            false[k] = (sum(y for _, y, c in pos if c == "1") + 0.1) / (no + 10)
            hit[k] = min(0.995, max(hit[k], 2 * false[k], 0.05))
            false[k] = min(0.3, max(false[k], 1e-5))
        if moved < 1e-6:
            break
    return post


def cutoff(patterns: dict[str, int], post: dict[str, float], judge: dict[str, float] | None = None, max_error: float = MAX_ERROR) -> float:
    """The lowest cutoff, FLOOR at least, above which the expected share of wrong flags is within max_error.

    The posteriors flag; those of judge, else the same ones, say how likely a flag is wrong.
    """
    judge = post if judge is None else judge
    best, n, wrong = 1.0, 0, 0.0
    for p in sorted(patterns, key=lambda p: -post.get(p, 0.0)):
        if post.get(p, 0.0) < FLOOR:
            break
        n += patterns[p]
        wrong += patterns[p] * (1 - judge[p])
        if wrong <= max_error * n:
            best = post[p]
    return max(FLOOR, best) if n else FLOOR


def held_out(halves: list[dict[str, int]]) -> dict[str, float]:
    """The posterior of every pattern by models that haven't seen its rows: of those of one half by the other half's model."""
    every = dict.fromkeys(halves[0].keys() | halves[1].keys(), 0)  # patterns without a row get a posterior too
    first, second = (fit(every | h) for h in halves)
    out = {}
    for p in every:
        a, b = (h.get(p, 0) for h in halves)
        out[p] = (a * second[p] + b * first[p]) / (a + b)
    return out


def pattern(f: dict[str, int], defect: str) -> str:
    return "".join("?01"[f[k] + 1] for k in FUNCTIONS[defect])


def voted(df: DataFrame) -> DataFrame:
    """(sample_id, generation_round, variant_id, a vote pattern per defect), each variant once."""
    rows = df.select(F.col("sample_id").cast("bigint"), F.col("generation_round").cast("bigint"), "source_text", F.expr("transform(variants, v -> struct(v.id, v.translation))").alias("variants"))
    schema = "sample_id long, generation_round long, variant_id string, " + ", ".join(f"{d} string" for d in DEFECTS)
    return rows.where("sample_id is not null and variants is not null").mapInArrow(_votes, schema).where("variant_id is not null").distinct()


def labelled(df: DataFrame) -> DataFrame:
    """(sample_id, generation_round, variant_id, defect, posterior): every retained defect of every variant."""
    rows = cut(voted(df))
    long = rows.select("sample_id", "generation_round", "variant_id", F.explode(F.array(*[F.struct(F.lit(d).alias("defect"), F.col(d).alias("pattern")) for d in DEFECTS])).alias("x"))
    long = long.select("sample_id", "generation_round", "variant_id", "x.*")
    halves: dict[str, list[dict[str, int]]] = {d: [{}, {}] for d in DEFECTS}
    half = F.pmod(F.xxhash64("sample_id"), F.lit(2)).cast("int").alias("half")
    for r in long.groupBy("defect", half, "pattern").count().collect():  # at most 3 ** 8 patterns per defect and half
        halves[r.defect][r.half][r.pattern] = r["count"]
    keep = []
    for d in DEFECTS:
        counts = dict(Counter(halves[d][0]) + Counter(halves[d][1]))
        post = fit(counts)
        least = max(cutoff(counts, post), cutoff(counts, post, held_out(halves[d])))
        keep += [(d, p, x) for p, x in post.items() if x >= least]
    kept = df.sparkSession.createDataFrame(keep, "defect string, pattern string, posterior double")
    return long.join(F.broadcast(kept), ["defect", "pattern"]).select("sample_id", "generation_round", "variant_id", "defect", "posterior")


def defects(df: DataFrame) -> DataFrame:
    """(sample_id, generation_round, variant_id, defect): one row per defective variant."""
    order = functools.reduce(lambda w, k: w.when(F.col("defect") == DEFECTS[k], k), range(1, len(DEFECTS)), F.when(F.col("defect") == DEFECTS[0], 0))
    got = labelled(df).groupBy("sample_id", "generation_round", "variant_id").agg(F.min(F.struct(order.alias("k"), "defect")).alias("x"))
    return got.select("sample_id", "generation_round", "variant_id", "x.defect")
