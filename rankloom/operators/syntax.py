"""Dependency-tree measures over parsed tokens, given as arrays of structs per sentence.

A sentence is array<struct<id int, head int, deprel string, upos string, text string>>, head 0 for a
root; the whole vectors take an array of sentences, whose tokens may also have feats. The parser is not part of this package; parsed tokens are the input.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Relations and tags of the syntax measures.
ZH_CLAUSE = ["root", "ccomp", "xcomp", "acl", "advcl", "parataxis", "conj"]
EN_CLAUSE = ["root", "ccomp", "xcomp", "acl", "advcl", "parataxis", "conj", "relcl"]
ZH_MODIFIER = ["amod", "advmod", "nmod", "acl", "det", "clf", "mark", "case"]
EN_MODIFIER = ["amod", "advmod", "nmod", "acl", "compound", "det", "case", "obl", "appos"]
ZH_SUFFIX = "(性|化|度|率|者|方|额|量|值|力)$"
ZH_COORDINATION = ["和", "及", "以及", "并", "并且", "或", "或者", "与", "、"]
ZH_PASSIVE = ["被", "由", "为", "受到", "遭到", "经", "让", "给"]
ZH_CLAUSE_MARKS = "[。！？!?；;]"
EN_SUFFIX = "(tion|sion|ment|ness|ity|ance|ence|ism|ship|age)$"
CONTENT = ["NOUN", "PROPN", "VERB", "ADJ", "ADV", "NUM"]


def distances(tokens: Column) -> Column:
    """|id - head| of every token that isn't a root."""
    return F.transform(F.filter(tokens, lambda t: t["head"] != 0), lambda t: F.abs(t["id"] - t["head"]))


def distance_stats(tokens: Column, n_sentences: Column) -> dict[str, Column]:
    """mean, max and mean over tokens minus sentences; all 0 for a text of roots only."""
    d = distances(tokens)
    total = F.aggregate(d, F.lit(0).cast("double"), lambda a, x: a + x)
    mean = F.when(F.size(d) > 0, total / F.size(d)).otherwise(0.0)
    return {
        "mean_distance": F.round(mean, 6),
        "max_distance": F.coalesce(F.array_max(d), F.lit(0)).cast("double"),
        "normalised_distance": F.round(mean / F.greatest(F.size(tokens) - n_sentences, F.lit(1)), 6),
    }


def tree_depth(heads: Column, rounds: int = 16) -> Column:
    """Longest path from a root down; heads[i] is the head of token i + 1, 0 for a root.

    Pointer doubling inside the row: each round doubles the length of the path known, so rounds = 16
    settle trees of up to 65,536 levels. Tokens that no root reaches (cycles) are ignored.
    """
    state = F.struct(heads.alias("up"), F.transform(heads, lambda h: (h != 0).cast("int")).alias("d"))

    def double(s: Column, _: Column) -> Column:
        up, d = s["up"], s["d"]
        return F.struct(
            F.transform(up, lambda h: F.when(h == 0, 0).otherwise(F.coalesce(F.get(up, h - 1), F.lit(0))).cast("int")).alias("up"),
            F.zip_with(up, d, lambda h, x: (x + F.when(h == 0, 0).otherwise(F.coalesce(F.get(d, h - 1), F.lit(0)))).cast("int")).alias("d"),
        )

    last = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), state, double)
    reached = F.zip_with(last["up"], last["d"], lambda u, x: F.when(u == 0, x))
    return F.coalesce(F.array_max(reached), F.lit(0))


def _count(tokens: Column, test) -> Column:
    return F.size(F.filter(tokens, test))


def features_en(tokens: Column, n_sentences: Column) -> dict[str, Column]:
    """The English syntax measures that need tags only."""
    n = F.greatest(F.size(tokens), F.lit(1))
    content = F.greatest(_count(tokens, lambda t: t["upos"].isin(CONTENT)), F.lit(1))
    nouns = _count(tokens, lambda t: t["upos"].isin("NOUN", "PROPN"))
    suffix = _count(tokens, lambda t: t["upos"].isin("NOUN", "ADJ") & F.lower(t["text"]).rlike(EN_SUFFIX))
    of = _count(tokens, lambda t: F.lower(t["text"]) == "of")
    coordination = _count(tokens, lambda t: t["deprel"].isin("cc", "conj")) + _count(tokens, lambda t: F.lower(t["text"]).isin("and", "or", "but", "nor"))
    return {
        "clause_count": F.greatest(_count(tokens, lambda t: t["deprel"].isin(EN_CLAUSE)), n_sentences).cast("double"),
        "nominalisation_ratio": F.round((nouns + 0.7 * suffix + 0.35 * of) / content, 6),
        "modifier_density": F.round(_count(tokens, lambda t: t["deprel"].isin(EN_MODIFIER)) / n, 6),
        "coordination_count": coordination.cast("double"),
        "passive_count": _count(tokens, lambda t: F.lower(t["deprel"]).contains("pass")).cast("double"),
        "token_count": n.cast("double"),
        "avg_sentence_length": F.round(n / F.greatest(n_sentences, F.lit(1)), 6),
    }


def features_zh(tokens: Column, n_sentences: Column, text: Column) -> dict[str, Column]:
    """The Chinese syntax measures: tags, plus characters counted in the text itself."""
    from ..functions.text import count_terms

    n = F.greatest(F.size(tokens), F.lit(1))
    content = F.greatest(_count(tokens, lambda t: ~t["upos"].isin("PUNCT", "PART", "SYM")), F.lit(1))
    nominal = _count(tokens, lambda t: t["upos"].isin("NOUN", "PROPN", "PRON"))
    suffix = _count(tokens, lambda t: t["text"].rlike(ZH_SUFFIX))
    pieces = F.size(F.filter(F.split(text, ZH_CLAUSE_MARKS), lambda x: F.trim(x) != ""))
    return {
        "clause_count": F.greatest(_count(tokens, lambda t: t["deprel"].isin(ZH_CLAUSE)), pieces, n_sentences).cast("double"),
        "nominalisation_ratio": F.round((nominal + 0.5 * suffix + 0.35 * count_terms(text, ["的", "之"])) / content, 6),
        "modifier_density": F.round(_count(tokens, lambda t: t["deprel"].isin(ZH_MODIFIER)) / n, 6),
        "coordination_count": (_count(tokens, lambda t: t["deprel"].isin("cc", "conj")) + count_terms(text, ZH_COORDINATION)).cast("double"),
        "passive_count": (_count(tokens, lambda t: F.lower(t["deprel"]).contains("pass")) + count_terms(text, ZH_PASSIVE)).cast("double"),
        "token_count": n.cast("double"),
        "avg_sentence_length": F.round(n / F.greatest(n_sentences, F.lit(1)), 6),
    }


def passive(t: Column, feats: bool) -> Column:
    """Whether the token's relation, or its Voice feature, is passive."""
    by_relation = F.lower(t["deprel"]).contains("pass")
    return by_relation | F.coalesce(F.lower(t["feats"]).contains("voice=pass"), F.lit(False)) if feats else by_relation


def _whole(sentences: Column, base: dict[str, Column], ratio: Column, passive_name: str) -> dict[str, Column]:
    """The thirteen measures in their order, from those of the tags and those of the trees."""
    tokens, count = F.flatten(sentences), F.size(sentences)
    distance = distance_stats(tokens, count)
    depth = F.array_max(F.transform(sentences, lambda s: tree_depth(F.transform(s, lambda t: t["head"]))))
    return {
        "clause_count": base["clause_count"],
        "dependency_depth": F.coalesce(depth, F.lit(0)).cast("double"),
        "mean_dependency_distance": distance["mean_distance"],
        "max_dependency_distance": distance["max_distance"],
        "normalized_dependency_distance": distance["normalised_distance"],
        "nominalization_ratio": base["nominalisation_ratio"],
        "modifier_density": base["modifier_density"],
        "coordination_count": base["coordination_count"],
        passive_name: base["passive_count"],
        "sentence_compression_ratio": F.round(ratio, 6),
        "token_count": base["token_count"],
        "sentence_count": F.greatest(count, F.lit(1)).cast("double"),
        "avg_sentence_length": base["avg_sentence_length"],
    }


def vector_en(sentences: Column, source: Column, text: Column) -> dict[str, Column]:
    """The thirteen measures of an English text that renders a Chinese source; an empty parse counts as one sentence."""
    from ..functions.text import cjk_count, en_word_count

    tokens = F.flatten(sentences)
    base = features_en(tokens, F.greatest(F.size(sentences), F.lit(1)))
    base["passive_count"] = _count(tokens, lambda t: passive(t, True)).cast("double")
    return _whole(sentences, base, en_word_count(text) / F.greatest(cjk_count(source), F.lit(1)), "passive_count")


def vector_zh(sentences: Column, source: Column, text: Column) -> dict[str, Column]:
    """The thirteen measures of a Chinese text that renders an English source."""
    from ..functions.text import cjk_count, source_word_count

    base = features_zh(F.flatten(sentences), F.greatest(F.size(sentences), F.lit(1)), text)
    return _whole(sentences, base, cjk_count(text) / source_word_count(source), "passive_or_beishi_count")
