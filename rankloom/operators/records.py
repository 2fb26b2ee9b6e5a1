"""Operations on nested records: variants, lookups, validation, catalogues, search."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import collapse

# The six candidate letters of a complete record.
LETTERS = list("ABCDEF")


def variants(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, letter, feature_target, translation: one row per variant, re-delivered rows once.

    Feature targets lose case, blanks and a leading letter, so that spelling variants agree.
    """
    rows = df.select(*keys, F.explode("variants").alias("v"))
    target = F.regexp_replace(F.regexp_replace(F.lower(F.trim("v.feature_target")), "[ -]+", "_"), "^[a-f]_", "")
    return rows.select(*keys, F.upper(F.trim("v.id")).alias("letter"), target.alias("feature_target"), F.col("v.translation").alias("translation")).distinct()


def variant_errors(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, missing, extra, blank: letters that a record lacks, has in excess, or leaves untranslated."""
    ids = F.transform("variants", lambda v: F.upper(F.trim(v["id"])))
    want = F.array(*[F.lit(x) for x in LETTERS])
    blank = F.transform(F.filter("variants", lambda v: F.coalesce(collapse(v["translation"]), F.lit("")) == ""), lambda v: v["id"])
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return df.select(*keys, joined(F.array_except(want, ids)).alias("missing"), joined(F.array_except(ids, want)).alias("extra"), joined(blank).alias("blank")).distinct()


def repeated_fields(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, letter, issue: variants that are blank or repeat an earlier letter's text of the same record."""
    rows = variants(df, keys)
    text = collapse(F.col("translation"))
    first = F.min("letter").over(W.partitionBy(*keys, text))
    issue = F.when(F.coalesce(text, F.lit("")) == "", "blank").when(first < F.col("letter"), "repeated")
    return rows.select(*keys, "letter", issue.alias("issue")).where("issue is not null")


def classify(path: Column, rules: list[tuple[str, str]], default: str = "other") -> Column:
    """The category of the first rule whose text the path contains."""
    out = None
    for needle, category in rules:
        test = path.contains(needle)
        out = F.when(test, category) if out is None else out.when(test, category)
    return F.lit(default) if out is None else out.otherwise(default)


# Which part of an artifact's path names its category, in order of precedence.
ARTIFACT_RULES = [
    ("/datasets/", "dataset"),
    ("/rankings/", "judge ranking output"),
    ("five_models.pairwise_agreement", "model agreement"),
    ("model_vs_consensus_agreement", "model agreement"),
    ("consensus_borda", "consensus ranking"),
    ("condorcet", "consensus ranking"),
    ("high_disagreement", "model disagreement"),
    ("minority_model", "model disagreement"),
    ("local_embedding", "LaBSE semantic similarity"),
    ("crosslingual_nli", "cross-lingual NLI"),
    ("target_lm", "target-language LM"),
    ("syntax_info", "dependency syntax"),
    ("deep_features", "rule/proxy features"),
    ("joint_features.cluster_robust", "joint logistic with cluster-robust SE"),
    ("joint_features.pairwise_logistic", "joint logistic"),
    ("joint_features.pairwise_observations", "pairwise regression design"),
    ("model_top1_averages", "top-1 feature average"),
    ("pairwise_logistic_preferences", "single-feature logistic"),
    ("method_notes", "method notes"),
    (".cache.", "cache"),
]


def catalogue(paths: DataFrame, versions: list[str]) -> DataFrame:
    """(path, version, direction, format, category) of artifact paths."""
    p = F.replace("path", F.lit("\\"), F.lit("/"))
    head = F.split_part(p, F.lit("/"), F.lit(1))
    return paths.select(
        p.alias("path"), F.when(head.isin(versions), head).otherwise("").alias("version"),
        F.when(p.contains("/ec/"), "EC").when(p.contains("/ce/"), "CE").otherwise("").alias("direction"),
        F.upper(F.regexp_extract(p, "[.]([^./]+)$", 1)).alias("format"), classify(p, ARTIFACT_RULES).alias("category"),
    )


def search(df: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Rows any of whose columns contains the query, case ignored; null columns match nothing."""
    return df.where(F.lower(F.concat_ws("\n", *columns)).contains(query.lower()))


def override(base: DataFrame, better: DataFrame, key: str) -> DataFrame:
    """Union in which a row of better replaces the row of base with the same key."""
    both = base.withColumn("_p", F.lit(1)).unionByName(better.withColumn("_p", F.lit(0)), allowMissingColumns=True)
    columns = [c for c in both.columns if c != "_p"]
    return both.groupBy(key).agg(F.min_by(F.struct(*columns), "_p").alias("_r")).select(*[F.col(f"_r.{c}").alias(c) for c in columns])


def strict_lookup(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A join that fails on the first left key without a match instead of dropping or keeping it."""
    out = left.join(right.withColumn("_hit", F.lit(True)), key, "left")
    checked = F.when(F.col("_hit").isNull(), F.raise_error(F.concat(F.lit("no match for "), F.col(key).cast("string")))).otherwise(F.col("_hit"))
    return out.withColumn("_hit", checked).where("_hit").drop("_hit")


def first_source(*sources: Column) -> Column:
    """The first source that has a value; a row that none of them resolves stops the query."""
    return F.coalesce(*sources, F.raise_error(F.lit("no source resolves this row")).cast("string"))


# Names of the field that holds the source text, in order of precedence; fields that are never text.
SOURCE_FIELDS = ["source_text", "source", "input", "original_text", "text"]
META_FIELDS = ["id", "direction", "source_lang", "target_lang"]
# Names of fields that hold candidates.
CANDIDATE_NAME = r"(?i)^candidate[_-]?[A-Za-z0-9]+$|translation|variant|译文|候选"
LONG_FIELD = 40


def strings_of(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def source_field(df: DataFrame) -> Column:
    """The name of the row's source field: the first preferred one that isn't blank, else the longest string field, else empty."""
    names = strings_of(df)
    preferred = [F.when(F.trim(F.col(n)) != "", n) for n in SOURCE_FIELDS if n in names]
    longest = F.array_max(F.array(*[F.struct(F.coalesce(F.length(n), F.lit(-1)).alias("size"), (-F.lit(i)).alias("place"), F.lit(n).alias("name")) for i, n in enumerate(names)])) if names else None
    return F.coalesce(*preferred, *([F.when(longest["size"] >= 0, longest["name"])] if names else []), F.lit(""))


def natural_key(name: str) -> list:
    """Sorts digits inside names by value, case ignored."""
    return [(0, int(x), "") if x.isdigit() else (1, 0, x) for x in regex.split(r"(\d+)", name.casefold()) if x]


def candidate_fields(df: DataFrame, source: str) -> list[str]:
    """String columns that hold candidates, in natural order: by name, else those of more than LONG_FIELD characters in some row."""
    names = [n for n in strings_of(df) if n != source]
    named = [n for n in names if regex.search(CANDIDATE_NAME, n)]
    if not named:
        rest = [n for n in names if n not in META_FIELDS]
        size = df.agg(*[F.max(F.length(n)).alias(n) for n in rest]).first() if rest else {}
        named = [n for n in rest if (size[n] or 0) > LONG_FIELD]
    return sorted(named, key=natural_key)


def common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    """Columns of the left table that the right one has too, in the left one's order."""
    return [c for c in left.columns if c in set(right.columns)]


def key_of(m: Column, value: Column) -> Column:
    """The (smallest) key of a map that holds the value."""
    return F.array_min(F.map_keys(F.map_filter(m, lambda k, v: v == value)))


_ANCHOR = regex.compile(r'"id"\s*:\s*"([A-F])"')
_FIELD = {name: regex.compile(rf'"{name}"\s*:\s*"') for name in ("feature_target", "translation")}
VARIANTS = "array<struct<id:string,feature_target:string,translation:string>>"


def _after(part: str, name: str, close: int) -> str | None:
    """The text of a field whose quotes may not be escaped: up to the last quote before the next field or the brace."""
    start = _FIELD[name].search(part)
    if not start:
        return None
    later = [m.start() for other, p in _FIELD.items() if other != name and (m := p.search(part, start.end()))]
    end = part.rfind('"', start.end(), part.rfind(",", start.end(), min(later)) if later else close)
    return part[start.end() : end].replace('\\"', '"').replace("\\n", "\n") if end >= start.end() else None


def salvaged_variants(reply: str | None) -> list[dict[str, str | None]] | None:
    """The six variants of a reply whose JSON is broken by quotes inside the texts; null unless all six are there with a text."""
    if not reply:
        return None
    body = regex.sub(r"^\s*```(?:json)?|```\s*$", "", reply.strip()).strip()
    got: dict[str, dict[str, str | None]] = {}
    marks = list(_ANCHOR.finditer(body))
    for m, end in zip(marks, [*[m.start() for m in marks[1:]], len(body)]):
        part = body[m.end() : end]
        brace = part.rfind("}")
        brace = brace if brace >= 0 else len(part)
        text = _after(part, "translation", brace)
        if text is not None:
            got[m[1]] = {"id": m[1], "feature_target": _after(part, "feature_target", brace), "translation": text}
    return [got[x] for x in LETTERS] if sorted(got) == LETTERS else None


def parse_variants(reply: str | None) -> list[tuple[str, str]] | None:
    """(id, translation) of salvaged_variants."""
    got = salvaged_variants(reply)
    return [(v["id"], v["translation"]) for v in got] if got else None


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("id", "feature_target", "translation")])))
def _salvaged(reply: pd.Series) -> pd.Series:
    return reply.map(salvaged_variants)


def variants_of_replies(df: DataFrame, reply: str) -> DataFrame:
    """df with a column parsed: the six variants A to F of each reply, in order, or null.

    Well-formed JSON, fenced or not, an array or an object with variants, is parsed in the JVM; only the
    replies left over go through Python, in Arrow batches.
    """
    body = F.trim(F.regexp_replace(F.trim(reply), r"^```(?:json)?|```$", ""))
    parsed = F.coalesce(F.from_json(body, f"variants {VARIANTS}")["variants"], F.from_json(body, VARIANTS))
    ids = F.array_sort(F.transform(parsed, lambda v: v["id"]))
    whole = (ids == F.array(*[F.lit(x) for x in LETTERS])) & ~F.exists(parsed, lambda v: v["translation"].isNull())
    rows = df.withColumn("parsed", F.when(whole, F.array_sort(parsed)))
    rest = rows.where("parsed is null").withColumn("parsed", _salvaged(reply))
    return rows.where("parsed is not null").union(rest)
