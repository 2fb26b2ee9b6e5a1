"""Replies of language models: their text, the review in it, and how long to wait before asking again."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_html

CONTENT = "$.choices[0].message.content"


def _kind(v: Column) -> Column:
    """STRING, BOOLEAN, a number type, ARRAY<...>, OBJECT<...>, VOID for JSON null; null where there is nothing."""
    return F.schema_of_variant(v)


def _text(v: Column) -> Column:
    """The value as text if it is a JSON string, else null."""
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def content(reply: Column) -> Column:
    """The text of a chat reply: a string, or the texts of a list of parts joined by line ends; null if there is none."""
    v = F.try_parse_json(reply)
    whole = F.try_variant_get(v, CONTENT, "variant")
    pieces = F.transform(F.try_variant_get(v, CONTENT, "array<variant>"), lambda p: F.coalesce(_text(p), _text(F.try_variant_get(p, "$.text", "variant"))))
    pieces = F.filter(pieces, lambda x: x.isNotNull())
    return F.coalesce(_text(whole), F.when(F.size(pieces) > 0, F.array_join(pieces, "\n")))


def _truth(v: Column) -> Column:
    """False for nothing, null, zero and whatever is empty."""
    text = F.try_variant_get(v, "$", "string")
    return (
        F.when(_kind(v).isNull() | (_kind(v) == "VOID"), False)
        .when(_kind(v) == "BOOLEAN", text == "true")
        .when(_kind(v) == "STRING", text != "")
        .when(_kind(v).startswith("ARRAY") | _kind(v).startswith("OBJECT"), ~F.to_json(v).isin("[]", "{}"))
        .otherwise(F.try_variant_get(v, "$", "double") != 0)
    )


def review(reply: Column, original: Column) -> Column:
    """struct(usable, score, category, issues, reason, cleaned_text) of a review given as a JSON object.

    The score is cut to 0..100 and 0 where it is missing or no number; a missing category is "reject", and
    so is that of an unusable text, whose cleaned text is empty. A usable text without a cleaned one keeps
    the original. Issues that are no list become a list of one. Null for a reply that is no JSON object.
    """
    v = F.try_parse_json(reply)
    get = lambda name, kind: F.try_variant_get(v, f"$.{name}", kind)
    usable = _truth(get("usable", "variant"))
    number = F.coalesce(get("score", "double"), get("score", "string").try_cast("double"), get("score", "boolean").cast("double"), F.lit(0.0))
    score = F.least(F.greatest(number.try_cast("bigint"), F.lit(0)), F.lit(100)).cast("int")
    category = F.coalesce(F.nullif(F.trim(get("category", "string")), F.lit("")), F.lit("reject"))
    issues = F.coalesce(get("issues", "array<string>"), F.when(get("issues", "string").isNotNull(), F.array(get("issues", "string"))), F.array().cast("array<string>"))
    cleaned = F.coalesce(F.nullif(normalize_html(get("cleaned_text", "string")), F.lit("")), original)
    return F.when(
        _kind(v).startswith("OBJECT"),
        F.struct(
            usable.alias("usable"), score.alias("score"), F.when(usable, category).otherwise("reject").alias("category"), issues.alias("issues"),
            F.coalesce(get("reason", "string"), F.lit("")).alias("reason"), F.when(usable, cleaned).otherwise("").alias("cleaned_text"),
        ),
    )


# Base, factor and most of the waits in seconds: factor * base**attempt, or factor * attempt where base is 1.
WAITS = {"generation_limited": (2, 5, 120), "generation_failed": (2, 3, 60), "review_limited": (1, 30, 180), "review_failed": (2, 1, 30)}


def backoff(attempt: Column, kind: str) -> Column:
    """Seconds to wait after the given failed attempt."""
    base, factor, most = WAITS[kind]
    grown = F.pow(F.lit(base), attempt) if base > 1 else attempt
    return F.least(grown * factor, F.lit(most)).cast("bigint")


def wait_seconds(attempt: int, kind: str) -> int:
    base, factor, most = WAITS[kind]
    return min(factor * (base**attempt if base > 1 else attempt), most)


class Limited(Exception):
    """Raised by a provider that is asked too often."""


def with_retries(call: Callable[[pd.Series], pd.Series], retries: int = 4, sleep: Callable[[float], None] = time.sleep) -> Callable[[pd.Series], pd.Series]:
    """A provider for from_provider that asks again after a failed batch, waiting longer each time; the last failure is raised."""

    def asked(texts: pd.Series) -> pd.Series:
        for attempt in range(1, retries + 1):
            try:
                return call(texts)
            except Exception as failure:  # whatever the provider raises
                if attempt == retries:
                    raise RuntimeError(f"failed after {retries} attempts: {failure}") from failure
                sleep(wait_seconds(attempt, "review_limited" if isinstance(failure, Limited) else "review_failed"))
        raise ValueError("at least one attempt is needed")

    return asked
