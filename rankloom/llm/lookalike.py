"""Visually identical texts: one consistent form per class of texts that look the same.

Every value is mapped (width forms, ligatures, radicals, look-alike letters, hyphens, blanks,
invisible characters) inside Spark, and the mapped values are grouped under the accent- and
case-sensitive Unicode collation, which also equates composed and combining accents. The canonical
member of a class is the one with the shortest mapped value, then the smallest key, then the smallest hash
of its text; it is joined back, and its (key, hash) names the class, since a key may have several texts.

Null texts form no class and give no row; empty texts are equal to each other character for
character. Repeated rows (same key and text) count once. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .textform import multi_map, single_map, skeleton_map

LAST_LATIN_LIGATURE = "\ufb06"


def _replaced(text: Column, table: dict[str, str]) -> Column:
    """One translate, plus a replace per ligature or numeral in the few texts that have one."""
    order = [a for a, b in table.items() if b] + [a for a, b in table.items() if not b]
    out = whole = F.translate(text, "".join(order), "".join(table[a] for a in order))
    several = {a: b for a, b in multi_map().items() if a <= LAST_LATIN_LIGATURE}
    for a, b in several.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(text.rlike(f"[{''.join(several)}]"), out).otherwise(whole)


def mapped(text: Column) -> Column:
    """Look-alike-mapped value; case and accents stay."""
    return _replaced(text, single_map())


def block(text: Column) -> Column:
    """A hash that is equal for all members of a class: of the mapped text without accents.

    It keeps rows apart that cannot look the same, so that only the few others are collated.
    """
    return F.xxhash64(_replaced(text, skeleton_map()))


def keyed(df: DataFrame, tab: str, key: str, text: str) -> DataFrame:
    """(tab, k, h, block, raw) per row: h tells texts that differ in their characters apart."""
    return df.select(
        F.lit(tab).alias("tab"),
        F.col(key).cast("bigint").alias("k"),
        F.xxhash64(text).alias("h"),
        block(F.col(text)).alias("block"),
        F.col(text).alias("raw"),
    ).where(F.col("raw").isNotNull() & F.col("k").isNotNull())


BLOCKS_SQL = """
SELECT tab, block FROM {values} GROUP BY tab, block HAVING min(h) <> max(h)
"""

CLASSES_SQL = """
SELECT tab, look, min(struct(length(look) AS n, k, h)) AS canonical
FROM {values} GROUP BY tab, look HAVING min(h) <> max(h)
"""

MEMBERS_SQL = """
SELECT DISTINCT v.tab, v.k, v.h, c.canonical.k AS canonical_key, c.canonical.h AS canonical_hash
FROM {values} v JOIN {classes} c ON v.tab = c.tab AND v.look = c.look
"""

PAIRS_SQL = """
SELECT DISTINCT a.tab AS tab, a.k AS key_a, b.k AS key_b
FROM {members} a JOIN {members} b
  ON a.tab = b.tab AND a.canonical_key = b.canonical_key AND a.canonical_hash = b.canonical_hash AND a.k < b.k AND a.h <> b.h
"""

@functools.cache
def composable() -> str:
    """A pattern; mapped texts it doesn't match are in composed form. By rule: marks, conjoining letters, and what composition replaces."""
    singles = [cp for cp in [*range(0xA0, 0xD800), *range(0xF900, 0x30000)] if unicodedata.normalize("NFC", chr(cp)) != chr(cp)]
    starts = [x for x, before in zip(singles, [-1, *singles]) if x != before + 1]
    ends = [x for x, after in zip(singles, [*singles[1:], -1]) if after != x + 1]
    return "[\\p{M}\\x{1100}-\\x{11FF}" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in zip(starts, ends)) + "]"


FORM_BLOCKS_SQL = """
SELECT tab, block, min(h) <> max(h) AS mixed, min(k) AS first FROM {values} GROUP BY tab, block
"""

CANONICAL_SQL = """
SELECT v.tab, v.k, v.h, c.canonical_key FROM {values} v
JOIN (SELECT tab, look, min(struct(length(look) AS n, k, h)).k AS canonical_key FROM {values} GROUP BY tab, look) c
ON v.tab = c.tab AND v.look = c.look
"""


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        form = [unicodedata.normalize("NFC", t) for t in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(form, pa.string())], batch.schema.names)


def composed(df: DataFrame) -> DataFrame:
    """df with its last column, a mapped text, in composed normal form; only texts that may change leave the JVM."""
    text = df.columns[-1]
    change = F.col(text).rlike(composable())
    return df.where(~change).union(df.where(change).mapInArrow(_composed, df.schema))


def consistent_form(values: DataFrame) -> DataFrame:
    """(tab, k, canonical_key, form) of keyed() rows: the canonical member of each text's class and its form.

    The form is the mapped text in composed normal form, whatever other texts there are, so forms of any
    two tables can be compared. A key with several texts has a row for each form; the classes are found in
    SQL under the collation, but for blocks that hold one text only, whose class is the block.
    """
    spark = values.sparkSession
    values = values.dropDuplicates(["tab", "k", "h"])
    rows = values.join(spark.sql(FORM_BLOCKS_SQL, values=values), ["tab", "block"]).select("tab", "k", "h", "mixed", "first", mapped(F.col("raw")).alias("form"))
    plain = rows.where("not mixed").select("tab", "k", F.col("first").alias("canonical_key"), "form")
    rest = cut(rows.where("mixed").select("tab", "k", "h", "form"))
    keys = spark.sql(CANONICAL_SQL, values=rest.select("tab", "k", "h", F.collate("form", "UNICODE").alias("look")))
    return composed(plain.union(rest.join(keys, ["tab", "k", "h"]).select("tab", "k", "canonical_key", "form"))).distinct()


def looking_alike(values: DataFrame) -> DataFrame:
    """(tab, key_a, key_b): rows of one table that look the same but differ in their characters.

    Blocks whose rows all hold one text are left out before any text is moved; the rest is grouped
    under the Unicode collation, and classes that hold differing members are joined back.
    """
    spark = values.sparkSession
    mixed = spark.sql(BLOCKS_SQL, values=values)
    rest = cut(
        values.join(mixed, ["tab", "block"], "left_semi").select("tab", "k", "h", F.collate(mapped(F.col("raw")), "UNICODE").alias("look")).distinct()
    )
    members = spark.sql(MEMBERS_SQL, values=rest, classes=spark.sql(CLASSES_SQL, values=rest))
    return spark.sql(PAIRS_SQL, members=members)
