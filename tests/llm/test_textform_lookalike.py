import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom.llm import lookalike
from rankloom.llm.textform import LOOKALIKE_FROM, LOOKALIKE_TO, canonical, fold_codes, fold_slow, single_map, skeleton_map


def test_tables_fit():
    assert len(LOOKALIKE_FROM) == len(LOOKALIKE_TO)
    assert all(len(b) <= 1 for b in skeleton_map().values())


def test_forms():
    assert canonical("Ｓｏｒ​ё ﬁx") == "Sorё fix"
    assert canonical("café") == canonical("café")
    assert canonical("Рorra") == canonical("Porra")
    assert canonical("a\nb") != canonical("a b")
    assert canonical(None) is None and canonical("") == ""
    assert fold_codes(None).size == 0 and fold_codes("…—").size == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60))
def test_fold_equals_slow(s):
    assert fold_codes(s).tolist() == [ord(c) for c in fold_slow(s)]


def _pairs(df):
    return {tuple(r) for r in lookalike.looking_alike(df).select("key_a", "key_b").collect()}


def test_pairs_against_brute_force(spark):
    base = ["Porra sells office space.", "Ｐorra sells office space.", "Рorra sells oﬃce space.", "Porra sells office space.", "porra sells office space.", "café", "café", "cafe", "x​y", "xy", "", "", None, "ﾊﾟ", "パ", "1", "１", "a\nb", "a b"]
    rows = [(i, t, "extra") for i, t in enumerate(base)] + [(1, base[1], "again"), (None, base[0], "no key")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, look string")
    got = _pairs(lookalike.keyed(df, "documents", "doc_id", "text"))
    want = {(i, j) for i, a in enumerate(base) for j, b in enumerate(base) if i < j and a is not None and b is not None and a != b and canonical(a) == canonical(b)}
    assert got == want


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert _pairs(lookalike.keyed(df, "documents", "doc_id", "text")) == set()
    assert lookalike.consistent_form(lookalike.keyed(df, "t", "doc_id", "text")).count() == 0


def test_consistent_form_depends_on_its_own_text_only(spark):
    rows = [(1, "cafe\u0301"), (2, "caf\u00e9"), (3, "x" * 200_000), (4, None), (5, "nai\u0308f \u2163 \ufe0fa\u3164"), (2, "na\u00efve"), (6, "\u1112\u1161\u11ab")]
    df = spark.createDataFrame(rows, "id bigint, text string")
    got = {(r.k, r.canonical_key, r.form) for r in lookalike.consistent_form(lookalike.keyed(df, "t", "id", "text")).collect()}
    assert got == {(1, 2, "café"), (2, 2, "café"), (3, 3, "x" * 200_000), (5, 5, "naïf IV a"), (2, 2, "naïve"), (6, 6, "한")}


def test_keys_with_texts_of_two_classes_glue_nothing(spark):
    df = spark.createDataFrame([(1, "one A"), (1, "two B"), (2, "one \u0391"), (3, "two \u0392")], "id bigint, text string")
    assert _pairs(lookalike.keyed(df, "t", "id", "text")) == {(1, 2), (1, 3)}


def test_every_text_that_composition_changes_is_composed(spark):
    changing = [chr(cp) for cp in [*range(0xA0, 0xD800), *range(0xF900, 0x30000)] if unicodedata.normalize("NFC", canonical_single(chr(cp))) != canonical_single(chr(cp))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(changing)], "id bigint, text string")
    assert all(r.form == unicodedata.normalize("NFC", r.form) for r in lookalike.consistent_form(lookalike.keyed(df, "t", "id", "text")).collect())


def canonical_single(c):
    return single_map().get(c, c)


def test_block_never_parts_equals(spark):
    texts = ["é", "é", "한", unicodedata.normalize("NFD", "한"), "Å", "Å", "Å"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", lookalike.block(F.col("t")).alias("b"))
    by = {r.t: r.b for r in df.collect()}
    assert by["é"] == by["é"] and by["한"] == by[unicodedata.normalize("NFD", "한")] and by["Å"] == by["Å"]
