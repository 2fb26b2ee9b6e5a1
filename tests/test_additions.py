import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions import replies
from rankloom.functions import text as X
from rankloom.operators import distribution, inference, judging, records, screening
from rankloom.session import drop_stored, stored
from rankloom.sources import readers, writers


def test_reply_content_and_reviews(spark):
    rows = ['{"choices": [{"message": {"content": "a\\nb"}}]}', '{"choices": [{"message": {"content": ["x", {"text": "y"}, {"text": 3}, 4]}}]}', '{"choices": []}', "no", None, '{"choices": [{"message": {"content": []}}]}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, r string")
    assert [r.c for r in df.orderBy("i").select(replies.content(F.col("r")).alias("c")).collect()] == ["a\nb", "x\ny", None, None, None, None]
    reviews = ['{"usable": [], "score": "88.9"}', '{"usable": {"a": 1}, "score": true, "issues": [1, null]}', "[]", None, "{}"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(reviews)], "i int, r string")
    got = [r.v for r in df.orderBy("i").select(replies.review(F.col("r"), F.lit("kept")).alias("v")).collect()]
    assert (got[0].usable, got[0].score, got[0].category, got[0].cleaned_text) == (False, 88, "reject", "")
    assert (got[1].usable, got[1].score, got[1].cleaned_text) == (True, 1, "kept") and got[2] is None and got[3] is None and got[4].usable is False


def test_retries_wait_longer_and_give_up():
    waits, calls = [], []

    def call(texts):
        calls.append(1)
        if len(calls) < 3:
            raise replies.Limited("slow down") if len(calls) == 1 else ValueError("bad")
        return texts

    assert replies.with_retries(call, 4, waits.append)(pd.Series(["a"])).tolist() == ["a"] and waits == [30, 4]
    with pytest.raises(RuntimeError, match="after 2 attempts"):
        replies.with_retries(lambda t: 1 / 0, 2, waits.append)(pd.Series(["a"]))


def test_parsed_replies(spark):
    whole = [{"id": x, "feature_target": f"f {x}", "translation": f'say "{x}", then go'} for x in "ABCDEF"]
    good = json.dumps({"variants": whole})
    rows = [(1, good), (2, f"```json\n{json.dumps(whole)}\n```"), (3, good.replace('\\"', '"')), (4, json.dumps(whole[:5])), (5, ""), (6, None)]
    got = {r.i: r.parsed for r in records.variants_of_replies(spark.createDataFrame(rows, "i int, reply string"), "reply").collect()}
    want = [(w["id"], w["feature_target"], w["translation"]) for w in whole]
    assert all([tuple(v) for v in got[i]] == want for i in (1, 2, 3)) and got[4] is None and got[5] is None and got[6] is None


def test_fields(spark):
    df = spark.createDataFrame([("1", None, "long text here", 5)], "id string, source_text string, other string, n int")
    assert df.select(records.source_field(df).alias("f")).first().f == "other"
    assert records.candidate_fields(spark.createDataFrame([("a", "b", "c")], "candidate_10 string, candidate_9 string, x string"), "x") == ["candidate_9", "candidate_10"]
    assert records.candidate_fields(spark.createDataFrame([("a" * 50, "b")], "body string, note string"), "") == ["body"]
    assert records.common_columns(df, df.drop("id")) == ["source_text", "other", "n"]
    with pytest.raises(Exception, match="no source"):
        df.select(records.first_source(F.col("source_text"))).collect()
    assert records.natural_key("a10") > records.natural_key("A9")


def test_exact_quantiles_of_hot_keys(spark):
    rng = np.random.default_rng(0)
    rows = [("a", float(x)) for x in rng.integers(0, 50, 3000)] + [("b", float(x)) for x in rng.normal(size=501)] + [("c", 1.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.q0, r.q1, r.q2) for r in distribution.quantiles(df, ["k"], "v", [0.05, 0.5, 0.95]).collect()}
    for k in "abc":
        want = np.quantile([v for x, v in rows if x == k], [0.05, 0.5, 0.95])
        assert np.allclose(got[k], want)


def test_weighted_numbers(spark):
    df = spark.createDataFrame([(i, i % 4 + 1) for i in range(200)], "i int, w int")
    got = [r.row_no for r in screening.numbered(df, ["i"], weight="w").orderBy("i").collect()]
    assert got == [sum(j % 4 + 1 for j in range(i)) for i in range(200)]
    assert screening.numbered(df.limit(0), ["i"]).count() == 0


def _ranks(spark):
    return spark.createDataFrame([("j1", 1, 1, 2, 3, 4, 5, 6), ("j2", 1, 6, 5, 4, 3, 2, 1)], "judge string, sample_id bigint, A int, B int, C int, D int, E int, F int")


def test_feature_differences(spark):
    feats = spark.createDataFrame([(1, x, float(i), None if x == "F" else 2.0 * i) for i, x in enumerate("ABCDEF")], "sample_id bigint, letter string, p double, q double")
    got = {(r.model, r.candidate_a, r.candidate_b): r for r in inference.feature_differences(_ranks(spark), feats, ["p", "q"]).collect()}
    assert len(got) == 30 and got["j1", "A", "C"].label == 1.0 and got["j2", "A", "C"].label == 0.0
    assert got["j1", "A", "C"].diff_p == -2.0 and got["j1", "A", "C"].diff_q == -4.0 and got["j1", "A", "F"].diff_q is None
    with pytest.raises(Exception, match="missing features"):
        inference.feature_differences(_ranks(spark), feats.where("letter < 'C'"), ["p"]).collect()


def test_given_coefficients_and_strict_consensus(spark):
    obs = spark.createDataFrame([("m", 1, 1.0, 0.5), ("m", 2, 0.0, -0.5), ("k", 1, 1.0, 1.0)], "model string, sample_id bigint, label double, x double")
    table = spark.createDataFrame([("m", "x", "0.5", "0.1"), ("m", "  ", "9", "9")], "model string, feature string, standardized_coefficient string, intercept string")
    got = inference.given_coefficients(obs.where("model = 'm'"), table, ["x"]).collect()
    assert [(r.model, r.beta) for r in got] == [("m", [0.1, 0.5])]
    with pytest.raises(Exception, match="no coefficient"):
        inference.given_coefficients(obs, table, ["x"]).collect()
    assert inference.replaced_features(["a", "b"], "a", ["c", "d"]) == ["b", "c", "d"]
    with pytest.raises(ValueError):
        inference.replaced_features(["a"], "z", [])
    with pytest.raises(Exception, match="no match"):
        judging.judge_vs_consensus(_ranks(spark), judging.consensus(_ranks(spark)).limit(0)).collect()
    empty = inference.fit_logistic(obs.limit(0), ["x"])
    assert empty.count() == 0


def test_unsettled_fit_raises(spark, monkeypatch):
    obs = spark.createDataFrame([("m", i, float(i % 2), float(i)) for i in range(9)], "model string, sample_id bigint, label double, x double")
    monkeypatch.setattr(inference, "MAX_STEPS", 1)
    with pytest.raises(RuntimeError, match="not settled"):
        inference.fit_logistic(obs, ["x"])


def test_json_array_cache_and_copies(spark, tmp_path):
    df = spark.createDataFrame([("中", None, 1), ("b\n", "x", None)], "a string, b string, n int")
    at = f"file://{tmp_path}"
    assert writers.write_json_array(df, f"{at}/x.json") == 2 and writers.write_json_array(df.limit(0), f"{at}/none.json") == 0
    assert sorted(json.loads((tmp_path / "x.json").read_text(encoding="utf-8")), key=lambda r: r["a"]) == [{"a": "b\n", "b": "x", "n": None}, {"a": "中", "b": None, "n": 1}]
    assert json.loads((tmp_path / "none.json").read_text()) == [] and "中" in (tmp_path / "x.json").read_text(encoding="utf-8")
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])
    assert readers.read_cache(spark, f"{at}/cache", schema, "k").count() == 0 and readers.accepted_count(spark, f"{at}/nothing") == 0
    writers.write_cache(spark.createDataFrame([(1, "a"), (2, "b")], schema), f"{at}/cache", 1)
    writers.write_cache(spark.createDataFrame([(2, "c")], schema), f"{at}/cache", 2)
    assert {(r.k, r.v) for r in readers.read_cache(spark, f"{at}/cache", schema, "k").collect()} == {(1, "a"), (2, "c")}
    files = spark.createDataFrame([(f"{at}/x.json", "deep/y.json")], "source_path string, organised_path string")
    assert writers.copy_artifacts(spark, files, f"{at}/copy") == 1 and (tmp_path / "copy" / "deep" / "y.json").exists()
    got = readers.read_csv_text(spark.createDataFrame([(1, "h,i\na,\n\n\"b,c\",d"), (2, "h,i"), (3, None)], "k int, t string"), "t", ["h", "i"], ["k"]).collect()
    assert [(r.k, r.row_index, r.h, r.i) for r in sorted(got, key=lambda r: r.row_index)] == [(1, 0, "a", None), (1, 1, "b,c", "d")]


def test_stored_tables_are_replaced(spark):
    one = stored(spark.range(3))
    two = stored(one.withColumn("x", F.col("id") + 1), replaces=one)
    assert two.count() == 3 and not readers.exists(spark, one._stored_at) and readers.exists(spark, two._stored_at)
    drop_stored(two)
    assert not readers.exists(spark, two._stored_at)


def test_small_text_functions(spark):
    df = spark.createDataFrame([("a<b> & 'c'", None)], "t string, n string")
    r = df.select(X.escape_html(F.col("t")).alias("e"), X.escape_html(F.col("n")).alias("z"), X.fill_template("{t}-{n}", t=F.col("t"), n=F.col("n")).alias("p"), X.utc_stamp(F.lit("2026-01-02 03:04:05").cast("timestamp")).alias("s")).first()
    assert (r.e, r.z, r.p, r.s) == ("a&lt;b&gt; &amp; &#39;c&#39;", None, "a<b> & 'c'-", "2026-01-02T03:04:05.000000+00:00")


def test_named_functions_and_reports(spark, tmp_path):
    from rankloom.operators import sampling

    (tmp_path / "own.py").write_text("def pick(x):\n    return x + 1\n")
    assert sampling.load(f"{tmp_path}/own.py:pick")(1) == 2 and sampling.load("math:sqrt")(4) == 2
    df = spark.createDataFrame([("a|b", None), ("c\nd", 1)], "x string, y int")
    assert writers.write_markdown(df.coalesce(1), f"file://{tmp_path}/r.md", "T", ["n"]) == 2
    assert (tmp_path / "r.md").read_text() == "# T\n\n- n\n\n| x | y |\n|-|-|\n| a\\|b |  |\n| c d | 1 |\n"


def test_undecided_samples_raise(spark):
    from rankloom.operators import sampling

    df = spark.createDataFrame([(str(i), "b", i, i + 1) for i in range(6)], "id string, book string, s int, e int")
    got = {r.id for r in sampling.disjoint_first(df, F.col("s"), "book", "s", "e").collect()}
    assert got == {"0", "2", "4"}
    with pytest.raises(RuntimeError, match="undecided"):
        sampling.disjoint_first(df, F.col("s"), "book", "s", "e", max_rounds=1)
