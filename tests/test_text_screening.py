import pandas as pd
from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.operators import distribution, sampling, screening, syntax


def value(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_text_functions(spark):
    assert value(spark, "<p>a&nbsp;　b\x0b</p> c\\/d ", T.normalize_html) == "a b c/d"
    assert value(spark, "中文 abc 龙", T.cjk_count) == 3
    assert value(spark, "state-of-the-art don't 6", T.en_word_list) == ["state-of", "the-art", "don't"]
    assert value(spark, "一。二！ ；三", T.zh_sentences) == ["一", "二", "三"]
    assert value(spark, "grew 6.6 percent. Then", T.en_sentences) == ["grew 6", "6 percent", "Then"]
    assert value(spark, "。。", T.zh_sentences) == ["。。"]
    assert value(spark, "我们 and 我", lambda c: T.count_terms(c, ["我", "我们"])) == 3
    assert value(spark, "١2 a", T.digit_count) == 2
    assert value(spark, "A-b, c! d", lambda c: T.dedupe_key(c, 3)) == "Abc"
    assert value(spark, '```json\n{"a": 1}\n```', T.fenced_json) == '{"a": 1}'
    assert value(spark, 'sure: {"a": {"b": 1}} ok', T.fenced_json) == '{"a": {"b": 1}}'
    assert value(spark, "none", T.fenced_json) is None
    for f in (T.cjk_count, T.normalize_html, T.zh_sentences, T.text_hash):
        value(spark, None, f), value(spark, "", f), value(spark, "x" * 200_000, f)


def test_style_measures(spark):
    got = spark.createDataFrame([("It was a decision of state. However, the movement is new.",)], "t string").select(*[v.alias(k) for k, v in T.style_en(F.col("t")).items()]).first().asDict()
    assert got == {"function_word_density": round(1 / 11, 6), "passive_density": round(2 / 11 * 100, 6), "pronoun_subject_ratio": 0.5, "connective_density": round(1 / 11 * 100, 6), "nominal_density": round(1 / 11 * 100, 6), "avg_sentence_length": 5.5}
    zh = spark.createDataFrame([("我们的可能性。因此被改",)], "t string").select(*[v.alias(k) for k, v in T.style_zh(F.col("t")).items()]).first()
    assert zh.function_word_density == 0.1 and zh.passive_density == 10.0 and zh.pronoun_subject_ratio == 0.5 and zh.connective_density == 10.0 and zh.nominal_density == 10.0


def test_mojibake():
    assert T._repaired("央行".encode().decode("latin1"), True) == "央行"
    assert T._repaired("央行利率", True) == "央行利率" and T._repaired("café", False) == "café"
    assert T._repaired("naïve café".encode().decode("cp1252"), False) in ("naïve café", "naÃ¯ve cafÃ©")


def test_reject_reasons(spark):
    body = "央行维持利率不变市场反应平稳分析人士认为政策取向保持稳定后续仍需观察各项数据" * 8
    good = body[:100] + "。" + body[100:200] + "。" + body[200:290] + "。"
    cases = {
        good: None, "短": "length", good[:-3] + "免责声明": "hard_noise", "a" * 200 + good[:60]: "cjk_ratio", body[:200] + "1" * 80: "digit_ratio",
        body[:250]: "sentence_count", good + "：" * 9: "punctuation_noise", "央行维持利率不变。" * 30: "fragmented", None: "length", "": "length",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", screening.reject_reason(F.col("t")).alias("r")).collect()
    assert {r.t: r.r for r in rows} == cases
    assert spark.createDataFrame([(None,)], "t string").select(screening.coarse_eligible(F.col("t")).alias("x")).first().x is False


def test_counters_conserve(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    c = screening.counters(docs, screening.reject_reason(F.col("text"))).first()
    assert c.scanned == docs.count() == c.accepted + c.rejected


def test_numbered_is_dense_and_ordered(spark):
    df = spark.range(0, 5000).select(((F.col("id") * 7919) % 5003).alias("k")).repartition(7)
    got = [r.row_no for r in screening.numbered(df, ["k"]).orderBy("k").collect()]
    assert got == list(range(5000))
    assert screening.numbered(spark.range(0), ["id"]).count() == 0


def test_accept_and_dedupe(spark):
    df = spark.createDataFrame([(3, "b"), (1, "a"), (2, "a"), (4, None)], "id int, t string")
    assert {r.dedupe_key: r.id for r in screening.first_per_key(df, F.col("t"), ["id"]).collect()} == {"a": 1, "b": 3, None: 4}
    assert [(r.id, r.serial_id) for r in screening.accept_until(df, F.col("t").isNotNull(), "id", 2).orderBy("id").collect()] == [(1, "DOC_000001"), (2, "DOC_000002")]
    assert [r.id for r in screening.not_done(df, df.where("id < 3"), ["id"]).orderBy("id").collect()] == [3, 4]


def test_distribution(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(1, 11)] + [("b", 5.0), ("b", None)], "g string, x double")
    got = {r.g: r for r in distribution.summary(df, ["g"], ["x"]).collect()}
    s = pd.Series(range(1, 11), dtype=float)
    assert (got["a"].median, got["a"].p05, got["a"].p95) == (5.5, round(s.quantile(0.05), 9), round(s.quantile(0.95), 9))
    assert got["a"]["std"] == round(s.std(ddof=0), 9) and got["b"]["std"] == 1.0 and got["b"].n == 1


def test_spans_equal_brute_force(spark):
    import random

    rng = random.Random(2)
    spans = [(k, rng.choice("xy"), s := rng.randrange(3000), s + rng.randrange(400)) for k in range(150)] + [(900, "x", None, 5), (901, None, 1, 9), (902, "x", 9, 3)]
    df = spark.createDataFrame(spans, "id int, book string, s int, e int")
    got = {(r.left_id, r.right_id) for r in sampling.overlapping(df, df, "book", "s", "e").collect()}
    ok = [x for x in spans if None not in x and x[2] <= x[3]]
    assert got == {(a[0], b[0]) for a in ok for b in ok if a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3]}
    taken = []
    for a in sorted(spans, key=lambda x: x[0]):
        clash = a in ok and any(t in ok and t[1] == a[1] and t[2] <= a[3] and a[2] <= t[3] for t in taken)
        if not clash:
            taken.append(a)
    greedy = {r.id for r in sampling.disjoint_first(df, F.col("id"), "book", "s", "e").collect()}
    assert greedy == {t[0] for t in taken}


def test_tree_depth(spark):
    chain = [0, *range(1, 300)]
    cases = [([0], 0), ([0, 1, 1, 2], 2), ([2, 1], 0), (chain, 299), ([], 0), ([0, 3, 2], 0)]
    df = spark.createDataFrame([(h, d) for h, d in cases], "h array<int>, d int")
    assert all(r.x == r.d for r in df.select("d", syntax.tree_depth(F.col("h")).alias("x")).collect())


def test_index_of_a_record_key_is_never_cut(spark):
    df = spark.createDataFrame([(7, "s", "a"), (9999, "s", "a"), (10000, "s", "a"), (10009, "s", "a"), (1234567, "s", "a")], "i bigint, k string, t string")
    got = [r.x for r in df.orderBy("i").select(T.record_key(F.col("i"), F.col("k"), F.col("t")).alias("x")).collect()]
    assert [x.split("|")[0] for x in got] == ["0007", "9999", "10000", "10009", "1234567"]


def test_record_keys_query_keeps_large_ids(spark, tmp_path):
    from rankloom.plans.catalogue import q_record_keys

    spark.createDataFrame([(5, "s", "a"), (10000, "s", "a"), (10001, "s", "a")], "doc_id bigint, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.k for r in q_record_keys(spark, str(tmp_path)).collect()} == {"s|0005", "s|10000", "s|10001"}
