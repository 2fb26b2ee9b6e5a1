"""Registered queries over the test tables, each with the SQL that checks it where SQL can express it."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import distribution, inference, judging, records, sampling, screening, syntax
from ..session import cut, shared_dir, table
from ..streaming import screen

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

LETTERS = judging.LETTERS
PAIRS = judging.PAIRS
#: The screen of Chinese texts, with its default thresholds.
RULES = screening.Rules()
EN_TERMS = ["percent", "per", "million", "on"]


#: Queries whose counts SQL gives as 64-bit integers.
WIDE = {"q_rankings_long", "q_judged_by_most", "q_normalize_html", "q_text_counts", "q_sentences", "q_feature_merge", "q_stratified_quota", "q_candidate_explode"}


def _wide(f):
    @functools.wraps(f)
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = f(spark, d)
        return df.select(*[F.col(c).cast("bigint").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])

    return run


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = _wide(f) if f.__name__ in WIDE else f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ judges

DECODED = """
decoded AS (
  SELECT DISTINCT lower(trim(judge)) AS judge, sample_id, rep,
    list_transform(coalesce(ranking, []), lambda x: upper(trim(x))) AS shown, t_map
  FROM judge_rankings),
lettered AS (
  SELECT DISTINCT judge, sample_id, rep,
    array_to_string(list_transform(shown, lambda x: coalesce(t_map[x], '?')), '') AS letters,
    len(shown) = 6 AND list_sort(list_distinct(shown)) = ['T1','T2','T3','T4','T5','T6'] AS valid
  FROM decoded),
firsts AS (
  SELECT judge, sample_id, min((rep, letters)) AS v FROM lettered WHERE valid AND judge IS NOT NULL AND sample_id IS NOT NULL GROUP BY ALL),
ranks AS (
  SELECT judge, sample_id, """ + ", ".join(f"instr(v[2], '{x}') AS {x}" for x in LETTERS) + """ FROM firsts)"""
RANKS = "WITH " + DECODED
LONG = RANKS + ", long AS (" + " UNION ALL ".join(f"SELECT judge, sample_id, '{x}' AS letter, {x} AS rank FROM ranks" for x in LETTERS) + ")"
AGREE = " + ".join(f"CAST((x.{a} < x.{b}) = (y.{a} < y.{b}) AS INT)" for a, b in PAIRS)
CONSENSUS = RANKS + ", sums AS (SELECT sample_id, " + ", ".join(f"sum({x})::BIGINT AS {x}" for x in LETTERS) + " FROM ranks GROUP BY sample_id), ordered AS (SELECT *, list_sort([" + ", ".join(f"{{'s': {x}, 'x': '{x}'}}" for x in LETTERS) + "]) AS o FROM sums), cons AS (SELECT *, array_to_string(list_transform(o, lambda q: q.x), '>') AS consensus_order, o[1].x AS top1 FROM ordered)"


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    return judging.ranks(table(spark, d, "judge_rankings"))


@query(RANKS + " SELECT judge, sample_id, rep, letters, valid FROM lettered")
def q_decode_rankings(spark, d):
    return judging.decoded(table(spark, d, "judge_rankings"))


@query(LONG + " SELECT judge, sample_id, letter, rank FROM long")
def q_rankings_long(spark, d):
    return judging.long_ranks(_ranks(spark, d))


@query(RANKS + " SELECT judge, sample_id, p[1] AS candidate_a, p[2] AS candidate_b, CASE WHEN list_extract(r, ascii(p[1]) - 64) < list_extract(r, ascii(p[2]) - 64) THEN p[1] ELSE p[2] END AS winner FROM (SELECT judge, sample_id, [A, B, C, D, E, F] AS r, unnest([" + ", ".join(f"'{a}{b}'" for a, b in PAIRS) + "]) AS p FROM ranks)")
def q_pairwise_judgments(spark, d):
    return judging.pair_judgements(_ranks(spark, d))


AGREEMENT = " SELECT x.judge AS model_a, y.judge AS model_b, round(sum(" + AGREE + f") / (count(*) * {len(PAIRS)}), 6) AS agreement, count(*) * {len(PAIRS)} AS n FROM {{t}} x JOIN {{t}} y ON x.sample_id = y.sample_id AND x.judge < y.judge GROUP BY ALL"


@query(RANKS + AGREEMENT.format(t="ranks"))
def q_pairwise_agreement(spark, d):
    return judging.pairwise_agreement(_ranks(spark, d))


@query(RANKS + ", kept AS (SELECT * FROM ranks WHERE NOT contains(judge, 'amber'))" + AGREEMENT.format(t="kept"))
def q_self_excluded_agreement(spark, d):
    """Agreement without the judges of the family that drafted the candidates."""
    return judging.pairwise_agreement(_ranks(spark, d).where(~F.col("judge").contains("amber")))


@query(CONSENSUS + " SELECT sample_id, consensus_order, top1, " + ", ".join(f"{x} AS rank_sum_{x}" for x in LETTERS) + " FROM cons")
def q_consensus_borda(spark, d):
    return judging.consensus(_ranks(spark, d))


@query(RANKS + " SELECT judge, sample_id, " + ", ".join(LETTERS) + " FROM ranks WHERE sample_id IN (SELECT sample_id FROM ranks GROUP BY sample_id HAVING count(*) >= 7)")
def q_judged_by_most(spark, d):
    return judging.judged_by_all(_ranks(spark, d), 7)


OWN = "array_to_string(list_transform(list_sort([" + ", ".join(f"{{'s': {x}, 'x': '{x}'}}" for x in LETTERS) + "]), lambda q: q.x), '>')"


@query(CONSENSUS + ", own AS (SELECT judge, sample_id, " + OWN + " AS own, " + ", ".join(LETTERS) + """ FROM ranks)
  SELECT judge, round(avg(CAST(own[1] = top1 AS INT)), 6) AS top1_match, round(avg(CAST(own = consensus_order AS INT)), 6) AS exact_match,
  round(sum(""" + " + ".join(f"CAST((own.{a} < own.{b}) = (instr(consensus_order, '{a}') < instr(consensus_order, '{b}')) AS INT)" for a, b in PAIRS) + f""") / (count(*) * {len(PAIRS)}), 6) AS pair_match,
  count(*) AS n_samples FROM own JOIN cons USING (sample_id) GROUP BY judge""")
def q_model_vs_consensus(spark, d):
    return judging.judge_vs_consensus(_ranks(spark, d))


@query(LONG + " SELECT judge, letter, count(*) AS n FROM long WHERE rank = 1 GROUP BY ALL")
def q_top1_by_judge(spark, d):
    return judging.long_ranks(_ranks(spark, d)).where("rank = 1").groupBy("judge", "letter").agg(F.count("*").alias("n"))


VARIANTS = """variants AS (SELECT DISTINCT sample_id, generation_round, upper(trim(v.id)) AS letter,
  regexp_replace(regexp_replace(lower(trim(v.feature_target)), '[ -]+', '_', 'g'), '^[a-f]_', '') AS feature_target, v.translation AS translation
  FROM (SELECT sample_id, generation_round, unnest(variants) AS v FROM ec_400_with_candidates))"""
MARKED = VARIANTS + ", marked AS (SELECT DISTINCT sample_id, letter FROM variants WHERE generation_round = 1 AND feature_target = 'baseline_balanced')"
ALIGNED = LONG + ", " + MARKED + """, byjudge AS (SELECT judge, count(*) AS n_samples, sum(CAST(rank = 1 AS INT))::BIGINT AS top1_count, round(avg(CAST(rank = 1 AS INT)), 6) AS top1_rate,
  round(avg(CAST(rank <= 2 AS INT)), 6) AS top2_rate, round(avg(rank), 6) AS mean_rank, round(1.0::DOUBLE / 6, 6) AS random_baseline
  FROM long JOIN marked USING (sample_id, letter) GROUP BY judge)"""


def _marked(spark, d):
    rows = records.variants(table(spark, d, "ec_400_with_candidates"), ["sample_id", "generation_round"])
    return rows.where("generation_round = 1 and feature_target = 'baseline_balanced'").select("sample_id", "letter").distinct()


@query(ALIGNED + " SELECT * FROM byjudge")
def q_reference_alignment(spark, d):
    """How judges place the balanced baseline rendering."""
    return judging.alignment(_ranks(spark, d), _marked(spark, d))


@query(ALIGNED + " SELECT count(*) AS n_judges, round(avg(top1_rate), 6) AS mean_top1_rate, round(avg(top2_rate), 6) AS mean_top2_rate, round(avg(mean_rank), 6) AS mean_mean_rank FROM byjudge")
def q_reference_alignment_set(spark, d):
    return judging.alignment_of_sets(judging.alignment(_ranks(spark, d), _marked(spark, d)))


MAJORITY = RANKS + ", maj AS (SELECT sample_id, count(*) AS n, " + ", ".join(f"sum(CAST({a} < {b} AS INT)) AS {a}{b}" for a, b in PAIRS) + " FROM ranks GROUP BY sample_id)"


def _beats(x: str) -> str:
    return " AND ".join(f"{x}{y} * 2 > n" if x < y else f"{y}{x} * 2 < n" for y in LETTERS if y != x)


@query(MAJORITY + " SELECT sample_id, CASE " + " ".join(f"WHEN {_beats(x)} THEN '{x}'" for x in LETTERS) + " END AS winner FROM maj")
def q_condorcet(spark, d):
    return judging.condorcet(_ranks(spark, d))


@query(MAJORITY + " SELECT sample_id, n AS n_judges, round((" + " + ".join(f"least({a}{b}, n - {a}{b}) / n" for a, b in PAIRS) + f") / {len(PAIRS)}, 6) AS disagreement FROM maj")
def q_high_disagreement(spark, d):
    return judging.disagreement(_ranks(spark, d))


@query(LONG + """, votes AS (SELECT sample_id, letter, count(*) AS c, min(judge) AS judge FROM long WHERE rank = 1 GROUP BY ALL),
  per AS (SELECT sample_id FROM votes GROUP BY sample_id HAVING count(*) = 2 AND sum(c) >= 3)
  SELECT judge, count(*) AS n_lone FROM votes JOIN per USING (sample_id) WHERE c = 1 GROUP BY judge""")
def q_minority_judge(spark, d):
    return judging.lone_dissent(_ranks(spark, d))


@query("WITH " + VARIANTS + """, r AS (SELECT DISTINCT sample_id, letter FROM variants),
  p AS (SELECT sample_id, letter, 'T' || row_number() OVER (PARTITION BY sample_id ORDER BY (sample_id * 7919 + ascii(letter) * 104729 + 42 * 131) % 1009, letter) AS label FROM r)
  SELECT sample_id, array_to_string(list_sort(list(label || '=' || letter)), ',') AS t_map, array_to_string(list_sort(list(letter || '=' || label)), ',') AS reverse_map FROM p GROUP BY sample_id""")
def q_blind_labels(spark, d):
    return judging.blind_labels(records.variants(table(spark, d, "ec_400_with_candidates"), ["sample_id", "generation_round"]))


@query(LONG + ", " + VARIANTS + """, feats AS (SELECT sample_id, letter, max(length(translation)) AS n FROM variants GROUP BY ALL)
  SELECT judge, count(*) AS n_top1, round(avg(n), 6) AS mean_chars FROM long JOIN feats USING (sample_id, letter) WHERE rank = 1 GROUP BY judge""")
def q_top1_features(spark, d):
    """Mean length of the candidates each judge ranks first."""
    feats = records.variants(table(spark, d, "ec_400_with_candidates"), ["sample_id", "generation_round"]).groupBy("sample_id", "letter").agg(F.max(F.length("translation")).alias("n"))
    top = judging.long_ranks(_ranks(spark, d)).where("rank = 1")
    return top.join(feats, ["sample_id", "letter"]).groupBy("judge").agg(F.count("*").alias("n_top1"), F.round(F.avg("n"), 6).alias("mean_chars"))


# ------------------------------------------------------------------ text

SPACE = T.SPACE
NORMAL = f"trim(regexp_replace(replace(replace(regexp_replace(text, '<[^>]+>', '', 'g'), '&nbsp;', ' '), '\\/', '/'), '{SPACE}+', ' ', 'g'))"


BLANKLESS = f"trim(regexp_replace({{c}}, '{SPACE.replace('{', '{{').replace('}', '}}')}+', ' ', 'g'))"


def _cnt(pattern: str, c: str = "text") -> str:
    return f"len(regexp_extract_all({c}, '{pattern}'))"


CJK_RE, WORD_RE = T.CJK, T.EN_WORD.replace("'", "''")


@query(f"SELECT doc_id, md5({NORMAL}) AS normal_hash, length({NORMAL}) AS normal_chars FROM documents")
def q_normalize_html(spark, d):
    docs = table(spark, d, "documents")
    normal = T.normalize_html(F.col("text"))
    return docs.select("doc_id", F.md5(normal).alias("normal_hash"), F.length(normal).alias("normal_chars"))


@query(f"SELECT doc_id, {_cnt(CJK_RE)} AS cjk, {_cnt(WORD_RE)} AS en_words, greatest({_cnt(T.TOKEN)}, 1) AS words, {_cnt('[。！？]')} AS marks FROM documents")
def q_text_counts(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.cjk_count(t).alias("cjk"), T.en_word_count(t).alias("en_words"), T.unicode_word_count(t).alias("words"), T.sentence_marks(t).alias("marks"))


@query(f"SELECT doc_id, round({_cnt(CJK_RE)} / greatest(length(text), 1), 6) AS cjk_ratio, round({_cnt('\\p{Nd}')} / greatest(length(text), 1), 6) AS digit_ratio FROM documents")
def q_text_ratios(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.round(T.ratio(T.cjk_count(t), t), 6).alias("cjk_ratio"), F.round(T.ratio(T.digit_count(t), t), 6).alias("digit_ratio"))


def _split(c: str, marks: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({c}, '{marks}'), lambda s: trim(regexp_replace(s, '{SPACE}+', ' ', 'g'))), lambda s: s <> '')"


@query(f"SELECT doc_id, greatest(len({_split('text', '[。！？!?；;]')}), 1) AS zh_pieces, greatest(len({_split('text', '[.!?;]+')}), 1) AS en_pieces FROM documents")
def q_sentences(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.size(T.zh_sentences(t)).alias("zh_pieces"), F.size(T.en_sentences(t)).alias("en_pieces"))


def _terms(terms: list[str], c: str = "text") -> str:
    return "(" + " + ".join(f"(length({c}) - length(replace({c}, '{t}', ''))) // {len(t)}" for t in terms) + ")"


@query(f"SELECT doc_id, {_terms(EN_TERMS)}::INT AS en_terms, {_terms(T.ZH_CONNECTIVES)}::INT AS zh_connectives FROM documents")
def q_term_counts(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.count_terms(t, EN_TERMS).alias("en_terms"), T.count_terms(t, T.ZH_CONNECTIVES).alias("zh_connectives"))


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


@query(f"""WITH s AS (SELECT doc_id, lower(text) AS low, regexp_extract_all(lower(text), '{WORD_RE}') AS w, regexp_extract_all(lower(text), '{T.TOKEN}') AS u, {_split('text', '[.!?;]+')} AS p0, text FROM documents WHERE lower(lang) = 'en'),
  p AS (SELECT *, CASE WHEN len(p0) > 0 THEN p0 ELSE [text] END AS p, greatest(len(w), 1) AS n FROM s)
  SELECT doc_id, round(len(list_filter(u, lambda x: x = 'of')) / n, 6) AS function_word_density, round(len(list_filter(w, lambda x: x IN {_in(T.EN_PASSIVE)})) / n * 100, 6) AS passive_density,
  round(len(list_filter(p, lambda x: regexp_extract(lower(x), '{WORD_RE}') IN {_in(T.EN_PRONOUNS)})) / len(p), 6) AS pronoun_subject_ratio,
  round(len(list_filter(w, lambda x: x IN {_in(T.EN_CONNECTIVES)})) / n * 100, 6) AS connective_density, round(len(list_filter(u, lambda x: regexp_matches(x, '{T.EN_NOMINAL}'))) / n * 100, 6) AS nominal_density, round(n / len(p), 6) AS avg_sentence_length FROM p""")
def q_translationese_en(spark, d):
    docs = table(spark, d, "documents").where(F.lower("lang") == "en")
    return docs.select("doc_id", *[v.alias(k) for k, v in T.style_en(F.col("text")).items()])


@query(f"""WITH s AS (SELECT doc_id, text, {_split('text', '[。！？!?；;]')} AS p0, greatest({_cnt(CJK_RE)}, 1) AS n FROM documents WHERE lower(lang) = 'zh'),
  p AS (SELECT *, CASE WHEN len(p0) > 0 THEN p0 ELSE [text] END AS p FROM s)
  SELECT doc_id, round({_terms(['的'])} / n, 6) AS function_word_density, round({_terms(['被'])} / n * 100, 6) AS passive_density,
  round(len(list_filter(p, lambda x: regexp_matches(x, '^({'|'.join(T.ZH_PRONOUNS)})'))) / len(p), 6) AS pronoun_subject_ratio, round({_terms(T.ZH_CONNECTIVES)} / n * 100, 6) AS connective_density,
  round({_terms(T.ZH_NOMINAL)} / n * 100, 6) AS nominal_density, round(n / len(p), 6) AS avg_sentence_length FROM p""")
def q_translationese_zh(spark, d):
    docs = table(spark, d, "documents").where(F.lower("lang") == "zh")
    return docs.select("doc_id", *[v.alias(k) for k, v in T.style_zh(F.col("text")).items()])


@query(f"SELECT doc_id, (lower(lang) IS NOT DISTINCT FROM 'zh' AND {_cnt(CJK_RE)} > 0) OR regexp_full_match(text, '[\\x00-\\x7F]*', 's') AS repaired FROM documents WHERE text IS NOT NULL")
def q_repair_mojibake(spark, d):
    """UTF-8 texts read as Latin-1 on purpose: the Chinese ones come back; others only if they are the same in both."""
    docs = table(spark, d, "documents").where("text is not null")
    garbled = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return docs.select("doc_id", (T.repair_mojibake(garbled, F.coalesce(F.lower("lang"), F.lit("en"))) == F.col("text")).alias("repaired"))


@query("SELECT id, coalesce(CASE WHEN trim(human_translation) <> '' THEN human_translation END, CASE WHEN trim(source_text) <> '' THEN source_text END) AS body FROM base_samples")
def q_first_nonblank(spark, d):
    return table(spark, d, "base_samples").select("id", T.first_filled(F.col("human_translation"), F.col("source_text")).alias("body"))


@query(f"SELECT doc_id FROM documents WHERE (lower(lang) = 'zh' AND {_cnt(CJK_RE)} >= 10) OR (lower(lang) = 'en' AND {_cnt('[^ \\n]+')} >= 8)")
def q_language_length(spark, d):
    long_enough = ((F.lower("lang") == "zh") & (T.cjk_count(F.col("text")) >= 10)) | ((F.lower("lang") == "en") & (F.regexp_count("text", F.lit("[^ \\n]+")) >= 8))
    return table(spark, d, "documents").where(long_enough).select("doc_id")


@query("""SELECT event_id, CASE WHEN json_valid(props) THEN json_extract_string(props, '$.k') END AS k, coalesce(json_valid(props), false) AS valid FROM events""")
def q_json_extract(spark, d):
    ev = table(spark, d, "events")
    return ev.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.coalesce(F.try_parse_json("props").isNotNull(), F.lit(False)).alias("valid"))


@query("SELECT sample_id, judge, rep, to_json(map_from_entries(list_sort(map_entries(t_map))))::VARCHAR AS t_json FROM (SELECT DISTINCT sample_id, judge, rep, t_map FROM judge_rankings)")
def q_map_json(spark, d):
    rows = table(spark, d, "judge_rankings").select("sample_id", "judge", "rep", T.sorted_map_json(F.col("t_map")).alias("t_json"))
    return rows.distinct()


# ------------------------------------------------------------------ screening

HARD = "|".join(screening.HARD_NOISE)
SOFT = " + ".join(f"CAST(regexp_matches(text, '{p}') AS INT)" for p in screening.SOFT_NOISE)
REASON = f"""CASE WHEN text IS NULL OR length(text) < 220 OR length(text) > 650 THEN 'length'
  WHEN regexp_matches(text, '{HARD}') THEN 'hard_noise'
  WHEN {_cnt(CJK_RE)} / greatest(length(text), 1) < 0.58 THEN 'cjk_ratio'
  WHEN {_cnt('\\p{Nd}')} / greatest(length(text), 1) > 0.22 THEN 'digit_ratio'
  WHEN {_cnt('[。！？]')} < 3 THEN 'sentence_count'
  WHEN {_terms(['：'])} > 8 OR {_terms(['【'])} > 4 THEN 'punctuation_noise'
  WHEN {SOFT} >= 2 AND ({_terms(['股'])} > 6 OR {_terms(['涨'])} > 6) THEN 'stock_ticker_noise'
  WHEN {_terms(['。'])} > 0 AND length(text) / greatest({_terms(['。'])}, 1) < 35 THEN 'fragmented' END"""


ZH = "lower(lang) = 'zh'"


def _screened(spark, d):
    """The Chinese documents and why each would be rejected."""
    return table(spark, d, "documents").where(ZH).withColumn("reason", screening.reject_reason(F.col("text"), RULES))


@query(f"SELECT doc_id, {REASON} AS reason FROM documents WHERE {ZH}")
def q_reject_reason(spark, d):
    return _screened(spark, d).select("doc_id", "reason")


@query(f"SELECT coalesce({REASON}, 'accepted') AS reason, count(*) AS n FROM documents WHERE {ZH} GROUP BY ALL")
def q_reject_counts(spark, d):
    return _screened(spark, d).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"SELECT count(*) AS scanned, count(*) FILTER (WHERE {REASON} IS NULL) AS accepted, count(*) FILTER (WHERE {REASON} IS NOT NULL) AS rejected FROM documents WHERE {ZH}")
def q_pipeline_counters(spark, d):
    return screening.counters(table(spark, d, "documents").where(ZH), screening.reject_reason(F.col("text"), RULES))


@query(f"SELECT doc_id FROM documents WHERE length(text) BETWEEN 180 AND 800 AND NOT regexp_matches(text, '{'|'.join(screening.EXCLUDED_TERMS)}') AND {_cnt(CJK_RE)} / greatest(length(text), 1) >= 0.5 AND {_cnt('\\p{Nd}')} / greatest(length(text), 1) <= 0.35 AND {_cnt('[。！？]')} >= 2")
def q_coarse_eligible(spark, d):
    return table(spark, d, "documents").where(screening.coarse_eligible(F.col("text"))).select("doc_id")


KEY = "left(regexp_replace(text, '[^\\p{L}\\p{N}_]+', '', 'g'), 160)"


@query(f"SELECT min(doc_id) AS doc_id, {KEY} AS dedupe_key FROM documents GROUP BY 2")
def q_dedupe_prefix(spark, d):
    return screening.first_per_key(table(spark, d, "documents").select("doc_id", "text"), T.dedupe_key(F.col("text")), ["doc_id"]).select("doc_id", "dedupe_key")


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS text_hash FROM documents GROUP BY 2")
def q_dedupe_hash(spark, d):
    return screening.first_per_key(table(spark, d, "documents").select("doc_id", "text"), T.text_hash(F.col("text")), ["doc_id"]).select("doc_id", F.col("dedupe_key").alias("text_hash"))


@query(f"WITH a AS (SELECT doc_id FROM documents WHERE {ZH} AND {REASON} IS NULL ORDER BY doc_id LIMIT 400) SELECT doc_id, printf('DOC_%06d', row_number() OVER (ORDER BY doc_id)) AS serial_id FROM a")
def q_accept_until_target(spark, d):
    """The first 400 acceptable documents; the target is the feature."""
    return screening.accept_until(_screened(spark, d), F.col("reason").isNull(), "doc_id", 400).select("doc_id", "serial_id")


@query("SELECT id FROM base_samples WHERE CAST(substr(id, 3) AS BIGINT) NOT IN (SELECT sample_id FROM ec_400_with_candidates WHERE sample_id IS NOT NULL AND generation_round = 2)")
def q_checkpoint_resume(spark, d):
    """Samples that the second generation round hasn't delivered yet."""
    done = table(spark, d, "ec_400_with_candidates").where("generation_round = 2").select("sample_id")
    base = table(spark, d, "base_samples").withColumn("sample_id", F.substring("id", 3, 8).cast("bigint"))
    return screening.not_done(base, done, ["sample_id"]).select("id")


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_no, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS batch_no FROM documents")
def q_numbered_batches(spark, d):
    got = screening.numbered(table(spark, d, "documents").select("doc_id"), ["doc_id"])
    return got.select("doc_id", "row_no", F.floor(F.col("row_no") / 64).alias("batch_no"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents) WHERE r >= 100 AND r < 350")
def q_range_slice(spark, d):
    """Rows 100 to 349 in id order; the slice is the feature."""
    return screening.numbered(table(spark, d, "documents").select("doc_id"), ["doc_id"]).where("row_no >= 100 and row_no < 350").select("doc_id")


@query("SELECT source || '|' || printf('%04d', doc_id) AS k, printf('%04d', doc_id) || '|' || source || '|' || sha256(text) AS record_key FROM documents WHERE doc_id < 10000 UNION ALL SELECT source || '|' || left(doc_id::VARCHAR, 4) AS k, left(doc_id::VARCHAR, 4) || '|' || source || '|' || sha256(text) FROM documents WHERE doc_id >= 10000")
def q_record_keys(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(F.concat_ws("|", "source", T.padded(F.col("doc_id"), 4)).alias("k"), T.record_key(F.col("doc_id"), F.col("source"), F.col("text")).alias("record_key"))


# ------------------------------------------------------------------ features and inference

FEATURES = inference.FEATURES
OBS = """clean AS (SELECT obs_id, lower(trim(model)) AS model, CAST(trim(sample_id) AS BIGINT) AS sample_id, lower(trim(candidate_a)) AS candidate_a, lower(trim(candidate_b)) AS candidate_b,
  coalesce(CASE WHEN lower(trim(winner)) <> '' THEN lower(trim(winner)) END, lower(trim(ranking[1]))) AS w, """ + ", ".join(f"round({f}, 6) + 0.0::DOUBLE AS {f}" for f in FEATURES) + """ FROM pairwise_observations),
obs AS (SELECT DISTINCT obs_id, model, sample_id, candidate_a, candidate_b, CASE WHEN w = candidate_a THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label, """ + ", ".join(FEATURES) + """ FROM clean
  WHERE candidate_a <> candidate_b AND w IN (candidate_a, candidate_b) AND obs_id IS NOT NULL AND model IS NOT NULL AND sample_id IS NOT NULL AND """ + " AND ".join(f"{f} IS NOT NULL" for f in FEATURES) + ")"


def _obs(spark, d):
    return inference.observations(table(spark, d, "pairwise_observations"))


@query("WITH " + OBS + " SELECT * FROM obs")
def q_observations(spark, d):
    return _obs(spark, d)


STATS = ", stats AS (SELECT model, " + ", ".join(f"avg({f}) AS m_{f}, CASE WHEN stddev_pop({f}) = 0 THEN 1.0 ELSE stddev_pop({f}) END AS s_{f}" for f in FEATURES) + " FROM obs GROUP BY model), std AS (SELECT obs_id, obs.model AS model, sample_id, label, " + ", ".join(f"({f} - m_{f}) / s_{f} AS {f}" for f in FEATURES) + " FROM obs JOIN stats USING (model))"


@query("WITH " + OBS + STATS + " SELECT obs_id, model, " + ", ".join(f"round({f}, 6) AS {f}" for f in FEATURES) + " FROM std")
def q_standardize(spark, d):
    return inference.standardised(_obs(spark, d)).select("obs_id", "model", *[F.round(f, 6).alias(f) for f in FEATURES])


@query("WITH " + OBS + " SELECT model, " + ", ".join(f"round(sum({FEATURES[i]} * {FEATURES[j]}), 4) AS g_{i}_{j}" for i in range(4) for j in range(i, 4)) + " FROM obs GROUP BY model")
def q_gram_matrix(spark, d):
    got = inference.gram(_obs(spark, d), ["model"], FEATURES)
    return got.select("model", *[F.round(c, 4).alias(c) for c in got.columns if c != "model"])


@query("WITH " + OBS + " SELECT model, sample_id, round(sum(label - 0.5), 6) AS s0, " + ", ".join(f"round(sum((label - 0.5) * {f}), 6) AS s{i + 1}" for i, f in enumerate(FEATURES)) + " FROM obs GROUP BY ALL")
def q_cluster_scores(spark, d):
    """Score sums per sample at the zero model."""
    rows = inference._design(_obs(spark, d), FEATURES).withColumn("p", F.lit(0.5))
    got = inference.cluster_scores(rows, len(FEATURES) + 1)
    return got.select("model", "sample_id", *[F.round(f"s{i}", 6).alias(f"s{i}") for i in range(len(FEATURES) + 1)])


def _fitted(spark, d):
    obs = cut(inference.standardised(_obs(spark, d)))
    return inference.cluster_robust(obs, inference.fit_logistic(obs))


@query()
def q_logistic_robust(spark, d):
    return _fitted(spark, d)


@query()
def q_significance_summary(spark, d):
    return inference.significant_features(_fitted(spark, d))


@query()
def q_univariate_robust(spark, d):
    return inference.univariate(inference.standardised(_obs(spark, d)))


SIGNS = ", signs AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, model, avg((2 * label - 1) * {f}) AS c, coalesce(abs(avg((2 * label - 1) * {f})) * sqrt(count(*)) > 1.96 * stddev_pop((2 * label - 1) * {f}), false) AS sig FROM obs GROUP BY model" for f in FEATURES
) + "), per AS (SELECT feature, sum(CAST(sig AS INT))::BIGINT AS n_significant, count(*) AS n_models, sum(CAST(sig AND c > 0 AS INT))::BIGINT AS n_positive, sum(CAST(sig AND c < 0 AS INT))::BIGINT AS n_negative FROM signs GROUP BY feature)"


@query("WITH " + OBS + SIGNS + """ SELECT feature, CASE WHEN n_significant = n_models AND greatest(n_positive, n_negative) = n_models THEN 'no_exception'
  WHEN n_significant >= ceil(n_models * 0.625) AND greatest(n_positive, n_negative) >= ceil(n_models * 0.75) THEN 'mostly_supported_with_exceptions' ELSE 'no_stable_evidence' END AS tier,
  CASE WHEN n_positive >= n_negative THEN 'positive' ELSE 'negative' END AS dominant_sign, n_significant, n_models, n_positive, n_negative FROM per""")
def q_stability_tiers(spark, d):
    """Tiers over the judges of the sign test of each feature's signed mean."""
    obs = _obs(spark, d)
    long = obs.unpivot(["model", "label"], FEATURES, "feature", "x").withColumn("x", (2 * F.col("label") - 1) * F.col("x"))
    signs = long.groupBy("feature", "model").agg(F.avg("x").alias("coefficient"), F.stddev_pop("x").alias("s"), F.count("*").alias("n"))
    return inference.tiers(signs.withColumn("significant", F.coalesce(F.abs("coefficient") * F.sqrt("n") > 1.96 * F.col("s"), F.lit(False))))


DOC_FEATURES = {"n_chars": "n_chars", "en_words": "en_words", "digits": "digits"}
FEATS = f"feats AS (SELECT doc_id, lower(lang) AS language, category, n_chars::DOUBLE AS n_chars, {_cnt(WORD_RE)}::DOUBLE AS en_words, {_cnt('[0-9]')}::DOUBLE AS digits FROM documents WHERE lang IS NOT NULL), melted AS (" + " UNION ALL ".join(f"SELECT doc_id, language, category, '{f}' AS feature, {f} AS value FROM feats" for f in DOC_FEATURES) + ")"
BASE = FEATS + ", base AS (SELECT language, feature, count(*) AS n, round(avg(value), 9) AS mean, round(CASE WHEN stddev_pop(value) = 0 THEN 1.0 ELSE stddev_pop(value) END, 9) AS std, round(quantile_cont(value, 0.05), 9) AS p05, round(quantile_cont(value, 0.5), 9) AS median, round(quantile_cont(value, 0.95), 9) AS p95, round(min(value), 9) AS min, round(max(value), 9) AS max FROM melted GROUP BY ALL)"


def _doc_features(spark, d):
    t = F.col("text")
    docs = table(spark, d, "documents").where("lang is not null")
    return docs.select("doc_id", F.lower("lang").alias("language"), "category", "n_chars", T.en_word_count(t).alias("en_words"), F.regexp_count(t, F.lit("[0-9]")).alias("digits"))


@query("WITH " + BASE + " SELECT language, feature, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("mean", "std", "p05", "median", "p95", "min", "max")) + " FROM base")
def q_distribution_summary(spark, d):
    got = distribution.summary(_doc_features(spark, d), ["language"], list(DOC_FEATURES))
    return got.select("language", "feature", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "p05", "median", "p95", "min", "max")])


def _scored(spark, d):
    f = _doc_features(spark, d)
    return distribution.z_scores(f, ["doc_id", "category"], list(DOC_FEATURES), distribution.summary(f, ["language"], list(DOC_FEATURES)), "language")


@query("WITH " + BASE + " SELECT doc_id, language, feature, value, round((value - mean) / std, 4) AS z FROM melted JOIN base USING (language, feature)")
def q_native_zscore(spark, d):
    return _scored(spark, d).select("doc_id", "language", "feature", "value", F.round("z", 4).alias("z"))


@query("WITH " + BASE + ", scored AS (SELECT category, feature, value, round((value - mean) / std, 9) AS z FROM melted JOIN base USING (language, feature)) SELECT category, feature, count(*) AS n, round(avg(value), 4) AS mean, round(CASE WHEN stddev_pop(value) = 0 THEN 1.0 ELSE stddev_pop(value) END, 4) AS std, round(avg(z), 4) AS mean_z FROM scored GROUP BY ALL")
def q_zscore_summary(spark, d):
    got = distribution.z_summary(_scored(spark, d), ["category"])
    return got.select("category", "feature", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "mean_z")])


@query("WITH " + VARIANTS + ", a AS (SELECT sample_id, letter, max(length(translation)) AS chars FROM variants GROUP BY ALL), b AS (SELECT sample_id, letter, max(len(regexp_extract_all(translation, '[。！？]'))) AS marks FROM variants GROUP BY ALL) SELECT a.sample_id AS sample_id, a.letter AS letter, chars, marks FROM a JOIN b USING (sample_id, letter) WHERE chars IS NOT NULL")
def q_feature_merge(spark, d):
    """Two feature families of the candidates, inner-joined on sample and letter."""
    rows = records.variants(table(spark, d, "ec_400_with_candidates"), ["sample_id", "generation_round"])
    chars = rows.groupBy("sample_id", "letter").agg(F.max(F.length("translation")).alias("chars"))
    marks = rows.groupBy("sample_id", "letter").agg(F.max(T.sentence_marks(F.col("translation"))).alias("marks"))
    return chars.join(marks, ["sample_id", "letter"]).where("chars is not null")


# ------------------------------------------------------------------ syntax

REL = ["root", "nsubj", "obj", "amod", "advmod", "conj", "cc", "acl:relcl", "nsubj:pass", "nmod", "case", "det"]
TAG = ["NOUN", "VERB", "ADJ", "PUNCT", "PROPN", "PART", "ADV", "NUM", "PRON"]
WORDS = f"words AS (SELECT doc_id, regexp_extract_all(text, '{WORD_RE}') AS w FROM documents WHERE lower(lang) = 'en'), tok AS (SELECT doc_id, unnest(w) AS text, generate_subscripts(w, 1) AS id FROM words), tree AS (SELECT doc_id, id, text, ((id * 7919) % 101 + doc_id) % id AS head, CASE ((id * 31 + doc_id) % {len(REL)}) " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(REL)) + f" END AS deprel, CASE ((id * 17 + doc_id) % {len(TAG)}) " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(TAG)) + " END AS upos FROM tok)"


def _tokens(spark, d):
    """A made-up parse of each English text, by arithmetic: a parser is not part of this repository."""
    docs = table(spark, d, "documents").where(F.lower("lang") == "en").select("doc_id", T.en_word_list(F.col("text")).alias("w")).where(F.size("w") > 0)
    doc = F.col("doc_id")

    def token(x, i):
        n = (i + 1).cast("bigint")
        pick = lambda values, k: F.get(F.array(*[F.lit(v) for v in values]), F.pmod(n * k + doc, F.lit(len(values))).cast("int"))
        return F.struct(n.cast("int").alias("id"), F.pmod(F.pmod(n * 7919, F.lit(101)) + doc, n).cast("int").alias("head"), pick(REL, 31).alias("deprel"), pick(TAG, 17).alias("upos"), x.alias("text"))

    return docs.select("doc_id", F.transform("w", token).alias("tokens"))


@query("WITH " + WORDS + ", dist AS (SELECT doc_id, count(*) AS n, avg(CASE WHEN head <> 0 THEN abs(id - head) END) AS m, max(CASE WHEN head <> 0 THEN abs(id - head) END) AS x FROM tree GROUP BY doc_id) SELECT doc_id, round(coalesce(m, 0), 6) AS mean_distance, coalesce(x, 0)::DOUBLE AS max_distance, round(coalesce(m, 0) / greatest(n - 1, 1), 6) AS normalised_distance FROM dist")
def q_dependency_distance(spark, d):
    return _tokens(spark, d).select("doc_id", *[v.alias(k) for k, v in syntax.distance_stats(F.col("tokens"), F.lit(1)).items()])


@query("WITH RECURSIVE " + WORDS + ", walk AS (SELECT doc_id, id, 0 AS depth FROM tree WHERE head = 0 UNION ALL SELECT t.doc_id, t.id, w.depth + 1 FROM walk w JOIN tree t ON t.doc_id = w.doc_id AND t.head = w.id) SELECT doc_id, max(depth) AS depth FROM walk GROUP BY doc_id")
def q_tree_depth(spark, d):
    return _tokens(spark, d).select("doc_id", syntax.tree_depth(F.transform("tokens", lambda t: t["head"])).alias("depth"))


@query("WITH " + WORDS + f""", f AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE deprel IN {_in(syntax.EN_CLAUSE)}) AS clauses, greatest(count(*) FILTER (WHERE upos IN {_in(syntax.CONTENT)}), 1) AS content,
  count(*) FILTER (WHERE upos IN ('NOUN', 'PROPN')) AS nouns, count(*) FILTER (WHERE upos IN ('NOUN', 'ADJ') AND regexp_matches(lower(text), '{syntax.EN_SUFFIX}')) AS suffix, count(*) FILTER (WHERE lower(text) = 'of') AS ofs,
  count(*) FILTER (WHERE deprel IN {_in(syntax.EN_MODIFIER)}) AS modifiers, count(*) FILTER (WHERE deprel IN ('cc', 'conj')) + count(*) FILTER (WHERE lower(text) IN ('and', 'or', 'but', 'nor')) AS coord, count(*) FILTER (WHERE contains(deprel, 'pass')) AS passive FROM tree GROUP BY doc_id)
  SELECT doc_id, greatest(clauses, 1)::DOUBLE AS clause_count, round((nouns + 0.7::DOUBLE * suffix + 0.35::DOUBLE * ofs) / content, 6) AS nominalisation_ratio, round(modifiers / n, 6) AS modifier_density, coord::DOUBLE AS coordination_count, passive::DOUBLE AS passive_count, n::DOUBLE AS token_count, round(n / 1, 6) AS avg_sentence_length FROM f""")
def q_syntax_features(spark, d):
    return _tokens(spark, d).select("doc_id", *[v.alias(k) for k, v in syntax.features_en(F.col("tokens"), F.lit(1)).items()])


# ------------------------------------------------------------------ sampling, lookups, sets

SPANS = "spans AS (SELECT id, source_book AS book, source_segment_start AS s, source_segment_end AS e, difficulty, domain_subtype FROM base_samples)"


def _spans(spark, d):
    return table(spark, d, "base_samples").select("id", F.col("source_book").alias("book"), F.col("source_segment_start").alias("s"), F.col("source_segment_end").alias("e"), "difficulty", "domain_subtype")


@query("WITH " + SPANS + " SELECT a.id AS left_id, b.id AS right_id FROM spans a JOIN spans b ON a.book = b.book AND a.s <= b.e AND b.s <= a.e WHERE a.s <= a.e AND b.s <= b.e AND a.id < b.id")
def q_span_overlap(spark, d):
    """Pairs of samples whose spans of one book meet."""
    s = _spans(spark, d)
    return sampling.overlapping(s, s, "book", "s", "e").where("left_id < right_id")


@query("WITH " + SPANS + " SELECT DISTINCT a.id AS id FROM spans a WHERE NOT EXISTS (SELECT 1 FROM spans b WHERE a.book = b.book AND a.s = b.s AND a.e = b.e AND b.difficulty = 'hard')")
def q_composite_anti_join(spark, d):
    s = _spans(spark, d)
    return s.join(s.where("difficulty = 'hard'").select("book", "s", "e"), ["book", "s", "e"], "left_anti").select("id").distinct()


@query("WITH " + SPANS + ", free AS (SELECT * FROM spans a WHERE NOT EXISTS (SELECT 1 FROM spans b WHERE b.difficulty = 'hard' AND a.book = b.book AND a.s <= b.e AND b.s <= a.e AND a.s <= a.e AND b.s <= b.e)), r AS (SELECT *, row_number() OVER (PARTITION BY domain_subtype, difficulty ORDER BY (CAST(substr(id, 3) AS BIGINT) * 7919) % 1009, id) AS place FROM free) SELECT id, domain_subtype, difficulty, place FROM r WHERE place <= 8")
def q_stratified_quota(spark, d):
    """Eight samples of each stratum in a fixed hash order, none of which meets a span used by the hard ones."""
    s = _spans(spark, d)
    used = sampling.overlapping(s, s.where("difficulty = 'hard'"), "book", "s", "e").select(F.col("left_id").alias("id"))
    order = F.pmod(F.substring("id", 3, 8).cast("bigint") * 7919, F.lit(1009))
    return sampling.stratified(s.join(used, "id", "left_anti"), ["domain_subtype", "difficulty"], 8, order).select("id", "domain_subtype", "difficulty", "place")


@query("WITH RECURSIVE " + SPANS + """, o AS (SELECT *, row_number() OVER (ORDER BY (CAST(substr(id, 3) AS BIGINT) * 7919) % 1009, id) AS n FROM spans),
  greedy AS (SELECT 0::BIGINT AS n, [{'id': '', 'book': '', 's': 0, 'e': -1}] AS taken
    UNION ALL SELECT o.n, CASE WHEN len(list_filter(taken, lambda x: x.book = o.book AND x.s <= o.e AND o.s <= x.e AND x.s <= x.e AND o.s <= o.e)) = 0 THEN list_append(taken, {'id': o.id, 'book': o.book, 's': o.s, 'e': o.e}) ELSE taken END
    FROM greedy JOIN o ON o.n = greedy.n + 1)
  SELECT x.id AS id, x.book AS book, x.s AS s, x.e AS e FROM (SELECT unnest(taken) AS x FROM (SELECT taken FROM greedy ORDER BY n DESC LIMIT 1)) WHERE x.id <> ''""")
def q_disjoint_sample(spark, d):
    """The samples a greedy pass in a seeded order takes so that no two spans of a book overlap."""
    order = F.pmod(F.substring("id", 3, 8).cast("bigint") * 7919, F.lit(1009))
    return sampling.disjoint_first(_spans(spark, d).dropDuplicates(["id"]), order, "book", "s", "e").select("id", "book", "s", "e")


@query("WITH " + VARIANTS + ", w AS (SELECT sample_id, generation_round, list_transform(variants, lambda v: upper(trim(v.id))) AS ids, list_transform(list_filter(variants, lambda v: coalesce(" + BLANKLESS.format(c="v.translation") + ", '') = ''), lambda v: v.id) AS blank FROM ec_400_with_candidates) SELECT DISTINCT sample_id, generation_round, array_to_string(list_sort(list_filter(['A','B','C','D','E','F'], lambda x: NOT list_contains(ids, x))), ',') AS missing, array_to_string(list_sort(list_filter(ids, lambda x: NOT list_contains(['A','B','C','D','E','F'], x))), ',') AS extra, array_to_string(list_sort(blank), ',') AS blank FROM w")
def q_variant_validation(spark, d):
    return records.variant_errors(table(spark, d, "ec_400_with_candidates"), ["sample_id", "generation_round"])


@query("WITH " + VARIANTS + ", r AS (SELECT *, min(letter) OVER (PARTITION BY sample_id, generation_round, t) AS f FROM (SELECT *, " + BLANKLESS.format(c="translation") + " AS t FROM variants)) SELECT sample_id, generation_round, letter, CASE WHEN coalesce(t, '') = '' THEN 'blank' ELSE 'repeated' END AS issue FROM r WHERE coalesce(t, '') = '' OR f < letter")
def q_issue_rows(spark, d):
    return records.repeated_fields(table(spark, d, "ec_400_with_candidates"), ["sample_id", "generation_round"])


@query("WITH " + VARIANTS + " SELECT sample_id, generation_round, letter, feature_target, length(translation) AS chars FROM variants")
def q_candidate_explode(spark, d):
    rows = records.variants(table(spark, d, "ec_400_with_candidates"), ["sample_id", "generation_round"])
    return rows.select("sample_id", "generation_round", "letter", "feature_target", F.length("translation").alias("chars"))


@query("SELECT doc_id FROM documents WHERE contains(lower(concat_ws(chr(10), text, source, category)), 'central bank')")
def q_search(spark, d):
    return records.search(table(spark, d, "documents"), ["text", "source", "category"], "Central Bank").select("doc_id")


@query("WITH r AS (SELECT DISTINCT sample_id, generation_round, source_text FROM ec_400_with_candidates) SELECT a.sample_id AS sample_id, a.source_text IS DISTINCT FROM b.source_text AS dirty FROM r a JOIN r b ON a.sample_id = b.sample_id WHERE a.generation_round = 1 AND b.generation_round = 2")
def q_dirty_check(spark, d):
    r = table(spark, d, "ec_400_with_candidates").select("sample_id", "generation_round", "source_text").distinct()
    a, b = r.where("generation_round = 1"), r.where("generation_round = 2").select("sample_id", F.col("source_text").alias("later"))
    return a.join(b, "sample_id").select("sample_id", (~F.col("source_text").eqNullSafe(F.col("later"))).alias("dirty"))


@query("""WITH base AS (SELECT CAST(substr(id, 3) AS BIGINT) AS sample_id, source_text AS text FROM base_samples), later AS (SELECT sample_id, max(source_text) AS text FROM ec_400_with_candidates WHERE generation_round = 2 GROUP BY sample_id)
  SELECT coalesce(l.sample_id, b.sample_id) AS sample_id, CASE WHEN l.sample_id IS NOT NULL THEN l.text ELSE b.text END AS text FROM base b FULL JOIN later l USING (sample_id)""")
def q_override_merge(spark, d):
    base = table(spark, d, "base_samples").select(F.substring("id", 3, 8).cast("bigint").alias("sample_id"), F.col("source_text").alias("text"))
    later = table(spark, d, "ec_400_with_candidates").where("generation_round = 2").groupBy("sample_id").agg(F.max("source_text").alias("text"))
    return records.override(base, later, "sample_id")


@query("SELECT DISTINCT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def q_strict_lookup(spark, d):
    """Orders with their customer's name; an order of an unknown customer stops the query."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return records.strict_lookup(table(spark, d, "orders").select("o_orderkey", "o_custkey"), c, "o_custkey").select("o_orderkey", "c_name")


@query("SELECT id FROM base_samples WHERE CAST(substr(id, 3) AS BIGINT) IN (SELECT sample_id FROM judge_rankings)")
def q_semi_join(spark, d):
    base = table(spark, d, "base_samples").withColumn("sample_id", F.substring("id", 3, 8).cast("bigint"))
    return base.join(table(spark, d, "judge_rankings").select("sample_id"), "sample_id", "left_semi").select("id")


@query("SELECT DISTINCT judge, sample_id, rep, coalesce(list_sort(map_keys(t_map))[1], NULL) AS first_label, list_sort(list_filter(map_keys(t_map), lambda k: t_map[k] = 'A'))[1] AS label_of_a FROM judge_rankings")
def q_map_lookup(spark, d):
    rows = table(spark, d, "judge_rankings")
    return rows.select("judge", "sample_id", "rep", F.array_min(F.map_keys("t_map")).alias("first_label"), records.key_of(F.col("t_map"), F.lit("A")).alias("label_of_a")).distinct()


@query("WITH a AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier), b AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS r FROM customer) SELECT s_suppkey, c_custkey FROM a JOIN b USING (r)")
def q_positional_join(spark, d):
    a = screening.numbered(table(spark, d, "supplier").select("s_suppkey"), ["s_suppkey"])
    b = screening.numbered(table(spark, d, "customer").select("c_custkey"), ["c_custkey"])
    return a.join(b, "row_no").select("s_suppkey", "c_custkey")


@query("SELECT c_custkey AS k, 'both' AS kind FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, 'idle' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def q_set_ops(spark, d):
    c, o = table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return c.intersect(o).withColumn("kind", F.lit("both")).union(c.subtract(o).withColumn("kind", F.lit("idle")))


@query("SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def q_union_by_name(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("key"))
    return c.unionByName(s, allowMissingColumns=True)


@query("SELECT category, count(*) AS n FROM documents GROUP BY ALL ORDER BY n DESC, min(doc_id) LIMIT 30")
def q_most_common(spark, d):
    """The thirty most frequent categories, ties in order of first appearance; the limit is the feature."""
    got = table(spark, d, "documents").groupBy("category").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return got.orderBy(F.desc("n"), "first").limit(30).select("category", "n")


@query("SELECT source, doc_id, lag(doc_id) OVER w AS before, lead(doc_id) OVER w AS after FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)")
def q_row_navigation(spark, d):
    """Neighbours by row number in the order of source and id, so that no task holds a whole source."""
    rows = screening.numbered(table(spark, d, "documents").select("source", "doc_id"), ["source", "doc_id"])
    side = lambda step, name: rows.select((F.col("row_no") + step).alias("row_no"), F.col("source").alias(f"s_{name}"), F.col("doc_id").alias(name))
    both = rows.join(side(1, "before"), "row_no", "left").join(side(-1, "after"), "row_no", "left")
    near = lambda name: F.when(F.col(f"s_{name}").eqNullSafe(F.col("source")), F.col(name)).alias(name)
    return both.select("source", "doc_id", near("before"), near("after"))


DIM = 64


@query(f"""WITH long AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM long GROUP BY ALL)
  SELECT vec_id, round(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 6) AS cosine FROM long JOIN c USING (label, i) GROUP BY vec_id""")
def q_embedding_cosine(spark, d):
    """Cosine of each vector and the mean vector of its label."""
    e = table(spark, d, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    c = e.groupBy("label").agg(F.array(*[F.avg(F.get("v", F.lit(i))) for i in range(DIM)]).alias("m"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cosine = dot("v", "m") / (F.sqrt(dot("v", "v")) * F.sqrt(dot("m", "m")))
    return e.join(c, "label").select("vec_id", F.round(cosine, 6).alias("cosine"))


NAMES = ["datasets/a.with_candidates.json", "rankings/ranked.x.json", "out/five_models.pairwise_agreement.csv", "out/consensus_borda.csv", "out/condorcet.json", "out/x.local_embedding.csv", "out/joint_features.cluster_robust.csv", "notes/method_notes.json", "tmp/p.cache.json", "out/unknown.txt"]


@query(f"WITH p AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'v1' WHEN 1 THEN 'v2' ELSE 'misc' END || CASE doc_id % 2 WHEN 0 THEN '/ec/' ELSE '/ce/' END || CASE doc_id % {len(NAMES)} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(NAMES)) + " END AS path FROM documents) SELECT DISTINCT path, CASE WHEN split_part(path, '/', 1) IN ('v1', 'v2') THEN split_part(path, '/', 1) ELSE '' END AS version, CASE WHEN contains(path, '/ec/') THEN 'EC' WHEN contains(path, '/ce/') THEN 'CE' ELSE '' END AS direction, upper(regexp_extract(path, '[.]([^./]+)$', 1)) AS format, CASE " + " ".join(f"WHEN contains(path, '{a}') THEN '{b}'" for a, b in records.ARTIFACT_RULES) + " ELSE 'other' END AS category FROM p")
def q_file_catalog(spark, d):
    """Artifact paths made from document ids, classified by the ordered rules."""
    name = F.get(F.array(*[F.lit(n) for n in NAMES]), (F.col("doc_id") % len(NAMES)).cast("int"))
    head = F.get(F.array(F.lit("v1"), F.lit("v2"), F.lit("misc")), (F.col("doc_id") % 3).cast("int"))
    path = F.concat(head, F.when(F.col("doc_id") % 2 == 0, "/ec/").otherwise("/ce/"), name)
    return records.catalogue(table(spark, d, "documents").select(path.alias("path")).distinct(), ["v1", "v2"])


STREAMED = f"(SELECT doc_id, {NORMAL} AS text FROM documents WHERE text IS NOT NULL)"


@query(f"WITH k AS (SELECT min_by(text, doc_id) AS text, min(doc_id) AS doc_id, sha256({KEY}) AS dedupe_key FROM {STREAMED} GROUP BY 3) SELECT doc_id, dedupe_key FROM k WHERE {REASON} IS NULL")
def q_stream_screen(spark, d):
    """The screen as a stream over the documents, run to its end; accepted documents."""
    import uuid

    out = f"{shared_dir(spark)}/screen-{uuid.uuid4().hex}"
    screen.screen_stream(spark, f"{d}/documents.parquet", out, RULES)
    return spark.read.parquet(f"{out}/accepted").select("doc_id", "dedupe_key")
