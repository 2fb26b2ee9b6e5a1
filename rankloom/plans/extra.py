"""Queries of replies, records, orders, controls and whole syntax vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import replies
from ..functions import text as X
from ..operators import judging, records, sampling, screening, syntax
from ..session import table
from .catalogue import CJK_RE, MAJORITY, PAIRS, REL, TAG, VARIANTS, WORD_RE, _cnt, _in, _ranks, _terms, query

# ------------------------------------------------------------------ replies

@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN source || chr(10) || coalesce(lang, 'none') WHEN 2 THEN NULL ELSE NULL END AS content FROM documents WHERE source IS NOT NULL AND text IS NOT NULL")
def q_reply_content(spark, d):
    """Chat replies whose content is a string, a list of parts, an empty list, or a number."""
    docs = table(spark, d, "documents").where("source is not null and text is not null")
    js = lambda c: F.substring(F.to_json(F.struct(c.alias("v"))), 6, 2_000_000_000)
    rows = docs.select("doc_id", js(F.col("text")).alias("t"), js(F.col("source")).alias("s"), js(F.coalesce("lang", F.lit("none"))).alias("l"))
    rows = rows.select("doc_id", *[F.expr(f"substring({c}, 1, length({c}) - 1)").alias(c) for c in "tsl"])
    content = F.when(F.col("doc_id") % 4 == 0, F.col("t")).when(F.col("doc_id") % 4 == 1, F.concat(F.lit('[{"text": '), "s", F.lit('}, {"image": 1}, 7, '), "l", F.lit("]"))).when(F.col("doc_id") % 4 == 2, F.lit("[]")).otherwise(F.lit("5"))
    reply = F.concat(F.lit('{"choices": [{"message": {"role": "assistant", "content": '), content, F.lit("}}]}"))
    return rows.select("doc_id", replies.content(reply).alias("content"))


@query("""WITH r AS (SELECT doc_id, text, doc_id % 6 AS k FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, k IN (0, 1, 3) AS usable, (CASE k WHEN 0 THEN 100 WHEN 1 THEN 0 WHEN 2 THEN 50 WHEN 3 THEN 7 ELSE 0 END)::INT AS score,
  CASE k WHEN 0 THEN 'policy' WHEN 1 THEN 'reject' WHEN 3 THEN 'market' ELSE 'reject' END AS category, CASE k WHEN 0 THEN 'a|b' WHEN 3 THEN 'short' ELSE '' END AS issues,
  CASE k WHEN 0 THEN 'clean one' WHEN 1 THEN text WHEN 3 THEN text ELSE '' END AS cleaned_text FROM r WHERE k <> 5""")
def q_reviews(spark, d):
    """Reviews of every kind: out-of-range scores, missing and blank fields, truth by value, unusable texts, and no JSON at all."""
    bodies = [
        '{"usable": true, "score": 140, "category": " policy ", "issues": ["a", "b"], "cleaned_text": "clean  one"}', '{"usable": 1, "score": -3, "category": " "}',
        '{"usable": false, "score": 50, "category": "market", "cleaned_text": "x"}', '{"usable": "yes", "score": "7", "category": "market", "issues": "short", "cleaned_text": " "}', '{"usable": null}', "no json",
    ]
    docs = table(spark, d, "documents").where("text is not null")
    reply = F.get(F.array(*[F.lit(b) for b in bodies]), (F.col("doc_id") % 6).cast("int"))
    got = docs.select("doc_id", replies.review(reply, F.col("text")).alias("r")).where("r is not null")
    return got.select("doc_id", "r.usable", "r.score", "r.category", F.array_join("r.issues", "|").alias("issues"), "r.cleaned_text")


@query("SELECT event_id, CASE WHEN event_id % 3 <> 2 THEN event_id END AS id FROM events")
def q_fenced_json(spark, d):
    """Objects inside code fences or between words; every third reply has none."""
    ev = table(spark, d, "events")
    body = F.to_json(F.struct(F.col("event_id").alias("id")))
    reply = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Sure: "), body, F.lit(" as asked"))).otherwise(F.lit("no object"))
    return ev.select("event_id", F.get_json_object(X.fenced_json(reply), "$.id").cast("bigint").alias("id"))


WHOLE = "SELECT DISTINCT sample_id, generation_round, variants FROM ec_400_with_candidates WHERE list_sort(list_transform(variants, lambda v: v.id)) = ['A','B','C','D','E','F'] AND len(list_filter(variants, lambda v: v.translation IS NULL)) = 0"


@query(f"WITH w AS ({WHOLE}) SELECT sample_id, generation_round, v.id AS letter, v.feature_target AS feature_target, v.translation AS translation FROM (SELECT sample_id, generation_round, unnest(variants) AS v FROM w)")
def q_parse_replies(spark, d):
    """Six variants out of replies, every other one of which has lost the escapes of its quotes."""
    rows = table(spark, d, "ec_400_with_candidates").select("sample_id", "generation_round", "variants").distinct()
    body = F.to_json(F.struct(F.transform("variants", lambda v: F.struct(v["id"].alias("id"), v["feature_target"].alias("feature_target"), v["translation"].alias("translation"))).alias("variants")))
    reply = F.when(F.col("sample_id") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.replace(body, F.lit('\\"'), F.lit('"')))
    got = records.variants_of_replies(rows.select("sample_id", "generation_round", reply.alias("reply")), "reply").where("parsed is not null")
    return got.select("sample_id", "generation_round", F.explode("parsed").alias("v")).select("sample_id", "generation_round", F.col("v.id").alias("letter"), "v.feature_target", "v.translation")


@query("SELECT l_linenumber AS attempt, " + ", ".join(f"least({factor} * {f'power({base}, l_linenumber)' if base > 1 else 'l_linenumber'}, {most})::BIGINT AS {kind}" for kind, (base, factor, most) in replies.WAITS.items()) + " FROM lineitem GROUP BY l_linenumber")
def q_backoff(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_linenumber").alias("attempt")).distinct().select("attempt", *[replies.backoff(F.col("attempt"), k).alias(k) for k in replies.WAITS])


# ------------------------------------------------------------------ records

@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS stamp FROM events")
def q_utc_stamps(spark, d):
    return table(spark, d, "events").select("event_id", X.utc_stamp(F.col("ts")).alias("stamp"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped, length(text) AS chars, upper(source) AS source FROM documents")
def q_escape_html(spark, d):
    return table(spark, d, "documents").select("doc_id", X.escape_html(F.col("text")).alias("escaped"), F.length("text").cast("bigint").alias("chars"), F.upper("source").alias("source"))


@query("SELECT id, 'Translate from ' || coalesce(lower(source_lang), '') || ' to ' || coalesce(target_lang, '') || ':' || chr(10) || coalesce(source_text, '') AS prompt FROM base_samples")
def q_prompts(spark, d):
    b = table(spark, d, "base_samples")
    return b.select("id", X.fill_template("Translate from {source} to {target}:\n{text}", source=F.lower("source_lang"), target=F.col("target_lang"), text=F.col("source_text")).alias("prompt"))


TEXT_COLUMNS = ["id", "direction", "source_lang", "target_lang", "human_translation", "domain_subtype", "difficulty", "corpus_source", "source_book"]
LONGEST = "list_sort([" + ", ".join(f"{{'s': coalesce(length({c}), -1), 'p': -{i}, 'n': '{c}'}}" for i, c in enumerate(TEXT_COLUMNS)) + "], 'DESC')[1].n"


@query(f"SELECT id, 'source_text' AS preferred, {LONGEST} AS longest FROM base_samples")
def q_source_field(spark, d):
    """The field that holds the source: by its name, and without that column by its length."""
    b = table(spark, d, "base_samples")
    rest = b.select(*TEXT_COLUMNS)
    by_name = records.source_field(b.select("id", F.coalesce(F.nullif("source_text", F.lit("")), F.lit("x")).alias("source_text")))
    return rest.withColumn("longest", records.source_field(rest)).withColumn("source_text", F.lit("x")).select("id", by_name.alias("preferred"), "longest")


@query("SELECT * FROM (VALUES (0::BIGINT, 'candidate_2'), (1, 'candidate_10'), (2, 'human_translation')) t(place, field)")
def q_candidate_fields(spark, d):
    """Fields that hold candidates, in natural order of their names."""
    b = table(spark, d, "base_samples").withColumn("candidate_10", F.col("id")).withColumn("candidate_2", F.col("id"))
    return spark.createDataFrame([(i, f) for i, f in enumerate(records.candidate_fields(b, "source_text"))], "place bigint, field string")


@query("SELECT * FROM (VALUES (0::BIGINT, 'sample_id'), (1, 'loaded_at')) t(place, field)")
def q_common_fields(spark, d):
    names = records.common_columns(table(spark, d, "judge_rankings"), table(spark, d, "ec_400_with_candidates"))
    return spark.createDataFrame([(i, f) for i, f in enumerate(names)], "place bigint, field string")


@query("WITH r AS (SELECT DISTINCT sample_id, generation_round, source_text FROM ec_400_with_candidates) SELECT sample_id, generation_round, coalesce(CASE WHEN sample_id % 3 = 0 THEN 'map' END, CASE WHEN sample_id % 3 = 1 AND generation_round = 1 THEN 'position' END, CASE WHEN source_text IS NOT NULL THEN 'text' END) AS origin FROM r WHERE source_text IS NOT NULL")
def q_source_resolution(spark, d):
    """Each record's origin by the first of three sources that knows it; one that none knows would stop the query."""
    r = table(spark, d, "ec_400_with_candidates").where("source_text is not null").select("sample_id", "generation_round", "source_text").distinct()
    by_map = F.when(F.col("sample_id") % 3 == 0, "map")
    by_place = F.when((F.col("sample_id") % 3 == 1) & (F.col("generation_round") == 1), "position")
    return r.select("sample_id", "generation_round", records.first_source(by_map, by_place, F.when(F.col("source_text").isNotNull(), "text")).alias("origin"))


@query("SELECT event_id, coalesce(CASE WHEN json_valid(props) THEN json_extract_string(props, '$.k') END, 'none') AS k, coalesce(CASE WHEN json_valid(props) THEN try_cast(json_extract_string(props, '$.missing') AS BIGINT) END, -1) AS missing FROM events")
def q_defaults(spark, d):
    """Fields of a JSON record, with defaults where they are absent."""
    return table(spark, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("none")).alias("k"), F.coalesce(F.get_json_object("props", "$.missing").try_cast("bigint"), F.lit(-1)).cast("bigint").alias("missing"))


BLANKLESS = f"coalesce(trim(regexp_replace(v.translation, '{X.SPACE}+', ' ', 'g')), '')"
CHECKED = f"checked AS (SELECT DISTINCT sample_id, generation_round, list_sort(list_transform(variants, lambda v: upper(trim(v.id)))) = ['A','B','C','D','E','F'] AND len(list_filter(variants, lambda v: {BLANKLESS} = '')) = 0 AS ok FROM ec_400_with_candidates)"


@query(f"WITH {CHECKED} SELECT generation_round, sum(CAST(coalesce(ok, false) AS INT))::BIGINT AS passed, sum(CAST(NOT coalesce(ok, false) AS INT))::BIGINT AS failed, round(sum(CAST(coalesce(ok, false) AS INT)) / count(*) * 100, 1) AS pass_rate FROM checked GROUP BY generation_round")
def q_pass_rate(spark, d):
    """Records that hold six variants and no blank one; what can't be checked counts as failed."""
    bad = records.variant_errors(table(spark, d, "ec_400_with_candidates"), ["sample_id", "generation_round"])
    ok = F.coalesce((F.col("missing") == "") & (F.col("extra") == "") & (F.col("blank") == ""), F.lit(False))
    return bad.groupBy("generation_round").agg(
        F.sum(ok.cast("int")).alias("passed"), F.sum((~ok).cast("int")).alias("failed"), F.round(F.sum(ok.cast("int")) / F.count("*") * 100, 1).alias("pass_rate")
    )


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE category = 'policy') AS visible, count(*) FILTER (WHERE lang IS DISTINCT FROM lower(lang)) AS dirty,
  sum(CAST(lang IS NULL AS INT) + CAST(category IS NULL AS INT) + CAST(published_at IS NULL AS INT))::BIGINT AS issues FROM documents""")
def q_editor_stats(spark, d):
    """Totals of a filtered view: visible rows, rows whose spelling would be changed, missing fields."""
    missing = sum((F.col(c).isNull().cast("int") for c in ("category", "published_at")), F.col("lang").isNull().cast("int"))
    return table(spark, d, "documents").agg(
        F.count("*").alias("total"), F.count_if(F.col("category") == "policy").alias("visible"), F.count_if(~F.col("lang").eqNullSafe(F.lower("lang"))).alias("dirty"), F.sum(missing).alias("issues")
    )


@query("SELECT id, coalesce(human_translation, 'none') AS human_translation, lower(source_lang) AS source_lang, 'edited' AS state FROM base_samples")
def q_record_spread(spark, d):
    """A record spread with later fields winning."""
    b = table(spark, d, "base_samples").select("id", "human_translation", "source_lang")
    return b.withColumns({"human_translation": F.coalesce("human_translation", F.lit("none")), "source_lang": F.lower("source_lang"), "state": F.lit("edited")})


# ------------------------------------------------------------------ orders

@query("WITH o AS (SELECT DISTINCT lower(trim(judge)) AS judge, sample_id::VARCHAR AS sample_id FROM judge_rankings WHERE judge IS NOT NULL AND sample_id IS NOT NULL) SELECT row_number() OVER (ORDER BY judge, sample_id) - 1 AS place, judge, sample_id FROM o")
def q_model_sample_order(spark, d):
    """Judges and samples in string order, in which 10 comes before 2."""
    rows = table(spark, d, "judge_rankings").where("judge is not null and sample_id is not null").select(F.lower(F.trim("judge")).alias("judge"), F.col("sample_id").cast("string").alias("sample_id")).distinct()
    return screening.numbered(rows, ["judge", "sample_id"]).select(F.col("row_no").alias("place"), "judge", "sample_id")


@query("WITH g AS (SELECT lower(lang) AS lang, category, count(*) AS n FROM documents WHERE lang IS NOT NULL AND category IS NOT NULL GROUP BY ALL) SELECT row_number() OVER (ORDER BY lang, category) - 1 AS place, lang, category, n FROM g")
def q_group_order(spark, d):
    g = table(spark, d, "documents").where("lang is not null and category is not null").groupBy(F.lower("lang").alias("lang"), "category").agg(F.count("*").alias("n"))
    return screening.numbered(g, ["lang", "category"]).select(F.col("row_no").alias("place"), "lang", "category", "n")


@query("WITH o AS (SELECT lower(trim(model)) AS model, min(obs_id) AS first FROM pairwise_observations WHERE model IS NOT NULL GROUP BY 1) SELECT row_number() OVER (ORDER BY first) - 1 AS place, model FROM o")
def q_ordered_distinct(spark, d):
    """Distinct judges in the order of their first observation."""
    o = table(spark, d, "pairwise_observations").where("model is not null").groupBy(F.lower(F.trim("model")).alias("model")).agg(F.min("obs_id").alias("first"))
    return screening.numbered(o, ["first"]).select(F.col("row_no").alias("place"), "model")


@query("SELECT row_number() OVER (ORDER BY (n_nationkey * 7919 + 42 * 131) % 1009, n_nationkey) - 1 AS place, n_nationkey FROM nation")
def q_seeded_order(spark, d):
    """A permutation that follows from ids and a seed by arithmetic."""
    n = table(spark, d, "nation").withColumn("h", F.pmod(F.col("n_nationkey") * 7919 + 42 * 131, F.lit(1009)))
    return screening.numbered(n, ["h", "n_nationkey"]).select(F.col("row_no").alias("place"), "n_nationkey")


@query("SELECT row_number() OVER (ORDER BY n_name DESC) AS place, n_name FROM nation QUALIFY place <= 7")
def q_named_sampler(spark, d):
    """A sample by a function that is named in the settings."""
    pick = sampling.load("rankloom.operators.sampling:stratified")
    rows = table(spark, d, "nation").withColumn("id", F.col("n_nationkey")).withColumn("all", F.lit(1))
    names = screening.numbered(rows.select("n_name"), ["n_name"]).select("n_name", (-F.col("row_no")).alias("back"))
    return pick(rows.join(names, "n_name"), ["all"], 7, F.col("back")).select(F.col("place").cast("bigint").alias("place"), "n_name")


@query(MAJORITY + ", s AS (SELECT sample_id, n AS n_judges, round((" + " + ".join(f"least({a}{b}, n - {a}{b}) / n" for a, b in PAIRS) + f") / {len(PAIRS)}, 6) AS disagreement FROM maj) SELECT * FROM s WHERE disagreement >= 0.3")
def q_contested(spark, d):
    """Samples whose judges disagree on three tenths of the pairs or more."""
    return judging.contested(_ranks(spark, d), 0.3)


# ------------------------------------------------------------------ controls

NUMBERS = "[0-9]+(?:[.,][0-9]+)*"
VAR1 = VARIANTS + f", pairs AS (SELECT DISTINCT v.sample_id, v.letter, r.source_text AS s, v.translation AS t FROM variants v JOIN (SELECT DISTINCT sample_id, generation_round, source_text FROM ec_400_with_candidates) r USING (sample_id, generation_round) WHERE generation_round = 1 AND r.source_text IS NOT NULL AND v.translation IS NOT NULL)"


def _sides(spark, d):
    ec = table(spark, d, "ec_400_with_candidates").where("generation_round = 1 and source_text is not null")
    s = ec.select("sample_id", F.col("source_text").alias("s")).distinct()
    return records.variants(ec, ["sample_id"]).where("translation is not null").join(s, "sample_id").select("sample_id", "letter", "s", F.col("translation").alias("t"))


@query(f"WITH {VAR1}, f AS (SELECT sample_id, letter, list_distinct(regexp_extract_all(s, '{NUMBERS}')) AS a, list_distinct(regexp_extract_all(t, '{NUMBERS}')) AS b, list_distinct(regexp_extract_all(s, '[A-Z][A-Za-z]+')) AS x, list_distinct(regexp_extract_all(t, '[A-Z][A-Za-z]+')) AS y FROM pairs) "
       "SELECT sample_id, letter, round(len(list_filter(b, lambda q: NOT list_contains(a, q))) / greatest(len(b), 1), 6) AS extra_number_ratio, len(list_filter(y, lambda q: NOT list_contains(x, q))) AS extra_entity_count FROM f")
def q_rule_controls(spark, d):
    """Numbers and capitalised words of a translation that its source lacks."""
    found = lambda c, p: F.array_distinct(F.regexp_extract_all(c, F.lit(p), F.lit(0)))
    rows = _sides(spark, d).select("sample_id", "letter", found("s", NUMBERS).alias("a"), found("t", NUMBERS).alias("b"), found("s", "[A-Z][A-Za-z]+").alias("x"), found("t", "[A-Z][A-Za-z]+").alias("y")).distinct()
    return rows.select(
        "sample_id", "letter", F.round(F.size(F.array_except("b", "a")) / F.greatest(F.size("b"), F.lit(1)), 6).alias("extra_number_ratio"), F.size(F.array_except("y", "x")).cast("bigint").alias("extra_entity_count")
    )


@query(f"WITH {VAR1} SELECT sample_id, letter, round({_cnt(CJK_RE, 't')} / greatest({_cnt(X.TOKEN, 's')}, 1), 6) AS target_source_length_ratio FROM pairs")
def q_length_ratio(spark, d):
    """The compression ratio under its better name: Chinese characters of the translation over words of the source."""
    return _sides(spark, d).select("sample_id", "letter", F.round(X.cjk_count(F.col("t")) / X.source_word_count(F.col("s")), 6).alias("target_source_length_ratio"))


# ------------------------------------------------------------------ whole syntax vectors

LONG = 20


def _parse_sql(words: str) -> str:
    rel = " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(REL))
    tag = " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(TAG))
    return f"""{words}, tok AS (SELECT doc_id, unnest(w) AS text, generate_subscripts(w, 1) - 1 AS nth FROM words),
      tree AS (SELECT doc_id, (nth // {LONG}) AS sent, nth % {LONG} + 1 AS id, text, ((nth % {LONG} + 1) * 7919 % 101 + doc_id) % (nth % {LONG} + 1) AS head,
        CASE ((nth % {LONG} + 1) * 31 + doc_id) % {len(REL)} {rel} END AS deprel, CASE ((nth % {LONG} + 1) * 17 + doc_id) % {len(TAG)} {tag} END AS upos, CASE WHEN (nth % {LONG} + 1) % 13 = 0 THEN 'Voice=Pass' END AS feats FROM tok),
      walk AS (SELECT doc_id, sent, id, 0 AS depth FROM tree WHERE head = 0 UNION ALL SELECT t.doc_id, t.sent, t.id, w.depth + 1 FROM walk w JOIN tree t ON t.doc_id = w.doc_id AND t.sent = w.sent AND t.head = w.id),
      deep AS (SELECT doc_id, max(depth)::DOUBLE AS depth FROM walk GROUP BY doc_id),
      base AS (SELECT doc_id, count(*) AS n, count(DISTINCT sent) AS sents, avg(CASE WHEN head <> 0 THEN abs(id - head) END) AS md, max(CASE WHEN head <> 0 THEN abs(id - head) END) AS xd,"""


VECTOR = """depth AS dependency_depth, round(coalesce(md, 0), 6) AS mean_dependency_distance, coalesce(xd, 0)::DOUBLE AS max_dependency_distance,
  round(coalesce(md, 0) / greatest(n - sents, 1), 6) AS normalized_dependency_distance, round(modifiers / n, 6) AS modifier_density"""
LAST = "n::DOUBLE AS token_count, sents::DOUBLE AS sentence_count, round(n / sents, 6) AS avg_sentence_length"


def _parsed(docs, words):
    """A made-up parse by arithmetic, in sentences of LONG tokens: a parser is not part of this repository."""
    doc = F.col("doc_id")

    def token(x, i):
        n = (i + 1).cast("bigint")
        pick = lambda values, k: F.get(F.array(*[F.lit(v) for v in values]), F.pmod(n * k + doc, F.lit(len(values))).cast("int"))
        return F.struct(
            n.cast("int").alias("id"), F.pmod(F.pmod(n * 7919, F.lit(101)) + doc, n).cast("int").alias("head"), pick(REL, 31).alias("deprel"), pick(TAG, 17).alias("upos"), x.alias("text"),
            F.when(n % 13 == 0, "Voice=Pass").alias("feats"),
        )

    rows = docs.withColumn("w", words).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.floor((F.size("w") - 1) / LONG).cast("int"))
    return rows.withColumn("sentences", F.transform(starts, lambda s: F.transform(F.slice("w", s * LONG + 1, LONG), token)))


EN = f"words AS (SELECT doc_id, regexp_extract_all(text, '{WORD_RE}') AS w FROM documents WHERE lower(lang) = 'en')"


@query(f"WITH RECURSIVE {_parse_sql(EN)} count(*) FILTER (WHERE deprel IN {_in(syntax.EN_CLAUSE)}) AS clauses, greatest(count(*) FILTER (WHERE upos IN {_in(syntax.CONTENT)}), 1) AS content, count(*) FILTER (WHERE upos IN ('NOUN', 'PROPN')) AS nouns,"
       f" count(*) FILTER (WHERE upos IN ('NOUN', 'ADJ') AND regexp_matches(lower(text), '{syntax.EN_SUFFIX}')) AS suffix, count(*) FILTER (WHERE lower(text) = 'of') AS ofs, count(*) FILTER (WHERE deprel IN {_in(syntax.EN_MODIFIER)}) AS modifiers,"
       " count(*) FILTER (WHERE deprel IN ('cc', 'conj')) + count(*) FILTER (WHERE lower(text) IN ('and', 'or', 'but', 'nor')) AS coord, count(*) FILTER (WHERE contains(deprel, 'pass') OR feats = 'Voice=Pass') AS passive FROM tree GROUP BY doc_id)"
       f" SELECT doc_id, greatest(clauses, sents)::DOUBLE AS clause_count, {VECTOR}, round((nouns + 0.7::DOUBLE * suffix + 0.35::DOUBLE * ofs) / content, 6) AS nominalization_ratio, coord::DOUBLE AS coordination_count, passive::DOUBLE AS passive_count,"
       f" round({_cnt(WORD_RE, 'd.text')} / greatest({_cnt(CJK_RE, 'd.category')}, 1), 6) AS sentence_compression_ratio, {LAST} FROM base JOIN deep USING (doc_id) JOIN documents d USING (doc_id)")
def q_syntax_vector_en(spark, d):
    docs = table(spark, d, "documents").where(F.lower("lang") == "en").select("doc_id", "text", F.coalesce("category", F.lit("")).alias("category"))
    rows = _parsed(docs, X.en_word_list(F.col("text")))
    return rows.select("doc_id", *[v.alias(k) for k, v in syntax.vector_en(F.col("sentences"), F.col("category"), F.col("text")).items()])


ZH = f"words AS (SELECT doc_id, regexp_extract_all(text, '{CJK_RE}') AS w FROM documents WHERE lower(lang) = 'zh')"
ZH_PIECES = f"len(list_filter(regexp_split_to_array(d.text, '{syntax.ZH_CLAUSE_MARKS}'), lambda x: trim(x) <> ''))"


@query(f"WITH RECURSIVE {_parse_sql(ZH)} count(*) FILTER (WHERE deprel IN {_in(syntax.ZH_CLAUSE)}) AS clauses, greatest(count(*) FILTER (WHERE upos NOT IN ('PUNCT', 'PART', 'SYM')), 1) AS content, count(*) FILTER (WHERE upos IN ('NOUN', 'PROPN', 'PRON')) AS nouns,"
       f" count(*) FILTER (WHERE regexp_matches(text, '{syntax.ZH_SUFFIX}')) AS suffix, count(*) FILTER (WHERE deprel IN {_in(syntax.ZH_MODIFIER)}) AS modifiers, count(*) FILTER (WHERE deprel IN ('cc', 'conj')) AS coord, count(*) FILTER (WHERE contains(deprel, 'pass')) AS passive FROM tree GROUP BY doc_id)"
       f" SELECT doc_id, greatest(clauses, sents, {ZH_PIECES})::DOUBLE AS clause_count, {VECTOR}, round((nouns + 0.5::DOUBLE * suffix + 0.35::DOUBLE * {_terms(['的', '之'], 'd.text')}) / content, 6) AS nominalization_ratio, (coord + {_terms(syntax.ZH_COORDINATION, 'd.text')})::DOUBLE AS coordination_count,"
       f" (passive + {_terms(syntax.ZH_PASSIVE, 'd.text')})::DOUBLE AS passive_or_beishi_count, round({_cnt(CJK_RE, 'd.text')} / greatest({_cnt(X.TOKEN, 'd.source')}, 1), 6) AS sentence_compression_ratio, {LAST} FROM base JOIN deep USING (doc_id) JOIN documents d USING (doc_id)")
def q_syntax_vector_zh(spark, d):
    docs = table(spark, d, "documents").where(F.lower("lang") == "zh").select("doc_id", "text", "source")
    rows = _parsed(docs, F.regexp_extract_all("text", F.lit(X.CJK), F.lit(0)))
    return rows.select("doc_id", *[v.alias(k) for k, v in syntax.vector_zh(F.col("sentences"), F.col("source"), F.col("text")).items()])


@query(f"SELECT doc_id, trim(regexp_replace(text, '{X.SPACE}+', ' ', 'g')) AS text FROM documents WHERE text IS NOT NULL AND lower(lang) IN ('zh', 'en')")
def q_normalize_text(spark, d):
    """Good Chinese and English texts, unharmed by repair, with their white space collapsed."""
    docs = table(spark, d, "documents").where("text is not null and lower(lang) in ('zh', 'en')")
    return docs.select("doc_id", X.normalize_text(F.col("text"), F.lower("lang")).alias("text"))


# UTF-8 bytes read as Latin-1, Windows-1252 and GBK; in Chinese the reading with more Chinese wins, elsewhere the longest, so that a garbled one stays
GARBLED = [("cafÃ© naÃ¯ve", "en", "cafÃ© naÃ¯ve"), ("ä¸\xadæ\x96\x87", "zh", "中文"), ("å¤®è¡Œ", "zh", "央行"), ("涓枃", "zh", "涓枃"), ("中文", "zh", "中文"), ("déjà vu", "en", "déjà vu"), ("plain", "zh", "plain")]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{good}')" for i, (_, _, good) in enumerate(GARBLED)) + ") t(sample, repaired)")
def q_repair_golden(spark, d):
    """Literal texts that were read in a wrong code page, repaired."""
    df = spark.createDataFrame([(i, bad, lang) for i, (bad, lang, _) in enumerate(GARBLED)], "sample bigint, garbled string, lang string")
    return df.select("sample", X.repair_mojibake(F.col("garbled"), F.col("lang")).alias("repaired"))
