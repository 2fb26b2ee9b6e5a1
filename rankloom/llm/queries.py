"""The pN_ queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import consensus, leakage, lookalike, neardup, packing, pairdefects, ranking, sentences, splitting
from .textform import multi_map, single_map


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pairdefects.defects(table(spark, d, "ec_400_with_candidates"))


def p1_labels(spark: SparkSession, d: str) -> DataFrame:
    return pairdefects.labelled(table(spark, d, "ec_400_with_candidates"))


def p2_consensus(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(table(spark, d, "judge_rankings"))


def p2_reliability(spark: SparkSession, d: str) -> DataFrame:
    return consensus.reliability(table(spark, d, "judge_rankings"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.found(table(spark, d, "judge_rankings"))


def p2_agreement(spark: SparkSession, d: str) -> DataFrame:
    return consensus.agreement(table(spark, d, "judge_rankings"))


def _texts_of_both_tables(spark: SparkSession, d: str) -> DataFrame:
    docs = lookalike.keyed(table(spark, d, "documents"), "documents", "doc_id", "text")
    return docs.union(lookalike.keyed(table(spark, d, "ec_400_with_candidates"), "ec_400_with_candidates", "sample_id", "source_text"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.looking_alike(_texts_of_both_tables(spark, d))


def p3_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.consistent_form(_texts_of_both_tables(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return ranking.stronger_pairs(table(spark, d, "pairwise_observations"))


def p4_ranking(spark: SparkSession, d: str) -> DataFrame:
    return ranking.global_ranking(table(spark, d, "pairwise_observations"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("doc", "doc_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.grouped_pairs(neardup.near_duplicates(table(spark, d, "documents"), "doc_id", "text", counted=False))


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    got = leakage.leaked(table(spark, d, "documents"), table(spark, d, "held_out_items"), "doc_id", "text", "item_id", "text")
    return got.withColumnRenamed("doc", "doc_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("doc_id", "item_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows = sentences.parts(table(spark, d, "ec_400_with_candidates"))
    return sentences.sentences(rows, ["sample_id", "generation_round", "text_part"], "text")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    capacity, _ = splitting.limit_of(table(spark, d, "size_limits"), "container")
    return packing.fill_containers(table(spark, d, "documents"), "doc_id", "text", "source", capacity).withColumnRenamed("doc", "doc_id")


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    limit, overlap = splitting.limit_of(table(spark, d, "size_limits"), "piece")
    return splitting.split_oversized(table(spark, d, "documents"), "doc_id", "text", limit, overlap).withColumnRenamed("doc", "doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_pieces(spark, d).where("piece_no = 1").select("doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_labels, p2_agreement, p2_consensus, p2_found, p2_reliability, p3_found, p3_forms, p4_found, p4_ranking, p5_found, p5_groups, p6_found, p7_containers, p8_found, p8_leaks, p9_found, p9_pieces)}


def _form_sql(c: str) -> str:
    """The consistent form in SQL: the maps of textform and the composed normal form."""
    single = single_map()
    order = [a for a, b in single.items() if b] + [a for a, b in single.items() if not b]
    quoted = lambda x: x.replace("'", "''")
    out = f"translate({c}, '{quoted(''.join(order))}', '{quoted(''.join(single[a] for a in order))}')"
    for a, b in multi_map().items():
        if a <= lookalike.LAST_LATIN_LIGATURE:
            out = f"replace({out}, '{a}', '{b}')"
    return f"nfc_normalize({out})"


def _mapped_sql(c: str) -> str:
    return _form_sql(c)[len("nfc_normalize(") : -1]


def _letters_sql(c: str) -> str:
    return f"regexp_replace(lower({_form_sql(c)}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


# documents linked by their five-character runs, and what is reached by links
_LINKED = f"""WITH RECURSIVE f AS (SELECT doc_id, {_letters_sql('text')} AS t, {_form_sql('text')} AS form FROM documents WHERE text IS NOT NULL),
      r AS (SELECT DISTINCT doc_id, unnest(CASE WHEN length(t) < 5 THEN [t] ELSE list_transform(generate_series(1, length(t) - 4), lambda i: substr(t, i, 5)) END) AS x FROM f WHERE t <> ''),
      n AS (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id),
      both_have AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM r a JOIN r b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
      link AS (SELECT a, b FROM both_have JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.7 * (x.n + y.n - c)),
      edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
      reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a)"""

# rankings, each (sample, judge, rep) once, counted by sample, judge and order
_KNOWN = "list_filter({0}, lambda x: x IN ('A','B','C','D','E','F'))"
_ORDER = "array_to_string(list_filter({0}, lambda x, i: list_position({0}, x) = i), '')"
_BALLOTS = f"""WITH lists AS (SELECT sample_id, lower(trim(judge)) AS judge, coalesce(rep, -1) AS rep,
        {_KNOWN.format("list_transform(ranking, lambda x: upper(trim(t_map[upper(trim(x))])))")} AS l, {_KNOWN.format("list_transform(letter_ranking, lambda x: upper(trim(x)))")} AS g FROM judge_rankings),
      raw AS (SELECT sample_id, judge, rep, coalesce(nullif({_ORDER.format('l')}, ''), {_ORDER.format('g')}) AS letters FROM lists),
      once AS (SELECT sample_id, judge, rep, min(letters) AS letters FROM raw WHERE sample_id IS NOT NULL AND judge IS NOT NULL AND letters <> '' GROUP BY ALL),
      counted AS (SELECT sample_id, judge, letters, letters[1] AS x, count(*) AS c FROM once GROUP BY ALL)"""


def _rounds_sql(rounds: int = 10) -> str:
    """The reweighting as so many rounds written one after the other; stable on the test tables long before."""
    prior, chance = consensus.PRIOR, "[" + ", ".join(f"{x}::DOUBLE" for x in consensus.CHANCE) + "]"
    out = [_BALLOTS, f"""w AS (SELECT sample_id, judge, letters, c / (1 + (sum(c) OVER (PARTITION BY sample_id, judge) - 1) * {consensus.REPEATS}) AS n FROM counted),
      abc AS (SELECT unnest(['A','B','C','D','E','F']) AS x),
      placed AS MATERIALIZED (SELECT sample_id, judge, x, instr(letters, x) + 1 AS p, n FROM w CROSS JOIN abc),
      chance AS (SELECT {chance} AS q),
      r0 AS (SELECT DISTINCT judge, [{", ".join(f"{x}::DOUBLE" for x in consensus.START)}] AS a FROM w)"""]
    for i in range(rounds):
        at = ", ".join(f"(coalesce(sum(CASE WHEN p = {p + 1} THEN n END), 0) + {prior} * q[{p + 1}]) / (coalesce(sum(CASE WHEN p IS NOT NULL THEN n END), 0) + {prior})" for p in range(consensus.K + 1))
        out.append(f"""o{i} AS MATERIALIZED (SELECT sample_id, judge, x, sum(n * ln(a[p] / q[p])) AS v FROM placed JOIN r{i} USING (judge) CROSS JOIN chance GROUP BY ALL),
      t{i} AS MATERIALIZED (SELECT sample_id, x, sum(v) AS t FROM o{i} GROUP BY ALL),
      l{i} AS MATERIALIZED (SELECT sample_id, judge, min((-round(t - v, 9), x))[2] AS x FROM o{i} JOIN t{i} USING (sample_id, x) GROUP BY sample_id, judge HAVING max(t - v) - min(t - v) > 1e-9),
      r{i + 1} AS MATERIALIZED (SELECT judge, [{at}] AS a FROM (SELECT r{i}.judge AS judge, p, n FROM r{i} LEFT JOIN (SELECT * FROM placed JOIN l{i} USING (sample_id, judge, x)) USING (judge)) CROSS JOIN chance GROUP BY judge, q)""")
    out.append(f"""score AS (SELECT sample_id, x, round(sum(n * ln(a[p] / q[p])), 9) AS s FROM placed JOIN r{rounds} USING (judge) CROSS JOIN chance GROUP BY ALL),
      best AS (SELECT sample_id, min((-s, x))[2] AS label, list_sort(list(s), 'DESC') AS top FROM score GROUP BY sample_id)""")
    return ", ".join(out)


_FIRST = """first AS (SELECT sample_id, x, sum(c)::BIGINT AS c FROM counted GROUP BY ALL),
      per AS (SELECT sample_id, sum(c)::BIGINT AS t, sum(c * (c - 1))::BIGINT AS same FROM first GROUP BY sample_id HAVING sum(c) > 1),
      exp AS (SELECT 1 - sum(c * (c - 1)) / (sum(c) * (sum(c) - 1)) AS e FROM (SELECT x, sum(c) AS c FROM first JOIN per USING (sample_id) GROUP BY x))"""

_WON = """WITH RECURSIVE c AS (SELECT obs_id, lower(trim(candidate_a)) AS a, lower(trim(candidate_b)) AS b,
        coalesce(nullif(lower(trim(winner)), ''), lower(trim(ranking[1]))) AS w FROM pairwise_observations),
      v AS (SELECT obs_id, min((a, b, w)) AS v FROM c WHERE obs_id IS NOT NULL AND a <> b AND a <> '' AND b <> '' AND w IN (a, b) GROUP BY obs_id),
      won AS (SELECT v[3] AS i, CASE WHEN v[3] = v[1] THEN v[2] ELSE v[1] END AS j, count(*) AS n FROM v GROUP BY ALL),
      sys AS (SELECT DISTINCT i AS x FROM won UNION SELECT DISTINCT j FROM won),
      cell AS (SELECT p.x AS i, q.x AS j, coalesce(w.n, 0) AS n, coalesce(l.n, 0) AS m FROM sys p CROSS JOIN sys q
        LEFT JOIN won w ON w.i = p.x AND w.j = q.x LEFT JOIN won l ON l.i = q.x AND l.j = p.x),
"""

ORACLE: dict[str, str] = {
    "p2_found": f"{_rounds_sql()} SELECT sample_id, label FROM best",
    "p2_consensus": f"""{_rounds_sql()}, {_FIRST} SELECT sample_id, label, round(top[1] - top[2], 4) AS margin, (SELECT sum(c)::BIGINT FROM first f WHERE f.sample_id = best.sample_id) AS n_votes,
      round(same / (t * (t - 1)), 6) AS agreement, round(1 - (1 - same / (t * (t - 1))) / e, 6) AS alpha FROM best LEFT JOIN per USING (sample_id) CROSS JOIN exp""",
    "p2_agreement": f"""{_BALLOTS}, {_FIRST} SELECT count(*) AS n_samples, sum(t)::BIGINT AS n_votes, round(sum(t - same / (t - 1)) / sum(t), 6) AS observed, round(any_value(e), 6) AS expected,
      round(1 - sum(t - same / (t - 1)) / sum(t) / any_value(e), 6) AS alpha FROM per CROSS JOIN exp""",
    "p2_reliability": f"""{_rounds_sql()} SELECT judge, sum(c)::BIGINT AS n_votes, round(any_value(a)[2], 6) AS accuracy, round((any_value(a)[2] - 1 / {consensus.K}) / (1 - 1 / {consensus.K}), 6) AS kappa
      FROM counted JOIN r10 USING (judge) GROUP BY judge""",
    "p3_found": f"""WITH v AS (SELECT DISTINCT 'documents' AS tab, doc_id AS k, text AS raw, {_form_sql('text')} AS form FROM documents WHERE text IS NOT NULL
      UNION ALL SELECT DISTINCT 'ec_400_with_candidates', sample_id, source_text, {_form_sql('source_text')} FROM ec_400_with_candidates WHERE source_text IS NOT NULL)
      SELECT DISTINCT a.tab AS tab, a.k AS key_a, b.k AS key_b FROM v a JOIN v b ON a.tab = b.tab AND a.form = b.form AND a.k < b.k AND a.raw <> b.raw""",
    "p3_forms": f"""WITH v AS (SELECT DISTINCT 'documents' AS tab, doc_id AS k, {_mapped_sql('text')} AS m FROM documents WHERE text IS NOT NULL
      UNION SELECT DISTINCT 'ec_400_with_candidates', sample_id, {_mapped_sql('source_text')} FROM ec_400_with_candidates WHERE source_text IS NOT NULL)
      SELECT DISTINCT tab, k, min((length(m), k)) OVER (PARTITION BY tab, nfc_normalize(m))[2] AS canonical_key, nfc_normalize(m) AS form FROM v WHERE k IS NOT NULL""",
    # every pair of texts that share a run, so fit for small tables only
    "p5_found": f"""{_LINKED} SELECT DISTINCT a AS doc_a, b AS doc_b FROM reach WHERE a < b""",
    # texts without letters or digits have no links, those of one form are one group
    "p5_groups": f"""{_LINKED}, near AS (SELECT doc_id, least(doc_id, coalesce(min(b), doc_id)) AS group_id FROM f LEFT JOIN reach ON a = doc_id WHERE t <> '' GROUP BY doc_id),
      blank AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY form) AS group_id FROM f WHERE t = ''),
      degree AS (SELECT e.a AS doc_id, count(DISTINCT y.t) AS n FROM edge e JOIN f x ON x.doc_id = e.a JOIN f y ON y.doc_id = e.b WHERE x.t <> y.t GROUP BY e.a)
      SELECT doc_id, group_id, coalesce(n, 0) AS n_links FROM (SELECT * FROM near UNION ALL SELECT * FROM blank) LEFT JOIN degree USING (doc_id)""",
    "p8_found": f"""WITH d AS (SELECT doc_id, {_letters_sql('text')} AS t FROM documents WHERE text IS NOT NULL),
      i AS (SELECT item_id, {_letters_sql('text')} AS t FROM held_out_items WHERE text IS NOT NULL),
      h AS (SELECT item_id, t, (length(t) + 1) // 2 AS k FROM i WHERE t <> ''),
      run AS (SELECT item_id, unnest(list_transform(generate_series(1, length(t) - k + 1), lambda p: substr(t, p, k))) AS x FROM h)
      SELECT DISTINCT doc_id, item_id FROM d JOIN run ON contains(d.t, run.x)""",
    # the most likely strengths of the same smoothed counts, by a minorising iteration instead of scaling
    "p4_found": f"""{_WON}      line AS (SELECT i, sum(CASE WHEN n + m > 0 THEN n + {ranking.SMOOTHING} ELSE 0 END)::DOUBLE AS wins,
        list((CASE WHEN n + m > 0 THEN n + m + 2 * {ranking.SMOOTHING} ELSE 0 END)::DOUBLE ORDER BY j) AS met FROM cell GROUP BY i),
      whole AS (SELECT list(i ORDER BY i) AS names, list(wins ORDER BY i) AS w, list(met ORDER BY i) AS met, count(*)::INT AS n FROM line),
      it AS (SELECT 0 AS k, list_transform(w, lambda x: 1.0::DOUBLE) AS s FROM whole
        UNION ALL SELECT k + 1, list_transform(range(1, n + 1), lambda p: w[p] / list_sum(list_transform(range(1, n + 1), lambda q: met[p][q] / (s[p] + s[q])))) FROM it, whole WHERE k < 1500),
      last AS (SELECT unnest(names) AS x, ln(unnest(s)) AS s FROM it, whole WHERE k = 1500)
      SELECT a.x AS system_a, b.x AS system_b, CASE WHEN a.s > b.s THEN a.x ELSE b.x END AS stronger FROM last a JOIN last b ON a.x < b.x AND abs(a.s - b.s) > 0.75""",
    # the scaling itself, without relaxation
    "p4_ranking": f"""{_WON}
      full_cell AS (SELECT i, j, (CASE WHEN n + m > 0 THEN n + {ranking.SMOOTHING} ELSE 0 END)::DOUBLE AS v FROM cell),
      tie AS (SELECT sum(v) / count(DISTINCT i) AS t FROM full_cell),
      by_row AS (SELECT i, list(CASE WHEN i = j THEN t ELSE v END ORDER BY j) AS r FROM full_cell, tie GROUP BY i),
      by_col AS (SELECT j, list(CASE WHEN i = j THEN t ELSE v END ORDER BY i) AS c FROM full_cell, tie GROUP BY j),
      whole AS (SELECT (SELECT list(i ORDER BY i) FROM by_row) AS names, (SELECT list(r ORDER BY i) FROM by_row) AS rows, (SELECT list(c ORDER BY j) FROM by_col) AS cols, (SELECT count(*)::INT FROM by_row) AS n),
      it AS (SELECT 0 AS k, list_transform(names, lambda x: 1.0::DOUBLE) AS o, list_transform(names, lambda x: 1.0::DOUBLE) AS d FROM whole
        UNION ALL SELECT k + 1, o2, list_transform(range(1, n + 1), lambda q: list_sum(list_transform(range(1, n + 1), lambda p: cols[q][p] / o2[p])))
        FROM (SELECT k, n, cols, list_transform(range(1, n + 1), lambda p: list_sum(list_transform(range(1, n + 1), lambda q: rows[p][q] / d[q]))) AS o2 FROM it, whole WHERE k < 1000)),
      raw AS (SELECT unnest(names) AS x, unnest(list_transform(range(1, n + 1), lambda p: ln(o[p] / d[p]))) AS s FROM it, whole WHERE k = 1000),
      last AS (SELECT x, round(s - (SELECT avg(s) FROM raw), 6) AS s FROM raw),
      met AS (SELECT x, sum(n)::BIGINT AS n FROM (SELECT i AS x, n FROM won UNION ALL SELECT j, n FROM won) GROUP BY x)
      SELECT row_number() OVER (ORDER BY s DESC, x) AS place, x AS system, s AS log_strength, round(exp(s), 6) AS strength, n AS decided FROM last JOIN met USING (x)""",
}
