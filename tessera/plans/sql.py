"""DuckDB SQL for the queries: the same results from the same tables."""

from __future__ import annotations

from tessera.functions.fixed import STOP_WORDS

_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def _clean(x: str) -> str:
    return f"coalesce(trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')), '')"


def _words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


#: Entities of the documents and their normalised columns.
NORM = f"""
WITH ent AS (
  SELECT 'D' || doc_id AS entity_id, substr(split_part(text, chr(10), 1), 1, 60) AS business_name, substr(text, 61, 80) AS business_address, lang AS country,
    CASE WHEN doc_id % 5 = 0 THEN 1 WHEN doc_id % 5 <= 2 THEN 2 ELSE 3 END AS src, doc_id AS ord, {_clean('text')} AS clean FROM documents),
n1 AS (SELECT *, {_clean('business_name')} AS name_basic, {_clean('business_address')} AS address_basic, coalesce(trim(lower(country)), '') AS country_normalized,
    regexp_extract_all(coalesce(business_name, '') || ' ' || coalesce(business_address, ''), '(\\p{{Nd}}+)', 1) AS numeric_tokens FROM ent),
n2 AS (SELECT *, {_words('name_basic')} AS all_tokens, {_words('address_basic')} AS address_tokens FROM n1),
n3 AS (SELECT *, CASE WHEN len(list_filter(all_tokens, lambda t: NOT list_contains({_STOP}, t))) = 0 THEN all_tokens
    ELSE list_filter(all_tokens, lambda t: NOT list_contains({_STOP}, t)) END AS name_tokens FROM n2),
n AS (SELECT *, array_to_string(name_tokens, ' ') AS name_core, array_to_string(list_transform(name_tokens, lambda t: substr(t, 1, 1)), '') AS name_acronym FROM n3),
truth AS (SELECT a.entity_id AS s1_id, b.entity_id AS c_id FROM ent a JOIN ent b ON a.clean = b.clean WHERE a.src = 1 AND b.src > 1),
keys AS (
  SELECT entity_id, src, ord, country_normalized AS country, 'exact' AS key_type, name_basic AS key FROM n
  UNION ALL SELECT entity_id, src, ord, country_normalized, 'acr', name_acronym FROM n WHERE length(name_acronym) >= 2
  UNION ALL SELECT entity_id, src, ord, country_normalized, 'tok', unnest(name_tokens) FROM n
  UNION ALL SELECT * FROM (SELECT entity_id, src, ord, country_normalized, 'num', unnest(numeric_tokens) AS k FROM n) WHERE length(k) >= 3
  UNION ALL SELECT entity_id, src, ord, country_normalized, 'pfx', substr(name_core, 1, 5) FROM n WHERE length(name_core) >= 5)"""


def _block(kind: str) -> str:
    rare = {"tok": 100, "num": 500}.get(kind)
    keep = f"AND (SELECT count(*) FROM keys k WHERE k.src > 1 AND k.key_type = '{kind}' AND k.country = b.country AND k.key = b.key) <= {rare}" if rare else ""
    return f"{NORM} SELECT DISTINCT a.entity_id AS s1_id, b.entity_id AS c_id FROM keys a JOIN keys b ON a.country = b.country AND a.key = b.key AND b.key_type = '{kind}' AND b.src > 1 {keep} WHERE a.src = 1 AND a.key_type = '{kind}'"


STRUCTURAL = """, cnt AS (SELECT country, key_type, key, count(*) AS n FROM keys WHERE src > 1 GROUP BY ALL),
idx AS (SELECT * FROM (SELECT k.*, row_number() OVER (PARTITION BY k.country, k.key_type, k.key ORDER BY src, ord) AS rn FROM keys k JOIN cnt USING (country, key_type, key)
  WHERE src > 1 AND key_type <> 'exact' AND (key_type NOT IN ('tok', 'num') OR n <= CASE key_type WHEN 'tok' THEN 100 ELSE 500 END)) WHERE rn <= 200),
found AS (SELECT DISTINCT a.entity_id AS s1_id, b.entity_id AS c_id FROM keys a JOIN idx b USING (country, key_type, key) WHERE a.src = 1 AND country <> '')"""

STREAMED = """, place AS (SELECT DISTINCT country_normalized AS country FROM n WHERE src = 1 AND country_normalized <> ''),
run AS (SELECT *, sum(n) OVER (PARTITION BY country, key ORDER BY src, ord ROWS UNBOUNDED PRECEDING) AS seen
  FROM (SELECT entity_id, src, ord, country, key, count(*) AS n FROM keys WHERE src > 1 AND key_type = 'tok' GROUP BY ALL)),
idx AS (SELECT entity_id, key_type, key FROM keys JOIN place USING (country) WHERE src > 1 AND key_type IN ('acr', 'num', 'pfx') UNION ALL SELECT entity_id, 'tok', key FROM run JOIN place USING (country) WHERE seen <= 500),
found AS (SELECT DISTINCT a.entity_id AS s1_id, b.entity_id AS c_id FROM keys a JOIN idx b USING (key_type, key) WHERE a.src = 1)"""

ARRIVAL = """, tokn AS (SELECT key, count(*) AS n FROM keys WHERE src = 1 AND key_type = 'tok' GROUP BY key),
q0 AS (SELECT k.* FROM keys k LEFT JOIN tokn ON k.key = tokn.key AND k.key_type = 'tok' WHERE src = 1 AND country <> '' AND (key_type IN ('exact', 'acr') OR (key_type = 'tok' AND n <= 50))),
q AS (SELECT * FROM q0 WHERE (country, key_type, key) IN (SELECT (country, key_type, key) FROM q0 GROUP BY country, key_type, key HAVING count(DISTINCT entity_id) <= 200)),
hits AS (SELECT DISTINCT q.entity_id AS s1_id, b.entity_id AS c_id, b.src, b.ord FROM q JOIN keys b USING (country, key_type, key) WHERE b.src > 1),
found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY src, ord) AS rank FROM hits) WHERE rank <= 50)"""


def _grams(kind: str) -> str:
    text = "name_basic || ' ' || address_basic"
    if kind == "char":
        one = """list_concat(list_transform(range(1, length(w) + 1), lambda i: substr(' ' || w || ' ', i, 3)),
          CASE WHEN length(w) > 1 THEN list_transform(range(1, length(w)), lambda i: substr(' ' || w || ' ', i, 4)) ELSE [] END)"""
        return f"SELECT entity_id, src, country_normalized AS country, unnest({one}) AS gram FROM (SELECT entity_id, src, country_normalized, unnest({_words(text)}) AS w FROM n)"
    return f"""SELECT entity_id, src, country_normalized AS country, unnest(list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END)) AS gram
      FROM (SELECT entity_id, src, country_normalized, list_filter(string_split({text}, ' '), lambda t: length(t) >= 2) AS w FROM n)"""


def cosine(kind: str) -> str:
    """Tables g_, w_ and s_ of one kind of gram: counts, unit weights, scores."""
    return f""", {kind}_g AS (SELECT entity_id, src, country, gram, count(*) AS tf FROM ({_grams(kind)}) GROUP BY ALL),
{kind}_w AS (SELECT entity_id, src, country, gram, tf / sqrt(sum(tf * tf) OVER (PARTITION BY entity_id)) AS w FROM {kind}_g),
{kind}_s AS (SELECT a.entity_id AS s1_id, b.entity_id AS c_id, round(sum(a.w * b.w), 9) AS score FROM {kind}_w a JOIN {kind}_w b USING (country, gram) WHERE a.src = 1 AND b.src > 1 AND country <> '' GROUP BY ALL)"""


def ranked(source: str, k: int, keep: str = "s1_id, c_id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank", by: str = "s1_id", item: str = "c_id") -> str:
    return f"SELECT {keep} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, {item}) AS rank FROM {source}) WHERE rank <= {k}"


def _f05(tp: str, t: str, p: str) -> str:
    return f"CASE WHEN {t} = 0 AND {p} = 0 THEN 1.0 WHEN {t} = 0 OR {p} = 0 OR {tp} = 0 THEN 0.0 ELSE 1.25 * ({tp} / {p}) * ({tp} / {t}) / (0.25 * {tp} / {p} + {tp} / {t}) END"


def _jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END"


EXACT = """, b0 AS (SELECT a.entity_id AS s1_id, list(b.entity_id ORDER BY b.src, b.ord) FILTER (b.entity_id IS NOT NULL) AS c_ids, any_value(a.ord) AS ord
  FROM {ent} a LEFT JOIN {ent} b ON trim(lower(a.business_name)) = trim(lower(b.business_name)) AND trim(lower(a.country)) = trim(lower(b.country)) AND b.src > 1 {more} WHERE a.src = 1 GROUP BY a.entity_id)"""
#: Deterministic scores of exact pairs for the metric queries: word overlap.
SCORED = f""", ex AS (SELECT DISTINCT a.entity_id AS s1_id, b.entity_id AS c_id FROM n a JOIN n b ON a.country_normalized = b.country_normalized AND a.name_basic = b.name_basic WHERE a.src = 1 AND b.src > 1),
sc AS (SELECT ex.s1_id, ex.c_id, round({_jaccard('a.address_tokens', 'b.address_tokens')}, 6) AS score, {_jaccard('a.name_tokens', 'b.name_tokens')} AS name_jaccard,
  a.numeric_tokens AS qn, b.numeric_tokens AS xn FROM ex JOIN n a ON a.entity_id = ex.s1_id JOIN n b ON b.entity_id = ex.c_id)"""


def _runs(key: str, name: str, source: str) -> str:
    return f"SELECT DISTINCT {key} AS {name}, unnest(list_transform(range(1, len(w) - 8), lambda i: md5(array_to_string(list_slice(w, i, i + 9), ' ')))) AS run FROM (SELECT {key}, string_split(coalesce(text, ''), ' ') AS w FROM {source}) WHERE len(w) >= 10"


def _lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence of two texts, row by row of its table."""
    row = f"list_reduce(range(1, length({b}) + 1), lambda r, j: list_append(r, greatest(r[j], p[j + 1], CASE WHEN substr({b}, j, 1) = c[1] THEN p[j] + 1 ELSE 0 END)), [0])"
    return f"list_reduce(list_transform(range(1, length({a}) + 1), lambda i: [substr({a}, i, 1)]), lambda p, c: {row}, list_transform(range(0, length({b}) + 1), lambda i: 0))[length({b}) + 1]"


BM25 = f"""WITH w AS (SELECT doc_id AS d_id, {_words(_clean('text'))} AS t FROM documents),
p AS (SELECT d_id, len(t) AS dl, unnest(t) AS term FROM w), tf AS (SELECT term, d_id, dl, count(*) AS tf FROM p GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM w),
raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, st GROUP BY term, n),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qs AS (SELECT item_id AS q_id, unnest({_words(_clean('text'))}) AS term FROM benchmark),
s AS (SELECT q_id, d_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))), 9) AS score FROM qs JOIN tf USING (term) JOIN idf USING (term), st GROUP BY q_id, d_id)"""
DENSE = """WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
v AS (SELECT vec_id, label, CASE WHEN list_dot_product(e, e) > 0 THEN list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) ELSE e END AS e FROM u),
s AS (SELECT a.vec_id AS q_id, b.vec_id AS c_id, a.label AS ql, b.label AS xl, round(list_dot_product(a.e, b.e), 9) AS score FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)"""
_RANKED_CHAR = NORM + cosine("char") + ", r AS (" + ranked("char_s", 100, "s1_id, c_id, rank") + ")"


ORACLES = {
    "normalize_entities": f"{NORM} SELECT entity_id, name_basic, name_core, array_to_string(name_tokens, ' ') AS name_tokens, name_acronym, address_basic, array_to_string(numeric_tokens, ' ') AS numeric_tokens, country_normalized FROM n",
    "numeric_tokens": "SELECT c_custkey, array_to_string(regexp_extract_all(c_name, '(\\p{Nd}+)', 1), ' ') AS numbers FROM customer",
    "profile_rowcounts": f"{NORM} SELECT CAST(src AS INTEGER) AS src, count(*) AS n FROM ent GROUP BY src",
    "profile_missing": f"{NORM} SELECT CAST(src AS INTEGER) AS src, c AS \"column\", CAST(sum(CASE WHEN v = '' THEN 1 ELSE 0 END) AS BIGINT) AS n_missing FROM (SELECT src, unnest(['business_name', 'business_address', 'country']) AS c, unnest([business_name, business_address, country]) AS v FROM ent) GROUP BY src, c",
    "country_value_counts": f"{NORM} SELECT CAST(src AS INTEGER) AS src, country, count(*) AS n FROM ent GROUP BY src, country",
    "match_count_stats": f"""{NORM}, l AS (SELECT e.entity_id, count(c_id) AS k FROM ent e LEFT JOIN truth ON e.entity_id = s1_id WHERE src = 1 GROUP BY 1)
      SELECT count(*) AS n_entities, count(*) FILTER (k = 0) AS singletons, count(*) FILTER (k = 1) AS one_to_one, count(*) FILTER (k > 1) AS one_to_many, CAST(max(k) AS INTEGER) AS most,
      round(100.0 * count(*) FILTER (k = 0) / count(*), 6) AS pct_singletons, round(100.0 * count(*) FILTER (k > 1) / count(*), 6) AS pct_one_to_many FROM l""",
    "truth_pairs": f"{NORM} SELECT s1_id, c_id FROM truth",
    "label_pairs": f"{NORM}{SCORED} SELECT ex.s1_id, ex.c_id, CASE WHEN t.c_id IS NULL THEN 0 ELSE 1 END AS label FROM ex LEFT JOIN (SELECT DISTINCT * FROM truth) t ON ex.s1_id = t.s1_id AND ex.c_id = t.c_id",
    "hash_split_counts": f"{NORM} SELECT CAST('0x' || substr(md5(entity_id || ':42'), 1, 8) AS BIGINT) % 100 < 20 AS held, count(*) AS n FROM ent WHERE src = 1 GROUP BY 1",
    "random_negatives": f"""{NORM}, m AS (SELECT greatest(count(*), 1) AS k FROM ent WHERE src = 1), q AS (SELECT entity_id AS s1_id, CAST('0x' || substr(md5(entity_id || ':42'), 1, 8) AS BIGINT) % k AS slot FROM ent, m WHERE src = 1),
      x AS (SELECT CAST('0x' || substr(md5(entity_id || ':43'), 1, 8) AS BIGINT) % k AS slot, min(entity_id) AS c_id FROM ent, m WHERE src > 1 GROUP BY 1)
      SELECT s1_id, c_id FROM q JOIN x USING (slot) WHERE (s1_id, c_id) NOT IN (SELECT (s1_id, c_id) FROM truth)""",
    "hash_sample": f"{NORM} SELECT entity_id FROM ent WHERE src = 1 ORDER BY md5(entity_id || ':42'), entity_id LIMIT 100",
    "source_round_trip": f"{NORM} SELECT entity_id, coalesce(business_name, '') AS business_name FROM ent WHERE country = 'de'",
    "truth_file": f"{NORM} SELECT entity_id AS s1_id, coalesce(string_agg(DISTINCT c_id, ',' ORDER BY c_id), '') AS matched FROM ent LEFT JOIN truth ON entity_id = s1_id WHERE src = 1 GROUP BY entity_id",
    "truth_sample": f"{NORM} SELECT entity_id AS s1_id, coalesce(string_agg(DISTINCT c_id, ',' ORDER BY c_id), '') AS matched FROM ent LEFT JOIN truth ON entity_id = s1_id WHERE src = 1 GROUP BY entity_id ORDER BY md5(entity_id || ':42'), entity_id LIMIT 50",
    "candidate_file": NORM + EXACT.format(ent="ent", more="") + " SELECT s1_id, coalesce(array_to_string(c_ids, ','), '') AS candidates FROM b0 ORDER BY ord LIMIT 60",
    "appended_results": NORM + EXACT.format(ent="ent", more="") + " SELECT s1_id, coalesce(array_to_string(c_ids, ','), '') AS matched FROM b0",
    "normalized_table": f"{NORM} SELECT entity_id, name_core, array_to_string(numeric_tokens, ' ') AS numeric_tokens FROM n WHERE src = 1 AND country_normalized = 'de'",
    "report_file": f"{NORM} SELECT CAST(src AS INTEGER) AS src, count(*) AS n FROM ent GROUP BY src",
    "retriever_texts": f"{NORM} SELECT entity_id, name_basic || ' ' || address_basic || ' ' || array_to_string(numeric_tokens, ' ') || ' ' || country_normalized AS lexical, name_basic || ' ' || address_basic || ' ' || country_normalized AS dense FROM n",
    "inverted_index": f"{NORM} SELECT country, key_type, key, string_agg(entity_id, ',' ORDER BY src, ord) AS entity_ids FROM (SELECT DISTINCT country, key_type, key, entity_id, src, ord FROM keys WHERE src > 1 AND key_type IN ('acr', 'pfx')) GROUP BY ALL",
    "run_counters": NORM + EXACT.format(ent="ent", more="") + SCORED + """ SELECT unnest(['entities', 'with_match', 'singletons', 'matches', 'pairs_scored']) AS metric,
      unnest([count(*), count(*) FILTER (len(c_ids) > 0), count(*) FILTER (coalesce(len(c_ids), 0) = 0), coalesce(CAST(sum(len(c_ids)) AS BIGINT), 0), (SELECT count(*) FROM ex)]) AS value FROM b0""",
    "validate_file": NORM + EXACT.format(ent="ent", more="") + """ SELECT unnest(['missing_file', 'wrong_columns', 'index_column', 'row_count_difference', 'repeated_ids', 'missing_ids', 'extra_ids', 'matched', 'singletons']) AS name,
      unnest(['error', 'error', 'error', 'error', 'error', 'error', 'warning', 'info', 'info']) AS severity, unnest([0, 0, 0, 0, 0, 0, 0, count(*) FILTER (len(c_ids) > 0), count(*) FILTER (coalesce(len(c_ids), 0) = 0)]) AS n FROM b0""",
    "sample_matches": NORM + EXACT.format(ent="ent", more="") + " SELECT s1_id, substr(array_to_string(c_ids, ','), 1, 60) AS matched FROM b0 WHERE len(c_ids) > 0 ORDER BY s1_id LIMIT 3",
    "stream_running_frequency": f"{NORM}{STREAMED} SELECT country, key, entity_id AS c_id FROM run WHERE seen <= 500",
    "stream_best_scores": f"{NORM}{SCORED} SELECT s1_id, c_id, score FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, c_id) AS rn FROM sc) WHERE rn <= 200",
    "bm25_entities": NORM + """, w AS (SELECT entity_id AS d_id, src, """ + _words(_clean("name_basic || ' ' || address_basic || ' ' || array_to_string(numeric_tokens, ' ') || ' ' || country_normalized")) + """ AS t FROM n),
      p AS (SELECT d_id, len(t) AS dl, unnest(t) AS term FROM w WHERE src > 1), tf AS (SELECT term, d_id, dl, count(*) AS tf FROM p GROUP BY ALL),
      st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM w WHERE src > 1),
      raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, st GROUP BY term, n),
      idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
      qs AS (SELECT d_id AS q_id, unnest(t) AS term FROM w WHERE src = 1),
      s0 AS (SELECT q_id, d_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))), 9) AS score FROM qs JOIN tf USING (term) JOIN idf USING (term), st GROUP BY q_id, d_id),
      s AS (SELECT a.d_id AS q_id, b.d_id, coalesce(score, 0.0) AS score FROM w a CROSS JOIN w b LEFT JOIN s0 ON s0.q_id = a.d_id AND s0.d_id = b.d_id WHERE a.src = 1 AND b.src > 1) """ + ranked("s", 50, "q_id, d_id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank", "q_id", "d_id"),
    "ratio_feature": f"""{NORM}{SCORED}, t AS (SELECT ex.s1_id, ex.c_id, a.address_basic AS a, b.address_basic AS b FROM ex JOIN n a ON a.entity_id = s1_id JOIN n b ON b.entity_id = c_id)
      SELECT s1_id, c_id, round(CASE WHEN a = '' AND b = '' THEN 1.0 WHEN a = '' OR b = '' THEN 0.0 ELSE 2.0 * {_lcs('a', 'b')} / (length(a) + length(b)) END, 6) AS addr_ratio FROM t""",
    "modulo_split_counts": f"{NORM} SELECT (ord // 5) % 5 = 0 AS held, count(*) AS n FROM ent WHERE src = 1 GROUP BY 1",
    "b0_exact_match": NORM + EXACT.format(ent="ent", more="") + " SELECT s1_id, coalesce(array_to_string(c_ids, ','), '') AS matched FROM b0",
    "b0_allow_empty": NORM + ", e2 AS (SELECT * REPLACE (CASE WHEN ord % 10 < 2 THEN '' ELSE business_name END AS business_name) FROM ent)" + EXACT.format(ent="e2", more="") + " SELECT s1_id, coalesce(array_to_string(c_ids, ','), '') AS matched FROM b0",
    "b0_validation": NORM + ", e2 AS (SELECT * REPLACE (CASE WHEN ord % 10 < 2 THEN '' ELSE business_name END AS business_name) FROM ent)" + EXACT.format(ent="e2", more="AND trim(lower(b.business_name)) <> ''") + " SELECT s1_id, coalesce(array_to_string(c_ids, ','), '') AS matched FROM b0",
    **{f"block_{name}": _block(kind) for name, kind in (("exact", "exact"), ("acronym", "acr"), ("rare_token", "tok"), ("prefix5", "pfx"))},
    "block_numeric": "SELECT DISTINCT c_custkey, s_suppkey FROM (SELECT c_custkey, unnest(regexp_extract_all(c_name, '(\\p{Nd}+)', 1)) AS k FROM customer) a JOIN (SELECT s_suppkey, unnest(regexp_extract_all(s_name, '(\\p{Nd}+)', 1)) AS k FROM supplier) b ON a.k = b.k WHERE length(a.k) >= 3",
    "bucket_cap_200": "WITH k AS (SELECT p_partkey, unnest(['brand', 'type']) AS key_type, unnest([p_brand, p_type]) AS key FROM part) SELECT p_partkey, key_type, key FROM (SELECT *, row_number() OVER (PARTITION BY key_type, key ORDER BY p_partkey) AS rn FROM k) WHERE rn <= 200",
    "purge_over_200": "WITH k AS (SELECT p_partkey, unnest(['brand', 'type']) AS key_type, unnest([p_brand, p_type]) AS key FROM part) SELECT p_partkey, key_type, key FROM k WHERE (key_type, key) IN (SELECT (key_type, key) FROM k GROUP BY key_type, key HAVING count(DISTINCT p_partkey) <= 200)",
    "structural_lookup": f"{NORM}{STRUCTURAL} SELECT s1_id, c_id FROM found",
    "structural_running_freq": f"{NORM}{STREAMED} SELECT s1_id, c_id FROM found",
    "b1_candidates_cap50": f"{NORM}{ARRIVAL} SELECT s1_id, c_id, CAST(rank AS INTEGER) AS rank FROM found",
    "stream_b1_candidates": f"{NORM}{ARRIVAL} SELECT s1_id, c_id, CAST(rank AS INTEGER) AS rank FROM found",
    "char_cosine_top50": NORM + cosine("char") + " " + ranked("char_s", 50),
    "word_cosine_top50": NORM + cosine("word") + " " + ranked("word_s", 50),
    "cosine_threshold": NORM + cosine("char") + cosine("word") + " SELECT s1_id, c_id, round(max(score), 5) AS score FROM (SELECT * FROM char_s WHERE score > 0.3 UNION ALL SELECT * FROM word_s WHERE score > 0.2) GROUP BY ALL",
    "merge_retrievers_top100": NORM + cosine("char") + cosine("word") + ", m AS (SELECT s1_id, c_id, max(score) AS score FROM (SELECT s1_id, c_id, score FROM (" + ranked("char_s", 50, "s1_id, c_id, score") + ") UNION ALL SELECT s1_id, c_id, score FROM (" + ranked("word_s", 50, "s1_id, c_id, score") + ")) GROUP BY ALL) " + ranked("m", 100),
    "merge_structural_base": NORM + cosine("word") + STRUCTURAL + ", t AS (" + ranked("word_s", 50, "s1_id, c_id, score") + ") SELECT coalesce(t.s1_id, f.s1_id) AS s1_id, coalesce(t.c_id, f.c_id) AS c_id, round(coalesce(score, 0.1), 5) AS score FROM t FULL JOIN found f ON t.s1_id = f.s1_id AND t.c_id = f.c_id",
    "bm25_top50": BM25 + " " + ranked("s", 50, "q_id, d_id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank", "q_id", "d_id"),
    "bm25_recall": BM25 + f""", r AS ({ranked("s", 50, "q_id, d_id, rank", "q_id", "d_id")}), t AS (SELECT DISTINCT q_id, d_id FROM ({_runs("item_id", "q_id", "benchmark")}) JOIN ({_runs("doc_id", "d_id", "documents")}) USING (run))
      SELECT round(100 * avg(h), 6) AS recall_at_50, count(*) AS n_queries FROM (SELECT t.q_id, count(r.d_id) / count(*) AS h FROM t LEFT JOIN r ON t.q_id = r.q_id AND t.d_id = r.d_id GROUP BY t.q_id)""",
    "dense_top10": DENSE + " " + ranked("s", 10, "q_id, c_id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank", "q_id"),
    "dense_recall": DENSE + f", r AS ({ranked('s', 10, 'q_id, ql, xl', 'q_id')}) SELECT round(100 * avg(CASE WHEN ql = xl THEN 1.0 ELSE 0.0 END), 6) AS same_label, count(*) AS n FROM r",
    "l2_normalize": "SELECT vec_id, round(list_dot_product(e, e) / CASE WHEN list_dot_product(e, e) > 0 THEN list_dot_product(e, e) ELSE 1 END, 6) AS norm, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS first FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)",
    "jaccard_features": f"{NORM}{SCORED} SELECT s1_id, c_id, score AS addr_jaccard, round(name_jaccard, 6) AS name_jaccard FROM sc",
    "numeric_features": f"{NORM}{SCORED} SELECT s1_id, c_id, CAST(len(list_intersect(qn, xn)) AS INTEGER) AS num_overlap, CASE WHEN len(qn) > 0 AND len(xn) > 0 AND len(list_intersect(qn, xn)) = 0 THEN 1 ELSE 0 END AS num_conflict FROM sc",
    "macro_f05": f"""{NORM}{SCORED}, per AS (SELECT e.entity_id, (SELECT count(*) FROM (SELECT DISTINCT c_id FROM truth t WHERE t.s1_id = e.entity_id)) AS t, (SELECT count(*) FROM ex WHERE ex.s1_id = e.entity_id) AS p,
      (SELECT count(*) FROM ex JOIN (SELECT DISTINCT * FROM truth) t ON t.s1_id = ex.s1_id AND t.c_id = ex.c_id WHERE ex.s1_id = e.entity_id) AS tp FROM ent e WHERE src = 1)
      SELECT round(avg({_f05('tp', 't', 'p')}), 6) AS macro_f05, count(*) AS n_entities FROM per""",
    "recall_at_k": f"""{_RANKED_CHAR}, h AS (SELECT t.s1_id, count(*) AS n, count(*) FILTER (rank <= 10) AS h10, count(*) FILTER (rank <= 25) AS h25, count(*) FILTER (rank <= 50) AS h50, count(*) FILTER (rank <= 100) AS h100 FROM (SELECT DISTINCT * FROM truth) t LEFT JOIN r USING (s1_id, c_id) GROUP BY t.s1_id),
      c AS (SELECT e.entity_id, (SELECT count(*) FROM r WHERE r.s1_id = e.entity_id) AS c FROM ent e WHERE src = 1)
      SELECT unnest(['recall@10', 'recall@25', 'recall@50', 'recall@100', 'avg_candidates', 'p95_candidates', 'recall@50_one_to_one', 'recall@50_one_to_many']) AS metric, unnest([round(avg(h10 / n), 6), round(avg(h25 / n), 6), round(avg(h50 / n), 6), round(avg(h100 / n), 6),
        (SELECT round(avg(c), 6) FROM c), (SELECT round(quantile_cont(c, 0.95), 6) FROM c), round(coalesce(avg(h50 / n) FILTER (n = 1), 0), 6), round(coalesce(avg(h50 / n) FILTER (n > 1), 0), 6)]) AS value FROM h""",
    "calibrate_threshold": f"""{NORM}{SCORED}, th AS (SELECT unnest(range(1, 100)) AS h), tt AS (SELECT DISTINCT * FROM truth),
      e AS (SELECT entity_id, (SELECT count(*) FROM tt WHERE s1_id = entity_id) AS t FROM ent WHERE src = 1),
      p AS (SELECT h, sc.s1_id, count(*) AS p, count(tt.c_id) AS tp FROM sc LEFT JOIN tt ON sc.s1_id = tt.s1_id AND sc.c_id = tt.c_id, th WHERE round(score * 100, 7) > h GROUP BY h, sc.s1_id),
      f AS (SELECT th.h, avg({_f05('coalesce(tp, 0)', 't', 'coalesce(p, 0)')}) AS f FROM th CROSS JOIN e LEFT JOIN p ON p.h = th.h AND p.s1_id = e.entity_id GROUP BY th.h)
      SELECT h / 100 AS threshold, round(f, 6) AS macro_f05 FROM f ORDER BY round(f, 9) DESC, h LIMIT 1""",
    "roc_auc": """WITH s AS (SELECT (d.n_chars % 97) / 97.0 AS score, toxic AS label FROM labels l JOIN documents d USING (doc_id)), r AS (SELECT label, score FROM s)
      SELECT round(sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) / count(*), 6) AS auc FROM r a, r b WHERE a.label = 1 AND b.label = 0""",
    "model_topk": f"{NORM}{SCORED} {ranked('sc', 10)}",
    "fuse_scores": f"{NORM}{SCORED} SELECT s1_id, c_id, round(0.3 * score + 0.7 * name_jaccard, 6) AS fused FROM sc",
    "decision": f"{NORM}{SCORED} SELECT s1_id, c_id, score > 0.5 AS strict, score >= 0.45 AS inclusive FROM sc WHERE score >= 0.45",
    "ce_rerank": f"{NORM}{SCORED} SELECT s1_id, c_id, round({_jaccard(_words(chr(97) + '.name_basic || ' + chr(39) + ' ' + chr(39) + ' || a.address_basic'), _words('b.name_basic || ' + chr(39) + ' ' + chr(39) + ' || b.address_basic'))}, 6) AS ce_logit FROM ex JOIN n a ON a.entity_id = s1_id JOIN n b ON b.entity_id = c_id",
    "validate_output": f"""{NORM}{EXACT.format(ent='ent', more='')}, o AS (SELECT s1_id, coalesce(len(c_ids), 0) AS k FROM b0 WHERE ord % 100 <> 0 UNION ALL SELECT s1_id, coalesce(len(c_ids), 0) FROM b0 WHERE ord % 150 = 5 UNION ALL SELECT 'X1', 0)
      SELECT 'row_count_difference' AS name, 'error' AS severity, abs((SELECT count(*) FROM o) - (SELECT count(*) FROM b0)) AS n UNION ALL SELECT 'repeated_ids', 'error', (SELECT count(*) - count(DISTINCT s1_id) FROM o)
      UNION ALL SELECT 'missing_ids', 'error', (SELECT count(*) FROM b0 WHERE s1_id NOT IN (SELECT s1_id FROM o)) UNION ALL SELECT 'extra_ids', 'warning', 1
      UNION ALL SELECT 'matched', 'info', (SELECT count(*) FROM o WHERE k > 0) UNION ALL SELECT 'singletons', 'info', (SELECT count(*) FROM o WHERE k = 0)""",
    "compare_runs": f"""{NORM}{EXACT.format(ent='ent', more='')}, tl AS (SELECT e.entity_id AS s1_id, list(DISTINCT c_id) FILTER (c_id IS NOT NULL) AS c FROM ent e LEFT JOIN truth t ON t.s1_id = e.entity_id WHERE src = 1 GROUP BY 1),
      j AS (SELECT list_sort(coalesce(c_ids, [])) AS a, list_sort(coalesce(c, [])) AS b FROM b0 JOIN tl USING (s1_id)) SELECT count(*) AS n, count(*) FILTER (a = b) AS same, count(*) FILTER (len(a) > 0 AND len(b) = 0) AS lost, count(*) FILTER (len(a) = 0 AND len(b) > 0) AS gained FROM j""",
    "missing_ids_anti": f"{NORM}{SCORED} SELECT entity_id FROM ent WHERE src = 1 AND entity_id NOT IN (SELECT s1_id FROM ex)",
    "needed_ids_semi": f"{NORM}{SCORED} SELECT entity_id, name_basic FROM n WHERE src > 1 AND entity_id IN (SELECT c_id FROM ex)",
    "sample_noise_pool": f"{NORM} SELECT entity_id, entity_id IN (SELECT c_id FROM truth) AS wanted FROM ent WHERE src > 1 AND (entity_id IN (SELECT c_id FROM truth) OR ord % 50 = 1)",
    "candidate_union": f"{NORM}{STRUCTURAL}{ARRIVAL.replace('found AS', 'arr AS').replace(', tokn', ', tokn')} SELECT s1_id, c_id FROM found UNION SELECT s1_id, c_id FROM arr",
    "first_rows": f"{NORM} SELECT entity_id FROM ent WHERE src = 1 AND ord < 100",
}
