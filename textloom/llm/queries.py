"""The queries opN_<name> and pipeline, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontamination, fill_middle, language_id, licenses, line_dedup, ngram_join, packing, phrases, quality_model, quality_rules, toxicity, url_filters, warc
from textloom.llm._shared import fresh_path
from textloom.runtime import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


_OP8_STOP = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
_OP8_SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (SELECT doc_id, unnest(range(1, greatest(len(ws) - 1, 1))) AS i, ws FROM w WHERE len(ws) >= 3),
h AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM g),
r AS (SELECT doc_id, i FROM h QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
s AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(len(list_filter(ws, lambda x: x IN ({_OP8_STOP}))) AS BIGINT) AS n_stop_words,
         CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_exclamations
  FROM w LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words
         AND 100 * word_chars >= 200 * n_words AND 100 * word_chars <= 1400 * n_words
         AND 100 * n_symbols <= 20 * n_words AND 100 * n_exclamations <= 30 * n_words
         AND 100 * n_stop_words >= 2 * n_words AND 100 * n_dup_lines <= 50 * n_lines AS kept,
       n_lines, n_stop_words, n_exclamations
FROM s
"""

def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_model.score(docs, quality_model.fit(docs, _table(spark, sf_dir, "labels")))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write(warc.plan(_table(spark, sf_dir, "pages")), path)
    return warc.resolve(warc.read(spark, path))


_OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
o AS (SELECT payload_digest, min(page_id) AS original FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN original <> page_id THEN original END AS refers_to
FROM d LEFT JOIN o USING (payload_digest)
"""


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"), licenses.TEMPLATES + licenses.whole_texts())


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"))


# All pairs that share a shingle, and everything reachable by links.
_OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * m >= 75 * (na + nb - m)),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT r.doc_id, g.b FROM reach r JOIN g ON r.c = g.a),
k AS (SELECT a AS doc_id, count(*) AS n_links FROM g GROUP BY a)
SELECT s.doc_id, CAST(len(any_value(sh)) AS BIGINT) AS n_shingles, min(c) AS component_id, CAST(coalesce(any_value(n_links), 0) AS BIGINT) AS n_links
FROM s JOIN reach USING (doc_id) LEFT JOIN k ON s.doc_id = k.doc_id GROUP BY s.doc_id
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.clean(_table(spark, sf_dir, "documents").select("doc_id", "text"))


# The tree in SQL: nodes by token count and two leading tokens, tokens that five documents have at their place in the
# node (v = 1), or a fifth of its documents, too (v = 2); whole lines are v = 0.
_OP2_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(regexp_replace(regexp_replace(text, '[ \t\x0B\f\r]+', ' ', 'g'), '[^ \n]*[0-9@][^ \n]*', '<*>', 'g'), chr(10)) AS ls FROM documents),
u AS (SELECT text, min(doc_id) AS rep, any_value(ls) AS ls FROM d WHERE doc_id IS NOT NULL GROUP BY text),
l AS (SELECT rep, i, w, len(w) AS n FROM (SELECT rep, unnest(range(0, len(ls))) AS i, unnest(list_transform(ls, lambda x: string_split(trim(x, ' '), ' '))) AS w FROM u) WHERE len(w) >= 3),
c AS (SELECT n, w[1] AS a, w[2] AS b, count(DISTINCT rep) AS docs FROM l GROUP BY ALL HAVING count(DISTINCT rep) >= 5),
o AS (SELECT rep, i, w, l.n, a, b, docs FROM l JOIN c ON l.n = c.n AND w[1] = a AND w[2] = b),
t AS (SELECT rep, i, n, a, b, docs, unnest(w) AS x, unnest(range(1, n + 1)) AS p FROM o),
s AS (SELECT n, a, b, p, x, count(DISTINCT rep) AS k FROM t GROUP BY ALL),
m AS (
  SELECT rep, i, n, unnest([1, 2]) AS v, unnest([list(k >= 5 ORDER BY p), list(k >= 5 AND k >= 0.2 * docs ORDER BY p)]) AS fixed, list(x ORDER BY p) AS w
  FROM t JOIN s USING (n, a, b, p, x) GROUP BY rep, i, n),
f AS (
  SELECT rep, i, n, v, array_to_string(list_transform(w, lambda y, j: CASE WHEN fixed[j] THEN y ELSE '<*>' END), ' ') AS key,
         len(list_filter(w, lambda y: length(y) > 1)) AS words, len(list_filter(w, lambda y, j: length(y) > 1 AND fixed[j])) AS fixed_words FROM m),
k AS (
  SELECT rep, i, n, 0 AS v, array_to_string(w, ' ') AS key FROM l UNION ALL
  SELECT rep, i, n, v, key FROM f WHERE fixed_words >= 3 AND 2 * fixed_words >= words),
r AS (SELECT n, v, key, min(rep) AS first FROM k GROUP BY n, v, key HAVING count(DISTINCT rep) >= CASE WHEN v = 0 AND n >= 20 THEN 2 ELSE 5 END),
x AS (SELECT rep, list(DISTINCT i) AS dropped FROM k JOIN r USING (n, v, key) WHERE rep <> first GROUP BY rep)
SELECT doc_id,
       CASE WHEN dropped IS NULL THEN d.text
            ELSE coalesce(array_to_string(list_transform(list_filter(range(0, len(d.ls)), lambda j: NOT list_contains(dropped, j)), lambda j: string_split(d.text, chr(10))[j + 1]), chr(10)), '') END AS text,
       CAST(coalesce(len(d.ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(dropped), 0) AS BIGINT) AS n_dropped
FROM d LEFT JOIN u ON d.text = u.text AND d.doc_id IS NOT NULL LEFT JOIN x ON u.rep = x.rep
"""


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(_table(spark, sf_dir, "pages"))


_OP10_SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                            ('block', 'net', '/es/'), ('block', 'net', '/fr/')) AS v(verdict, rh, rp)),
m AS (
  SELECT page_id, rh || rp AS rule, verdict FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rh) + length(rp) DESC, length(rh) DESC) = 1)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN m USING (page_id)
"""


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(_table(spark, sf_dir, "documents"))


# All runs of words, counted; HUGEINT for the scores' products.
_OP11_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
s AS (SELECT lang, w, len(w) AS m, unnest(range(1, len(w) + 1)) AS i FROM p),
k AS (SELECT lang, array_to_string(w[i:i + z - 1], ' ') AS phrase, z FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS z FROM s) WHERE i + z - 1 <= m),
f AS (SELECT lang, phrase, any_value(z) AS z, count(*) AS a FROM k GROUP BY lang, phrase HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
c AS (SELECT lang, phrase, a, z, string_split(phrase, ' ') AS w, unnest(range(1, z)) AS q FROM f WHERE z >= 2),
x AS (
  SELECT c.lang, c.phrase, c.a, c.z, q, l.a AS l, r.a AS r, CAST(n.n AS BIGINT) AS n, CAST((1000::HUGEINT * c.a * n.n) // (l.a::HUGEINT * r.a) AS BIGINT) AS score
  FROM c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:q], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[q + 1:], ' ') JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, q) = 1),
o AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.lang = b.lang AND g.z > b.z AND 100 * g.a >= 100 * b.a AND contains(' ' || g.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.transform(_table(spark, sf_dir, "documents"))
    output, restored = F.col("output"), fill_middle.restore(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(output.cast("binary"), 256).alias("output_sha256"), F.sha2(restored.cast("binary"), 256).alias("restored_sha256"))


_OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || CAST(doc_id AS VARCHAR)) AS x FROM documents),
h AS (
  SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2,
         CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN doc_id IS NULL OR t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
o AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || t[1:a] || '<S>' || t[b + 1:] || '<M>' || t[a + 1:b] ELSE '<S>' || t[b + 1:] || '<P>' || t[1:a] || '<M>' || t[a + 1:b] END AS output FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars, sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM o
"""


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_line_dedup": op2_line_dedup,
    "op10_url_filters": op10_url_filters,
    "op3_toxicity": op3_toxicity,
    "op9_quality_classifier": op9_quality_classifier,
    "op4_warc": op4_warc,
    "op5_license_scans": op5_license_scans,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_quality_rules": op8_quality_rules,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_language_id": op13_language_id,
}
ORACLE_SQL = {"op11_phrase_collocations": _OP11_SQL, "op12_fill_in_middle": _OP12_SQL, "op1_ngram_jaccard_join": _OP1_SQL, "op4_warc": _OP4_SQL, "op2_line_dedup": _OP2_SQL, "op8_quality_rules": _OP8_SQL, "op10_url_filters": _OP10_SQL}
