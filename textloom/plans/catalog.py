"""The registered queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import evaluation as E
from textloom.operators import graph as G
from textloom.operators import links as L
from textloom.operators import lint as Lint
from textloom.operators import search as S
from textloom.operators import store as St
from textloom.operators.index import Index
from textloom.runtime import _filesystem, shared_dir, ship
from textloom.sources import corpus, parse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


# --- retrieval

TERMS = "the that with de"


def _bm25_sql(terms: list[str], stats_where: str, where: str, n: int) -> str:
    tf = ", ".join(f"CAST(len(list_filter(t, lambda x: x = '{w}')) AS DOUBLE) AS tf{i}" for i, w in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(terms)))
    part = " + ".join(f"CASE WHEN tf{i} > 0 THEN ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * (tf{i} * 2.5) / (tf{i} + 1.5 * (0.25 + 0.75 * dl / av)) ELSE 0 END" for i in range(len(terms)))
    return f"""
WITH t AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents),
c AS (SELECT doc_id, lang, CAST(len(t) AS DOUBLE) AS dl, {tf} FROM t),
s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS av, {df} FROM c WHERE {stats_where}),
r AS (SELECT doc_id, {part} AS sc FROM c, s WHERE {where})
SELECT doc_id, round(sc, 6) AS score, CAST(row_number() OVER (ORDER BY round(sc, 6) DESC, doc_id) AS INTEGER) AS rank
FROM r WHERE sc > 0 ORDER BY rank LIMIT {n}"""


def _bm25_top(docs: DataFrame, terms: str, n: int, **kw) -> DataFrame:
    scored = S.bm25(docs.select("doc_id", "lang", "text"), "text", terms, **kw).select("doc_id", F.round("score", 6).alias("score"))
    return S.top(scored, n, "score", "doc_id")


@query(_bm25_sql(TERMS.split(), "true", "true", 50))
def bm25_top_docs(spark, sf_dir):
    return _bm25_top(table(spark, sf_dir, "documents"), TERMS, 50)


@query(_bm25_sql(["the", "that"], "lang = 'en'", "lang = 'en'", 50))
def bm25_filtered(spark, sf_dir):
    return _bm25_top(table(spark, sf_dir, "documents"), "the that", 50, where=F.col("lang") == "en")


@query(_bm25_sql(["the", "that"], "true", "lang = 'en'", 50))
def bm25_index_scope(spark, sf_dir):
    return _bm25_top(table(spark, sf_dir, "documents"), "the that", 50, where=F.col("lang") == "en", scope="index")


_INDEXES: dict[tuple, Index] = {}


def _index(spark, sf_dir) -> Index:
    """The documents' index in the shared folder: written once an application, as long as the table is the same."""
    docs = table(spark, sf_dir, "documents")
    fs, path = _filesystem(spark, f"{sf_dir}/documents.parquet")
    state = fs.getFileStatus(path)
    key = (spark.sparkContext.applicationId, sf_dir, state.getModificationTime(), fs.getContentSummary(path).getLength())
    if key not in _INDEXES:
        index = Index(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", "doc_id")
        index.update(docs.select("doc_id", "text"))
        _INDEXES[key] = index
    return _INDEXES[key]


@query(_bm25_sql(TERMS.split(), "true", "true", 50))
def bm25_postings(spark, sf_dir):
    return S.top(_index(spark, sf_dir).search(TERMS).select("doc_id", F.round("score", 6).alias("score")), 50, "score", "doc_id")


@query(_bm25_sql(["the", "that"], "true", "lang = 'en'", 50))
def bm25_postings_allowed(spark, sf_dir):
    allowed = table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id")
    return S.top(_index(spark, sf_dir).search("the that", allowed).select("doc_id", F.round("score", 6).alias("score")), 50, "score", "doc_id")


@query(_bm25_sql(["the", "that"], "lang = 'en'", "lang = 'en'", 50))
def bm25_postings_filtered(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    posts, rows = S.postings(docs, ["doc_id"], "text")
    allowed = docs.filter("lang = 'en'").select("doc_id")
    return S.top(S.bm25_postings(posts, rows, ["doc_id"], "the that", allowed).select("doc_id", F.round("score", 6).alias("score")), 50, "score", "doc_id")


@query(_bm25_sql(["the", "that"], "true", "true", 50).replace("FROM documents)", "FROM (SELECT doc_id, lang, CASE WHEN doc_id % 5 = 1 THEN reverse(text) ELSE text END AS text FROM documents WHERE doc_id % 7 <> 3))"))
def bm25_index_edits(spark, sf_dir):
    """An index that took three updates: all documents, then a fifth of them reversed, then a seventh deleted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = Index(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", "doc_id")
    index.update(docs)
    index.update(docs.filter("doc_id % 5 = 1").select("doc_id", F.reverse("text").alias("text")))
    index.update(deleted=docs.filter("doc_id % 7 = 3"))
    return S.top(index.search("the that").select("doc_id", F.round("score", 6).alias("score")), 50, "score", "doc_id")


@query("""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents)
SELECT term, count(*) AS cf, count(DISTINCT doc_id) AS df FROM t GROUP BY term""")
def term_document_frequencies(spark, sf_dir):
    return S.document_frequencies(table(spark, sf_dir, "documents"), "text").select("term", "cf", "df")


@query("""
SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS BIGINT) AS n_tokens,
       CAST(len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS BIGINT) AS n_terms FROM documents""")
def tokenize_stats(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", X.tokenize("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"))


@query(r"SELECT doc_id, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 400) AS snippet FROM documents")
def snippet_collapse(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.snippet("text").alias("snippet"))


@query(r"""
SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS line_count,
       CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS BIGINT) AS word_count,
       CAST((length(text) - length(replace(text, 'the', ''))) // 3 AS BIGINT) AS n_the FROM documents""")
def line_word_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.line_count("text").alias("line_count"), X.word_count("text").alias("word_count"), X.occurrences("text", "the").alias("n_the"))


_NEAR = "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0), d AS (SELECT vec_id, label, list_cosine_distance(CAST(embedding AS DOUBLE[]), q) AS dist FROM embeddings, q)"


def _nearest(spark, sf_dir, **kw) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    q = v.filter("vec_id = 0").select("embedding")
    return S.nearest(v.select("vec_id", "label", "embedding"), "embedding", q, ties=("vec_id",), **kw).select("vec_id", F.round("distance", 6).alias("distance"), "rank")


@query(_NEAR + " SELECT vec_id, round(dist, 6) AS distance, CAST(row_number() OVER (ORDER BY dist, vec_id) AS INTEGER) AS rank FROM d ORDER BY dist, vec_id LIMIT 50")
def vector_topk(spark, sf_dir):
    return _nearest(spark, sf_dir)


@query(_NEAR + " SELECT vec_id, round(dist, 6) AS distance, CAST(row_number() OVER (ORDER BY dist, vec_id) AS INTEGER) AS rank FROM d WHERE label = 1 ORDER BY dist, vec_id LIMIT 50")
def vector_topk_filtered(spark, sf_dir):
    return _nearest(spark, sf_dir, where=F.col("label") == 1)


@query(_NEAR + ", b AS (SELECT * FROM d ORDER BY dist, vec_id LIMIT 100) SELECT vec_id, round(dist, 6) AS distance, CAST(row_number() OVER (ORDER BY dist, vec_id) AS INTEGER) AS rank FROM b WHERE label = 1")
def vector_topk_post_filter(spark, sf_dir):
    return _nearest(spark, sf_dir, n=100, where=F.col("label") == 1, post_filter=True)


@query(_NEAR + ", b AS (SELECT * FROM d ORDER BY dist, vec_id LIMIT 50) SELECT vec_id, round(dist, 6) AS distance, CAST(row_number() OVER (ORDER BY dist, vec_id) AS INTEGER) AS rank FROM b WHERE dist <= 0.75")
def vector_cutoff(spark, sf_dir):
    return _nearest(spark, sf_dir, cutoff=0.75)


def _fused(spark, sf_dir) -> DataFrame:
    lex = _bm25_top(table(spark, sf_dir, "documents"), TERMS, 50).select(F.col("doc_id").alias("id"), "rank")
    sem = _nearest(spark, sf_dir).select(F.col("vec_id").alias("id"), "rank")
    return S.fuse(lex, sem, ["id"])


_FUSED = f"""
lex AS ({_bm25_sql(TERMS.split(), "true", "true", 50)}),
sem AS ({_NEAR} SELECT vec_id, row_number() OVER (ORDER BY dist, vec_id) AS rank FROM d ORDER BY dist, vec_id LIMIT 50),
f AS (SELECT coalesce(l.doc_id, s.vec_id) AS id, coalesce(1.0::DOUBLE / (60 + l.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0) AS sc,
             coalesce(l.rank, 1000000 + s.rank) AS o, l.rank AS lr, s.rank AS sr FROM lex l FULL JOIN sem s ON l.doc_id = s.vec_id),
fused AS (SELECT id, sc, lr, sr, row_number() OVER (ORDER BY sc DESC, o) AS rank FROM f)"""


@query(f"WITH {_FUSED} SELECT id, round(sc, 9) AS score, CASE WHEN lr IS NULL THEN 'vector' WHEN sr IS NULL THEN 'lexical' ELSE 'lexical,vector' END AS retrievers, CAST(rank AS INTEGER) AS rank FROM fused")
def rrf_hybrid(spark, sf_dir):
    return _fused(spark, sf_dir).select("id", F.round("score", 9).alias("score"), F.array_join("retrievers", ",").alias("retrievers"), "rank")


@query(f"""WITH {_FUSED},
k AS (SELECT id, id % 7 AS page, rank FROM fused QUALIFY row_number() OVER (PARTITION BY id % 7 ORDER BY rank) <= 2),
b AS (SELECT * FROM k ORDER BY rank LIMIT 10)
SELECT id, page, CAST(row_number() OVER (ORDER BY rank) AS INTEGER) AS rank FROM b""")
def rrf_page_cap(spark, sf_dir):
    f = _fused(spark, sf_dir).withColumn("page", F.col("id") % 7)
    return S.cap_per_page(f, "page", 2, 10).select("id", "page", "rank")


# --- parsing


def _chats(spark, sf_dir, numbered: bool = True) -> DataFrame:
    """Conversations as Markdown pages: a heading per turn. A page is one text, so its turns meet in one row."""
    c = table(spark, sf_dir, "conversations")
    turn = F.concat(F.lit("turn "), F.col("turn").cast("string"), F.lit(" ")) if numbered else F.lit("")
    part = F.concat(F.lit("## "), turn, F.col("role"), F.lit("\n"), F.regexp_replace("text", r"\s+", " "))
    return c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", part.alias("p")))).alias("t")).select("conv_id", F.array_join("t.p", "\n").alias("body"))


@query(r"""
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS INTEGER) AS section_index,
       'turn ' || turn || ' ' || role AS heading, regexp_replace(text, '\s+', ' ', 'g') AS text FROM conversations""")
def sections_from_conversations(spark, sf_dir):
    s = _chats(spark, sf_dir).select("conv_id", F.explode(parse.split_sections("body")).alias("s")).select("conv_id", "s.*").filter("level > 0")
    return s.select("conv_id", "section_index", F.element_at("heading_path", -1).alias("heading"), "text")


@query("""
SELECT conv_id, CAST(i AS INTEGER) AS section_index, lag(h) OVER w AS prev, lead(h) OVER w AS next FROM (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS i, 'turn ' || turn || ' ' || role AS h FROM conversations)
WINDOW w AS (PARTITION BY conv_id ORDER BY i)""")
def section_neighbors(spark, sf_dir):
    p = _chats(spark, sf_dir).select(
        F.col("conv_id").cast("string").alias("rel_path"), F.col("conv_id").cast("string").alias("slug"), F.lit("chat").alias("type"), F.lit("t").alias("title"),
        F.array().cast("array<string>").alias("tags"), F.array().cast("array<string>").alias("sources"), F.lit(None).cast("string").alias("updated"), parse.split_sections("body").alias("sections"),
    )
    s = parse.section_rows(p).filter("level > 0")
    return s.select(F.col("rel_path").cast("long").alias("conv_id"), "section_index", F.col("neighbors.prev").alias("prev"), F.col("neighbors.next").alias("next"))


@query("""
SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(
  lower(trim(regexp_replace(d.text, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(b.text, '\\s+', ' ', 'g')))) WHERE trim(b.text) <> ''""".replace("\\\\", "\\"))
def evidence_contains(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("evidence"))
    return E.evidence_pairs(d, b, "doc_id", "item_id")


@query(r"""
WITH b AS (SELECT doc_id, unnest(string_split_regex(text, '\n\s*\n')) AS x FROM documents),
t AS (SELECT doc_id, unnest(string_split(regexp_replace(trim(regexp_replace(x, '\s+', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1))) AS y FROM b)
SELECT doc_id, y AS sentence, count(*) AS n FROM t WHERE y <> '' GROUP BY 1, 2""")
def sentence_rows(spark, sf_dir):
    """All sentences of every document, whole."""
    s = table(spark, sf_dir, "documents").select("doc_id", F.explode(parse.split_sentences("text", None, None)).alias("sentence"))
    return s.groupBy("doc_id", "sentence").agg(F.count("*").alias("n"))


# --- links: page_id as pages, links by arithmetic


_LINKS = """
pg AS (SELECT page_id, page_id % 3 AS dir, CASE WHEN page_id % 3 = 0 THEN 'entities' WHEN page_id % 3 = 1 THEN 'concepts' ELSE 'sources' END AS d, html FROM pages),
hr AS (SELECT page_id, unnest(hs) AS x, generate_subscripts(hs, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, 'href="/([^"/|#\\[\\]]+)"', 1) AS hs FROM pages)),
lk AS (SELECT page_id AS src, 0 AS ord, 'page-' || (page_id // 2) AS clean FROM pg
  UNION ALL SELECT page_id, 1, CASE WHEN (page_id + 3) % 10 = 0 THEN 'page-' || page_id ELSE d || '/page-' || (page_id + 3) END FROM pg
  UNION ALL SELECT page_id, 2, CASE WHEN (page_id + 1) % 10 = 0 THEN 'page-' || page_id ELSE d || '/page-' || (page_id + 1) END FROM pg
  UNION ALL SELECT page_id, 3, 'page-' || (page_id // 2) FROM pg
  UNION ALL SELECT page_id, 3 + i, x FROM hr),
rs AS (SELECT lk.*, CASE WHEN contains(clean, '/') THEN bp.slug ELSE bs.slug END AS target FROM lk
  LEFT JOIN (SELECT d || '/page-' || page_id AS p, 'page-' || page_id AS slug FROM pg) bp ON clean = bp.p
  LEFT JOIN (SELECT 'page-' || page_id AS slug FROM pg) bs ON clean = bs.slug)"""


def wiki(spark, sf_dir) -> DataFrame:
    """A link graph over pages: rel_path, slug, body with four links by arithmetic and those of the page's html, links."""
    p = table(spark, sf_dir, "pages").select("page_id", "html")
    n = F.col("page_id")
    d = F.element_at(F.array(F.lit("entities"), F.lit("concepts"), F.lit("sources")), (n % 3 + 1).cast("int"))
    text = lambda c: c.cast("string")
    half = text(F.call_function("div", n, F.lit(2)))
    # every tenth page is linked by its number's double only
    to = lambda k, end: F.when((n + k) % 10 == 0, F.concat(F.lit("page-"), text(n))).otherwise(F.concat(d, F.lit("/page-"), text(n + k), F.lit(end)))
    hrefs = F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r'href="/([^"/|#\[\]]+)"'), F.lit(1)), lambda x: F.concat(F.lit(" [["), x, F.lit("]]")))
    body = F.concat(F.lit("See [[page-"), half, F.lit("|half]], [["), to(3, ".md"), F.lit("]] and [["), to(1, "#top"), F.lit("]], [[ page-"), half, F.lit(" ]]."), F.array_join(hrefs, ""))
    p = p.select("page_id", F.concat(d, F.lit("/page-"), text(n), F.lit(".md")).alias("rel_path"), body.alias("body"))
    return p.select("page_id", "rel_path", X.slug_of("rel_path").alias("slug"), "body", X.wikilinks("body").alias("links"))


def _resolved(spark, sf_dir) -> DataFrame:
    p = wiki(spark, sf_dir)
    return L.resolve(L.link_rows(p), p)


@query(f"WITH {_LINKS} SELECT 'page-' || src AS src_slug, CAST(ord AS INTEGER) AS ord, clean, target, coalesce(target, clean) AS key FROM rs")
def page_links(spark, sf_dir):
    return _resolved(spark, sf_dir).select("src_slug", "ord", "clean", "target", "key")


@query(f"WITH {_LINKS} SELECT DISTINCT 'page-' || src AS slug FROM rs WHERE target = 'page-7'")
def backlinks(spark, sf_dir):
    return L.backlinks(_resolved(spark, sf_dir), "page-7").select("slug")


@query(f"WITH {_LINKS} SELECT target AS slug, count(DISTINCT src) AS inbound FROM rs WHERE target IS NOT NULL GROUP BY target")
def inbound_links(spark, sf_dir):
    return L.inbound(_resolved(spark, sf_dir)).select("slug", "inbound")


@query(f"""WITH {_LINKS} SELECT key, n FROM (
  SELECT coalesce(target, clean) AS key, count(*) AS n, min((CASE WHEN src % 3 = 0 THEN 'entities' WHEN src % 3 = 1 THEN 'concepts' ELSE 'sources' END || '/page-' || src || '.md', ord)) AS f FROM rs GROUP BY 1)
ORDER BY n DESC, f LIMIT 20""")
def top_linked(spark, sf_dir):
    return L.top_linked(_resolved(spark, sf_dir), 20)


@query(f"WITH {_LINKS} SELECT 'page-' || src AS src_slug, clean FROM rs WHERE target IS NULL")
def broken_links(spark, sf_dir):
    r = _resolved(spark, sf_dir)
    return L.broken(r).select(X.slug_of("src").alias("src_slug"), "clean")


@query(f"WITH {_LINKS} SELECT 'page-' || page_id AS slug FROM pg WHERE 'page-' || page_id NOT IN (SELECT target FROM rs WHERE target IS NOT NULL)")
def orphan_pages(spark, sf_dir):
    p = wiki(spark, sf_dir)
    return L.orphans(p, L.resolve(L.link_rows(p), p)).select("slug")


@query("""
SELECT 'page-' || (page_id // 3) AS slug, CAST(count(*) AS BIGINT) AS n_paths FROM pages GROUP BY 1 HAVING count(*) > 1""")
def duplicate_slugs(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("d"), (F.col("page_id") % 3).cast("string"), F.lit("/page-"), F.call_function("div", F.col("page_id"), F.lit(3)).cast("string"), F.lit(".md")).alias("rel_path"))
    return Lint.duplicate_slugs(p.withColumn("slug", X.slug_of("rel_path"))).select("slug", F.col("n").alias("n_paths"))


@query()
def suggested_phrases(spark, sf_dir):
    """Over all languages; a word ends at a letter of any of them, which DuckDB's expressions can't say, so the tests count by hand."""
    return Lint.phrases(table(spark, sf_dir, "documents"), "text", "doc_id", 5).select("phrase", "page_count")


# --- statistics


def _sized(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("rel_path"), "lang", "source", X.line_count("text").alias("line_count"), X.word_count("text").alias("word_count"), F.lit(0).cast("long").alias("n_links"))


_SIZED = r"s AS (SELECT source || '/' || doc_id || '.md' AS rel_path, lang, source, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS line_count, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS BIGINT) AS word_count FROM documents)"


@query(f"WITH {_SIZED} SELECT CAST(count(*) AS BIGINT) AS pages, CAST(sum(line_count) AS BIGINT) AS lines, CAST(sum(word_count) AS BIGINT) AS words, CAST(sum(line_count) // count(*) AS BIGINT) AS avg_lines, CAST(sum(word_count) // count(*) AS BIGINT) AS avg_words FROM s")
def corpus_totals(spark, sf_dir):
    return Lint.totals(_sized(spark, sf_dir)).select("pages", "lines", "words", "avg_lines", "avg_words")


@query(f"WITH {_SIZED} SELECT lang, count(*) AS n FROM s GROUP BY lang")
def stats_by_type(spark, sf_dir):
    return Lint.shares(_sized(spark, sf_dir), "lang")


@query(f"WITH {_SIZED} SELECT source, count(*) AS n FROM s GROUP BY source")
def stats_by_directory(spark, sf_dir):
    return Lint.shares(_sized(spark, sf_dir), "source")


@query(f"WITH {_SIZED} SELECT rel_path, line_count, CASE WHEN line_count > 800 THEN 'over_hard_cap' WHEN line_count > 400 THEN 'over_soft_cap' ELSE '' END AS verdict FROM s ORDER BY line_count DESC, rel_path DESC LIMIT 10")
def largest_pages(spark, sf_dir):
    return Lint.largest(_sized(spark, sf_dir))


@query("SELECT source, count(*) AS n, CASE WHEN count(*) < 50 THEN 'flat' WHEN count(*) < 150 AND max(doc_id) % 600 < 300 THEN 'single_index' WHEN source <> 'src1' THEN 'shard' WHEN count(*) >= 300 THEN 'search_fallback' ELSE 'sharded' END AS advice FROM documents GROUP BY source")
def scaling_case(spark, sf_dir):
    g = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), (F.max("doc_id") % 600).alias("i"))
    return g.select("source", "n", Lint.scaling_advice(F.col("n"), F.col("i"), F.col("source") == "src1").alias("advice"))


@query("SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_content(spark, sf_dir):
    g = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))
    return g.filter("copies > 1")


# --- graph: region <- nation <- customer, supplier; customer <- orders


_GRAPH = """
ed AS (
  SELECT 'nation:' || n_nationkey AS subject, 'part_of' AS predicate, 'region:' || n_regionkey AS object FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'lives_in', 'nation:' || c_nationkey FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'located_in', 'nation:' || s_nationkey FROM supplier
  UNION ALL SELECT 'order:' || o_orderkey, 'placed_by', 'customer:' || o_custkey FROM orders),
eg AS (SELECT substr(sha256(subject || chr(31) || predicate || chr(31) || object || chr(31) || chr(31)), 1, 24) AS id, * FROM ed)"""


def graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    t = lambda n: table(spark, sf_dir, n)
    ref = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    parts = [
        t("nation").select(ref("nation", "n_nationkey").alias("subject"), F.lit("part_of").alias("predicate"), ref("region", "n_regionkey").alias("object")),
        t("customer").select(ref("customer", "c_custkey"), F.lit("lives_in"), ref("nation", "c_nationkey")),
        t("supplier").select(ref("supplier", "s_suppkey"), F.lit("located_in"), ref("nation", "s_nationkey")),
        t("orders").select(ref("order", "o_orderkey"), F.lit("placed_by"), ref("customer", "o_custkey")),
    ]
    e = parts[0]
    for p in parts[1:]:
        e = e.union(p)
    e = e.select(X.edge_id("subject", "predicate", "object").alias("id"), "subject", "predicate", "object")
    nodes = [t(n).select(ref(k, c).alias("id"), F.col(title).alias("title"), F.lit(k).alias("node_type")) for n, k, c, title in (("region", "region", "r_regionkey", "r_name"), ("nation", "nation", "n_nationkey", "n_name"), ("customer", "customer", "c_custkey", "c_name"), ("supplier", "supplier", "s_suppkey", "s_name"))]
    v = nodes[0]
    for n in nodes[1:]:
        v = v.unionByName(n)
    return v, e


@query(f"WITH {_GRAPH} SELECT id, subject, predicate, object FROM eg")
def graph_edges(spark, sf_dir):
    return graph(spark, sf_dir)[1]


@query(f"WITH {_GRAPH} SELECT predicate, count(*) AS n FROM eg GROUP BY predicate")
def graph_predicate_counts(spark, sf_dir):
    return G.predicate_counts(graph(spark, sf_dir)[1])


@query(f"WITH {_GRAPH} SELECT predicate, id, 'out' AS direction, object AS node FROM eg WHERE subject = 'customer:1' UNION ALL SELECT predicate, id, 'in', subject FROM eg WHERE object = 'customer:1'")
def graph_facts(spark, sf_dir):
    f = G.facts(graph(spark, sf_dir)[1], "customer:1")
    return f.select("predicate", "id", "direction", F.when(F.col("direction") == "out", F.col("object")).otherwise(F.col("subject")).alias("node"))


@query(f"""WITH RECURSIVE {_GRAPH}, b AS (SELECT subject AS a, object AS z FROM eg UNION SELECT object, subject FROM eg),
w AS (SELECT 'supplier:1' AS node, 0 AS d UNION SELECT z, d + 1 FROM w JOIN b ON w.node = b.a WHERE d < 2)
SELECT node, CAST(min(d) AS INTEGER) AS distance FROM w GROUP BY node HAVING min(d) > 0""")
def graph_neighbors(spark, sf_dir):
    return G.neighbors(graph(spark, sf_dir)[1], "supplier:1", 2)


@query(f"WITH {_GRAPH} SELECT object AS node, predicate, id AS edge_id FROM eg WHERE subject = 'customer:1' UNION ALL SELECT e2.object, e2.predicate, e2.id FROM eg e1 JOIN eg e2 ON e1.object = e2.subject WHERE e1.subject = 'customer:1'")
def graph_path(spark, sf_dir):
    v, e = graph(spark, sf_dir)
    goal = e.filter("subject = 'customer:1'").select(F.col("object").alias("s")).join(e, F.col("s") == F.col("subject")).first()
    return G.shortest_path(e, v, "customer:1", goal["object"]).filter("hop > 0").select("node", "predicate", "edge_id")


@query(f"WITH {_GRAPH} SELECT subject, predicate, object, id FROM eg WHERE predicate = 'lives_in' ORDER BY subject, predicate, object, id LIMIT 100")
def graph_select_edges(spark, sf_dir):
    return G.select_edges(graph(spark, sf_dir)[1], predicate="lives_in").select("subject", "predicate", "object", "id")


def _linted(spark, sf_dir) -> DataFrame:
    v, e = graph(spark, sf_dir)
    rules = spark.createDataFrame([("part_of", ["nation"], ["region"], False), ("lives_in", ["customer"], ["region"], False), ("located_in", ["nation"], ["*"], True)], "predicate string, subject_types array<string>, object_types array<string>, requires_evidence boolean")
    e = e.withColumn("evidence", F.when(F.substring("id", 1, 1) < "8", "seen").otherwise("")).withColumn("source", F.lit("")).withColumn("confidence", F.when(F.substring("id", 2, 1) < "2", "certain").otherwise("high")).withColumn("status", F.lit("current"))
    return G.lint_edges(e, v, rules)


@query(f"""WITH {_GRAPH},
v AS (SELECT 'region:' || r_regionkey AS id FROM region UNION ALL SELECT 'nation:' || n_nationkey FROM nation UNION ALL SELECT 'customer:' || c_custkey FROM customer UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier),
x AS (
  SELECT 'unknown_predicates' AS category, * FROM eg WHERE predicate = 'placed_by'
  UNION ALL SELECT 'broken_object_refs', * FROM eg WHERE predicate IN ('part_of', 'lives_in') AND object NOT IN (SELECT id FROM v)
  UNION ALL SELECT 'subject_type_mismatch', * FROM eg WHERE predicate = 'located_in'
  UNION ALL SELECT 'object_type_mismatch', * FROM eg WHERE predicate = 'lives_in' AND object IN (SELECT id FROM v)
  UNION ALL SELECT 'missing_evidence', * FROM eg WHERE predicate = 'located_in' AND substr(id, 1, 1) >= '8'
  UNION ALL SELECT 'missing_source_field', * FROM eg WHERE predicate = 'located_in'
  UNION ALL SELECT 'invalid_confidence', * FROM eg WHERE predicate <> 'placed_by' AND substr(id, 2, 1) < '2')
SELECT category, subject, predicate, object FROM x""")
def graph_lint_edges(spark, sf_dir):
    return _linted(spark, sf_dir)


@query(f"""WITH {_GRAPH},
v AS (SELECT 'region:' || r_regionkey AS id FROM region UNION ALL SELECT 'nation:' || n_nationkey FROM nation UNION ALL SELECT 'customer:' || c_custkey FROM customer UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier)
SELECT id FROM v WHERE id NOT IN (SELECT subject FROM eg WHERE predicate <> 'placed_by' UNION SELECT object FROM eg WHERE predicate <> 'placed_by')""")
def graph_orphan_nodes(spark, sf_dir):
    v, e = graph(spark, sf_dir)
    return G.orphan_nodes(v, e.filter("predicate <> 'placed_by'")).select("id")


# --- versioned store: events as a commit log


_LOG = """
vs AS (SELECT event_id AS seq, 'u' || user_id AS path, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rev,
              event_type = 'error' AS deleted, sha256(CAST(event_type || ':' || coalesce(props, '') AS VARCHAR)) AS sha256 FROM events),
la AS (SELECT * FROM vs QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1)"""


def versions(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    v = e.select(F.col("event_id").alias("seq"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.concat(F.col("event_type"), F.lit(":"), F.coalesce("props", F.lit(""))).alias("content"), (F.col("event_type") == "error").alias("deleted"))
    return St.numbered(v, "path", "seq").withColumn("sha256", F.sha2("content", 256))


@query(f"WITH {_LOG} SELECT path, seq, CAST(rev AS BIGINT) AS rev, deleted, sha256 FROM la")
def latest_state(spark, sf_dir):
    return St.latest(versions(spark, sf_dir)).select("path", "seq", "rev", "deleted", "sha256")


@query(f"WITH {_LOG} SELECT path, sha256 FROM la WHERE NOT deleted")
def manifest(spark, sf_dir):
    return St.manifest(versions(spark, sf_dir))


@query(f"WITH {_LOG}, m AS (SELECT max(seq) // 2 AS h FROM vs), b AS (SELECT vs.* FROM vs, m WHERE seq <= h QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1) SELECT path, CAST(rev AS BIGINT) AS rev, sha256 FROM b WHERE NOT deleted")
def as_of_revision(spark, sf_dir):
    v = versions(spark, sf_dir)
    half = table(spark, sf_dir, "events").agg(F.call_function("div", F.max("event_id"), F.lit(2))).first()[0]
    return St.as_of(v, half).select("path", "rev", "sha256")


@query("""
WITH vs AS (SELECT event_id // 3 AS seq, event_id, 'u' || user_id AS path, event_type = 'error' AS deleted FROM events),
la AS (SELECT * FROM vs QUALIFY row_number() OVER (PARTITION BY path ORDER BY event_id DESC) = 1),
c AS (SELECT * FROM la WHERE seq > (SELECT max(seq) // 2 FROM vs)), p AS (SELECT max(seq) AS z FROM (SELECT seq FROM c ORDER BY seq, path LIMIT 20))
SELECT path, seq, deleted FROM c, p WHERE seq <= z""")
def changes_since(spark, sf_dir):
    """Commits of three events each, so that a page of 20 rows must not end within one."""
    v = versions(spark, sf_dir).withColumn("rev", F.col("seq")).withColumn("seq", F.call_function("div", F.col("seq"), F.lit(3)))
    half = table(spark, sf_dir, "events").agg(F.call_function("div", F.call_function("div", F.max("event_id"), F.lit(3)), F.lit(2))).first()[0]
    return St.changes(v, half, 20).select("path", "seq", "deleted")


@query(f"WITH {_LOG} SELECT seq, path, CAST(rev AS BIGINT) AS rev, deleted FROM vs WHERE path = 'u1' ORDER BY seq DESC LIMIT 50")
def commit_history(spark, sf_dir):
    v = versions(spark, sf_dir)
    h = St.history(v, v.select("seq").distinct(), path="u1", n=50)
    return h.select("seq").join(v.filter("path = 'u1'"), "seq").select("seq", "path", "rev", "deleted")


@query(f"WITH {_LOG} SELECT vs.path, la.seq AS changed_at FROM vs JOIN la USING (path) WHERE vs.seq = 5 AND la.seq <> 5")
def revert_guard(spark, sf_dir):
    return St.revert(versions(spark, sf_dir), 5)[0].select("path", "changed_at")


@query(f"""WITH {_LOG}, a AS (SELECT path, sha256 FROM la WHERE NOT deleted), m AS (SELECT max(seq) // 2 AS h FROM vs),
b AS (SELECT path, sha256 FROM (SELECT vs.* FROM vs, m WHERE seq <= h QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1) WHERE NOT deleted)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'new' WHEN a.path IS NULL THEN 'remote_only' WHEN a.sha256 = b.sha256 THEN 'identical' ELSE 'divergent' END AS state FROM a FULL JOIN b ON a.path = b.path""")
def import_classify(spark, sf_dir):
    v = versions(spark, sf_dir)
    half = table(spark, sf_dir, "events").agg(F.call_function("div", F.max("event_id"), F.lit(2))).first()[0]
    return St.classify(St.manifest(v), St.as_of(v, half).select("path", "sha256"))


@query("SELECT user_id AS id, max(event_id) AS at, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id")
def review_queue(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("at"), F.col("event_type").alias("status"))
    return St.review_queue(e)


# --- evaluation


def scored_labels(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.round(F.length("text") % 1000 / 1000, 3).alias("score"))
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).join(d, "doc_id")


_SCORED = "sc AS (SELECT doc_id, quality AS label, round(CAST(length(text) % 1000 AS DOUBLE) / 1000, 3) AS score FROM labels JOIN documents USING (doc_id))"
_GRID = "(VALUES " + ", ".join(f"(CAST({t} AS DOUBLE))" for t in E.GRID) + ") AS g(threshold)"
_PRF = f"""{_SCORED},
c AS (SELECT threshold, count(*) FILTER (WHERE score >= threshold AND label = 1) AS tp, count(*) FILTER (WHERE score >= threshold AND label <> 1) AS fp,
             count(*) FILTER (WHERE score < threshold AND label = 1) AS fn FROM sc, {_GRID} GROUP BY threshold),
f AS (SELECT threshold, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS recall,
             CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp::DOUBLE / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM c)"""


@query(f"WITH {_PRF} SELECT threshold, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def prf_threshold_grid(spark, sf_dir):
    g = E.threshold_grid(scored_labels(spark, sf_dir))
    return g.select("threshold", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH {_PRF} SELECT threshold, round(f1, 6) AS f1 FROM f ORDER BY round(f1, 9) DESC, threshold LIMIT 1")
def best_threshold(spark, sf_dir):
    return E.best_threshold(scored_labels(spark, sf_dir)).select("threshold", F.round("f1", 6).alias("f1"))


@query(f"WITH {_SCORED} SELECT round(sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END)::DOUBLE / count(*), 6) AS auroc FROM sc a, sc b WHERE a.label = 1 AND b.label = 0")
def auroc(spark, sf_dir):
    return E.auroc(scored_labels(spark, sf_dir)).select(F.round("auroc", 6).alias("auroc"))


@query("""
WITH r AS (SELECT user_id % 50 AS query, event_id AS item, row_number() OVER (PARTITION BY user_id % 50 ORDER BY value DESC, event_id) AS rank FROM events),
x AS (SELECT user_id % 50 AS query, event_id AS item FROM events WHERE event_id % 10 = 0),
w AS (SELECT query, count(*) AS n FROM x GROUP BY query),
h AS (SELECT query, count(*) FILTER (WHERE rank <= 5) AS found, min(rank) AS best FROM r JOIN x USING (query, item) GROUP BY query)
SELECT query, round(coalesce(found, 0)::DOUBLE / n, 6) AS recall_at_k, round(coalesce(1.0::DOUBLE / best, 0), 6) AS reciprocal_rank FROM w LEFT JOIN h USING (query)""")
def recall_mrr(spark, sf_dir):
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("query"), F.col("event_id").alias("item"), "value")
    r = e.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("value"), "item")))
    got = E.retrieval(r, e.filter("item % 10 = 0").select("query", "item"))
    return got.select("query", F.round("recall_at_k", 6).alias("recall_at_k"), F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


@query("WITH s AS (SELECT value FROM events WHERE value IS NOT NULL) SELECT round(median(value), 6) AS p50, round((SELECT value FROM s ORDER BY value LIMIT 1 OFFSET (SELECT CAST(floor(0.9 * (count(*) - 1)) AS BIGINT) FROM s)), 6) AS p90, round(avg(value), 6) AS mean FROM s")
def latency_percentiles(spark, sf_dir):
    return E.latencies(table(spark, sf_dir, "events"), "value").select(*[F.round(c, 6).alias(c) for c in ("p50", "p90", "mean")])


@query("""
WITH t AS (SELECT event_type, user_id, round((sum(value) FILTER (WHERE event_id % 2 = 0)) - (sum(value) FILTER (WHERE event_id % 2 = 1)), 2) AS d FROM events WHERE user_id % 15 < 4 GROUP BY ALL),
v AS (SELECT event_type, CAST(user_id AS VARCHAR) AS task, d FROM t WHERE d IS NOT NULL UNION ALL SELECT 'few', CAST(user_id AS VARCHAR), d FROM t WHERE event_type = 'click' AND user_id < 17 AND d IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY task) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM v),
e AS (SELECT *, CASE WHEN n <= 12 THEN 1 << n ELSE 500 END AS flips, unnest(range(0, 500 + CASE WHEN n <= 12 AND (1 << n) > 500 THEN (1 << n) - 500 ELSE 0 END)) AS r FROM n),
h AS (SELECT *, md5(task || ':' || r || ':0') AS x FROM e),
s AS (
  SELECT event_type, r, max(n) AS n, max(flips) AS flips, sum(d) AS sum, sum(CASE WHEN CASE WHEN n <= 12 THEN (r >> k) & 1 ELSE CAST('0x' || x[9:9] AS INTEGER) % 2 END = 1 THEN -d ELSE d END) AS flipped
  FROM h GROUP BY event_type, r)
SELECT event_type, max(n) AS tasks, round(CASE WHEN max(n) <= 12 THEN (count(*) FILTER (WHERE r < flips AND abs(flipped) >= abs(sum) - 1e-9))::DOUBLE / max(flips)
  ELSE ((count(*) FILTER (WHERE r < flips AND abs(flipped) >= abs(sum) - 1e-9)) + 1)::DOUBLE / (max(flips) + 1) END, 6) AS p_value FROM s GROUP BY event_type""")
def sign_flip_p_value(spark, sf_dir):
    """Experiments by event type, tasks by user, and one of few tasks."""
    return _intervals(spark, sf_dir).select("event_type", "tasks", F.round("p_value", 6).alias("p_value"))


def _intervals(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("user_id % 15 < 4")
    part = lambda k: F.sum(F.when(F.col("event_id") % 2 == k, F.col("value")))
    d = e.groupBy("event_type", F.col("user_id").alias("task")).agg(F.round(part(0) - part(1), 2).alias("difference")).filter("difference is not null")
    few = d.filter("event_type = 'click' and task < 17").withColumn("event_type", F.lit("few"))
    return E.intervals(d.unionByName(few), ["event_type"], 500)


@query("""
WITH t AS (SELECT event_type, user_id, round((sum(value) FILTER (WHERE event_id % 2 = 0)) - (sum(value) FILTER (WHERE event_id % 2 = 1)), 2) AS d FROM events WHERE user_id % 15 < 4 GROUP BY ALL),
v AS (SELECT event_type, CAST(user_id AS VARCHAR) AS task, d FROM t WHERE d IS NOT NULL UNION ALL SELECT 'few', CAST(user_id AS VARCHAR), d FROM t WHERE event_type = 'click' AND user_id < 17 AND d IS NOT NULL),
e AS (SELECT *, unnest(range(0, 500)) AS r FROM v),
u AS (SELECT *, CAST('0x' || md5(task || ':' || r || ':0')[1:8] AS BIGINT) / 4294967296.0::DOUBLE AS u FROM e),
p AS (SELECT event_type, r, d, len(list_filter(range(1, 12), lambda i: u >= exp(-1) * list_sum(list_transform(range(0, i), lambda j: 1.0::DOUBLE / factorial(CAST(j AS INTEGER))::DOUBLE)))) AS w FROM u),
s AS (SELECT event_type, r, sum(w * d) / sum(w) AS m FROM p GROUP BY event_type, r HAVING sum(w) > 0),
a AS (SELECT event_type, avg(d) AS delta FROM v GROUP BY event_type)
SELECT event_type, round(any_value(delta), 9) AS accuracy_delta, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM s JOIN a USING (event_type) GROUP BY event_type""")
def bootstrap_intervals(spark, sf_dir):
    return _intervals(spark, sf_dir).select("event_type", *[F.round(c, 9).alias(c) for c in ("accuracy_delta", "low", "high")])


@query("""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
p AS (SELECT doc_id, CAST(len(list_intersect(['the', 'of', 'that', 'with'], w)) AS DOUBLE) / 4 AS p FROM t)
SELECT doc_id, round(p, 6) AS probability FROM p WHERE p >= 0.65 ORDER BY doc_id LIMIT 20""")
def overlap_gate(spark, sf_dir):
    pool = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("rank"), "text")
    return E.gate(pool, E.overlap_score(F.lit("the of that with the"), "text"), n=20).select("doc_id", F.round("probability", 6).alias("probability"))


@query("""
WITH c AS (SELECT 'r' || (turn % 4) AS entity, conv_id * 1000 + turn AS ord, conv_id AS path FROM conversations)
SELECT a.entity, a.ord AS i, b.ord AS j FROM c a JOIN c b ON a.entity = b.entity AND a.ord < b.ord AND a.path <> b.path ORDER BY a.entity, i, j LIMIT 50""")
def contradiction_pairs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.concat(F.lit("r"), (F.col("turn") % 4).cast("string")).alias("entity"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.col("conv_id").alias("path"), "text")
    return E.contradiction_pairs(c, 50).select("entity", "i", "j")


@query("SELECT event_type, user_id % 2 AS half, count(*) AS n FROM events GROUP BY 1, 2")
def stream_changes(spark, sf_dir):
    """A file stream over events, drained in micro-batches into a folder, then read back."""
    import uuid

    from textloom.streaming import feed

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="textloom-stream-")
    out = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    src = table(spark, sf_dir, "events")
    rows = spark.readStream.schema(src.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    feed.drain(rows, lambda df, i: df.select("event_type", (F.col("user_id") % 2).alias("half")).write.mode("overwrite").parquet(f"{out}/data/batch={i}"), f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/data").groupBy("event_type", "half").agg(F.count("*").alias("n"))


# --- more of parsing, lint, graph building, sinks and merges


def _lint(spark, sf_dir, suggest_min: int | None = None) -> DataFrame:
    """Findings of the pages below. All of them read the parsed pages, of which what they need is persisted, so each is parsed once."""
    pages = parse.parse_pages(_wiki_files(spark, sf_dir)).select(*Lint.READ, *(Lint.READ_BY_PHRASES if suggest_min is not None else ()))
    return Lint.report(pages.persist(StorageLevel.MEMORY_AND_DISK), "2024-06-01", suggest_min)


def _wiki_files(spark, sf_dir) -> DataFrame:
    """Documents as Markdown pages with frontmatter, three links and the whole text; some unreadable, unclosed, of one name or long."""
    d = table(spark, sf_dir, "documents")
    n, text = F.col("doc_id"), lambda c: c.cast("string")
    when = lambda c, a, b="": F.when(c, F.lit(a)).otherwise(F.lit(b))
    front = F.concat(
        F.lit("---\ntitle: \"Doc "), text(n), F.lit("\"\ntype: "), F.col("lang"), F.lit("\ntags: ["), F.col("source"), F.lit(", all]\nsources:\n  - s"), text(n % 5), F.lit("\n  - s9\nupdated: 2024-01-"),
        F.format_string("%02d", n % 28 + 1), when(n % 3 == 0, "\ncreated: 2024-01-01\n", "\n"), when(n % 89 == 3, "", "---\n"),
    )
    links = F.concat(F.lit("See [[doc-"), text(F.call_function("div", n, F.lit(2))), F.lit("]], [[doc-"), text(n + 1), F.lit("|next]] and [[nowhere-"), text(n % 7), F.lit("]].\n"))
    pad = F.when(n % 101 == 7, F.repeat(F.lit("\nx"), 500)).when(n % 103 == 9, F.repeat(F.lit("\nx"), 900)).otherwise("")
    path = F.when(n % 60 == 1, F.concat(F.lit("dup/doc-"), text(n - 1))).otherwise(F.concat("lang", F.lit("/doc-"), text(n)))
    content = F.when(n % 97 != 5, F.concat(front, links, F.coalesce("text", F.lit("")), pad))
    return d.select("doc_id", F.concat(path, F.lit(".md")).alias("rel_path"), content.alias("content"), content.isNull().alias("read_error"))


_WIKI = r"""
d AS (SELECT *, doc_id % 97 = 5 AS bad, doc_id % 89 = 3 AS unclosed, CASE WHEN doc_id % 60 = 1 THEN 'doc-' || (doc_id - 1) ELSE 'doc-' || doc_id END AS slug,
             CASE WHEN doc_id % 60 = 1 THEN 'dup' ELSE lang END AS dir,
             10 + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END - CASE WHEN doc_id % 89 = 3 THEN 1 ELSE 0 END + length(text) - length(replace(text, chr(10), ''))
             + CASE WHEN doc_id % 101 = 7 THEN 500 WHEN doc_id % 103 = 9 THEN 900 ELSE 0 END AS lines FROM documents),
p AS (SELECT * FROM d WHERE NOT bad),
lk AS (SELECT doc_id, slug, unnest(['doc-' || (doc_id // 2), 'doc-' || (doc_id + 1), 'nowhere-' || (doc_id % 7)]) AS target FROM p),
hit AS (SELECT lk.* FROM lk SEMI JOIN p ON lk.target = p.slug),
inb AS (SELECT target AS slug, count(DISTINCT slug) AS n FROM hit GROUP BY target),
ph AS (SELECT phrase, count(DISTINCT slug) AS n FROM (
  SELECT slug, unnest(regexp_extract_all(text, '\b([A-Z][a-zA-Z0-9]+(?:\s+[A-Z][a-zA-Z0-9]+){0,3})\b', 1)) AS phrase FROM p) GROUP BY phrase HAVING count(DISTINCT slug) >= 5)"""


@query(f"""WITH {_WIKI} SELECT slug, CASE WHEN unclosed THEN slug ELSE 'Doc ' || doc_id END AS title, CASE WHEN NOT unclosed THEN lang END AS type, CASE WHEN unclosed THEN '' ELSE source || ',all' END AS tags,
  CASE WHEN unclosed THEN '' ELSE 's' || (doc_id % 5) || ',s9' END AS sources, CASE WHEN NOT unclosed THEN '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') END AS updated,
  CAST(lines + 1 AS BIGINT) AS line_count FROM p""")
def frontmatter_fields(spark, sf_dir):
    p = parse.parse_pages(_wiki_files(spark, sf_dir).filter("not read_error"))
    return p.select("slug", "title", "type", F.array_join("tags", ",").alias("tags"), F.array_join("sources", ",").alias("sources"), "updated", "line_count")


@query(f"WITH {_WIKI} SELECT slug FROM p WHERE source = 'src1' AND doc_id % 28 >= 14 AND lang = 'en' AND NOT unclosed")
def page_filters(spark, sf_dir):
    p = parse.parse_pages(_wiki_files(spark, sf_dir).filter("not read_error"))
    return p.filter(S.Filters(type="en", tags=("src1", "all"), since="2024-01-15").column()).select("slug")


@query(f"WITH {_WIKI} SELECT rel, CASE WHEN NOT unclosed THEN lang END AS type FROM (SELECT *, dir || '/' || slug || '.md' AS rel FROM p)")
def page_types(spark, sf_dir):
    return _wiki_files(spark, sf_dir).filter("not read_error").select(F.col("rel_path").alias("rel"), parse.page_type("content").alias("type"))


_FINDINGS = f"""WITH {_WIKI},
f AS (
  SELECT 'orphans' AS category, dir || '/' || slug || '.md' AS path FROM p WHERE slug NOT IN (SELECT target FROM hit)
  UNION ALL SELECT 'broken_links', p.dir || '/' || p.slug || '.md' FROM lk JOIN p USING (doc_id) WHERE lk.target NOT IN (SELECT slug FROM p)
  UNION ALL SELECT 'oversized_hard', dir || '/' || slug || '.md' FROM p WHERE lines + 1 > 800
  UNION ALL SELECT 'oversized_soft', dir || '/' || slug || '.md' FROM p WHERE lines + 1 > 400 AND lines + 1 <= 800
  UNION ALL SELECT 'missing_frontmatter', dir || '/' || slug || '.md' FROM p WHERE NOT unclosed AND doc_id % 3 <> 0
  UNION ALL SELECT 'malformed_frontmatter', dir || '/' || slug || '.md' FROM p WHERE unclosed
  UNION ALL SELECT 'duplicate_slugs', min(dir || '/' || slug || '.md') FROM p GROUP BY slug HAVING count(*) > 1
  UNION ALL SELECT 'stale_pages', p.dir || '/' || p.slug || '.md' FROM p JOIN inb USING (slug) WHERE NOT unclosed AND n >= 3
  UNION ALL SELECT 'read_errors', dir || '/' || slug || '.md' FROM d WHERE bad)"""


@query(f"{_FINDINGS} SELECT category, count(*) AS n FROM f GROUP BY category UNION ALL SELECT 'suggested_pages', least(30, count(*)) FROM ph")
def lint_summary(spark, sf_dir):
    return Lint.summary(_lint(spark, sf_dir, 5))


@query(f"{_FINDINGS} SELECT category, path, count(*) AS n FROM f GROUP BY category, path")
def lint_findings(spark, sf_dir):
    return _lint(spark, sf_dir).groupBy("category", "path").agg(F.count("*").alias("n"))


@query(f"""{_FINDINGS}, g AS (SELECT category, count(*) AS n FROM f GROUP BY category)
SELECT category, CAST(1 + least(n, 20) + CASE WHEN n > 20 THEN 1 ELSE 0 END AS BIGINT) AS n_lines, CASE WHEN n > 20 THEN '  ... and ' || (n - 20) || ' more' END AS last FROM g""")
def lint_text_report(spark, sf_dir):
    lines = Lint.text_report(_lint(spark, sf_dir), 20)
    c = F.element_at(F.array(*map(F.lit, Lint.CATEGORIES)), (F.floor(F.col("ord") / 1000) + 1).cast("int"))
    return lines.groupBy(c.alias("category")).agg(F.count("*").alias("n_lines"), F.max(F.when(F.col("value").startswith("  ... and "), F.col("value"))).alias("last"))


def _graph_files(spark, sf_dir) -> DataFrame:
    """The link graph's pages with YAML frontmatter: types, sources and, for concepts, a graph block with its faults."""
    p = wiki(spark, sf_dir)
    n, text = F.col("page_id"), lambda c: c.cast("string")
    top = F.substring_index("rel_path", "/", 1)
    when = lambda c, a, b="": F.when(c, a if isinstance(a, Column) else F.lit(a)).otherwise(b if isinstance(b, Column) else F.lit(b))
    ref = lambda kind, k: F.concat(F.lit(kind), text(n + k))
    object_ = F.when(n % 19 == 0, F.lit("entity:nowhere")).when(n % 23 == 0, ref("source:page-", 1)).otherwise(ref("entity:page-", -1))
    fields = F.concat(
        F.lit("\n    - predicate: relates_to\n      object: "), object_, when(n % 31 == 0, "", F.concat(F.lit("\n      source: "), when(n % 29 == 0, ref("page-", -1), ref("page-", 1)))),
        when(n % 5 == 0, "", ref("\n      evidence: ev ", 0)), F.lit("\n      confidence: "), when(n % 7 == 0, "certain", "medium"), F.lit("\n      status: "), when(n % 37 == 0, "odd", "current"),
        when(n % 11 == 0, "\n      contradicts: nobody"), when(n % 41 == 0, "\n      supersedes: gone"), when(n % 13 == 0, "\n    - {predicate: dislikes, object: 'entity:page-0'}"), F.lit("\n    - not a relationship"),
    )
    graph_ = F.concat(
        F.lit("graph:\n  aliases: [alias-"), text(n % 50), F.lit("]\n  canonical: true\n"), when(n % 30 == 1, "  node_id: concept:dup\n"), when(n % 17 == 0, "", F.concat(F.lit("  relationships:"), fields, F.lit("\n"))),
    )
    front = F.concat(
        F.lit("---\ntitle: Page "), text(n), F.lit("\ntype: "), when(top == "sources", "source", "page"), when(top == "entities", "\nkind: thing"), F.lit("\ncreated: 2024-01-01\n"),
        when(top == "sources", F.concat(F.lit("raw: raw/"), text(n), F.lit("\n")), F.concat(F.lit("sources: [page-"), text(n + 1), F.lit("]\n"))), when(top == "concepts", graph_), F.lit("---\n"),
    )
    return p.select("page_id", "rel_path", F.concat(front, "body").alias("content"))


ONTOLOGY = """
node_types:
  entity: {maps_from: {type: page, kind: thing}}
  concept: {maps_from: {type: page}}
  source: {maps_from: {type: source}}
predicates:
  relates_to: {subject_types: [concept], object_types: [entity], requires_evidence: true}
"""


def _wiki_graph(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return G.from_files(_graph_files(spark, sf_dir), corpus.ontology(spark, ONTOLOGY)[0])


_KIND = "CASE WHEN {0} % 30 = 1 THEN 'concept:dup' WHEN {0} % 3 = 0 THEN 'entity:page-' || {0} WHEN {0} % 3 = 1 THEN 'concept:page-' || {0} ELSE 'source:page-' || {0} END"
_WIKI_GRAPH = f"""{_LINKS},
lost AS (SELECT page_id FROM pages WHERE page_id % 30 = 1 AND page_id <> 1),
nd AS (SELECT page_id, {_KIND.format('page_id')} AS id FROM pages ANTI JOIN lost USING (page_id)),
rl AS (
  SELECT page_id, {_KIND.format('page_id')} AS subject, 'relates_to' AS predicate,
         CASE WHEN page_id % 19 = 0 THEN 'entity:nowhere' WHEN page_id % 23 = 0 THEN 'source:page-' || (page_id + 1) ELSE 'entity:page-' || (page_id - 1) END AS object,
         CASE WHEN page_id % 31 = 0 THEN '' WHEN page_id % 29 = 0 THEN 'page-' || (page_id - 1) ELSE 'page-' || (page_id + 1) END AS source, CASE WHEN page_id % 5 = 0 THEN '' ELSE 'ev ' || page_id END AS evidence,
         CASE WHEN page_id % 7 = 0 THEN 'certain' ELSE 'medium' END AS confidence, CASE WHEN page_id % 37 = 0 THEN 'odd' ELSE 'current' END AS status FROM pages WHERE page_id % 3 = 1 AND page_id % 17 <> 0
  UNION ALL SELECT page_id, {_KIND.format('page_id')}, 'dislikes', 'entity:page-0', '', '', '', '' FROM pages WHERE page_id % 3 = 1 AND page_id % 17 <> 0 AND page_id % 13 = 0),
m AS (SELECT DISTINCT src, CAST(substr(target, 6) AS BIGINT) AS t FROM rs WHERE target IS NOT NULL AND target <> 'page-' || src),
ge AS (
  SELECT subject, predicate, object, source, evidence, confidence, status FROM rl SEMI JOIN nd USING (page_id)
  UNION ALL SELECT a.id, 'mentions', b.id, '', '', 'low', 'current' FROM m JOIN nd a ON m.src = a.page_id JOIN nd b ON m.t = b.page_id
  UNION ALL SELECT a.id, 'sourced_from', b.id, 'page-' || b.page_id, '', 'high', 'current' FROM nd a JOIN nd b ON b.page_id = a.page_id + 1 WHERE a.page_id % 3 <> 2
  UNION ALL SELECT id, 'summarizes_raw', 'raw:raw/' || page_id, '', '', 'high', 'current' FROM nd WHERE page_id % 3 = 2)"""


@query(f"WITH {_WIKI_GRAPH} SELECT id, 'page-' || page_id AS slug, 'Page ' || page_id AS title FROM nd")
def graph_build_nodes(spark, sf_dir):
    return _wiki_graph(spark, sf_dir)[1].select("id", "slug", "title")


@query(f"""WITH {_WIKI_GRAPH} SELECT DISTINCT substr(sha256(subject || chr(31) || predicate || chr(31) || object || chr(31) || source || chr(31) || evidence), 1, 24) AS id, * FROM ge""")
def graph_build_edges(spark, sf_dir):
    return _wiki_graph(spark, sf_dir)[2].select("id", "subject", "predicate", "object", "source", "evidence", "confidence", "status")


@query(f"""WITH {_WIKI_GRAPH},
ok AS (SELECT * FROM rl WHERE predicate = 'relates_to'),
al AS (SELECT 'alias-' || (page_id % 50) AS alias, id FROM nd WHERE page_id % 3 = 1),
c AS (
  SELECT 'unknown_predicates' AS name, count(*) FILTER (WHERE predicate = 'dislikes') AS n FROM rl
  UNION ALL SELECT 'broken_object_refs', count(*) FILTER (WHERE object NOT IN (SELECT id FROM nd)) FROM ok
  UNION ALL SELECT 'subject_type_mismatch', 0
  UNION ALL SELECT 'object_type_mismatch', count(*) FILTER (WHERE object LIKE 'source:%' AND object IN (SELECT id FROM nd)) FROM ok
  UNION ALL SELECT 'missing_evidence', count(*) FILTER (WHERE evidence = '') FROM ok
  UNION ALL SELECT 'missing_source_field', count(*) FILTER (WHERE source = '') FROM ok
  UNION ALL SELECT 'broken_source_refs', count(*) FILTER (WHERE source <> '' AND source NOT IN (SELECT 'page-' || page_id FROM pages WHERE page_id % 3 = 2)) FROM ok
  UNION ALL SELECT 'invalid_confidence', count(*) FILTER (WHERE confidence = 'certain') FROM ok
  UNION ALL SELECT 'invalid_status', count(*) FILTER (WHERE status = 'odd') FROM ok
  UNION ALL SELECT 'broken_contradicts', count(*) FILTER (WHERE page_id % 11 = 0) FROM ok
  UNION ALL SELECT 'broken_supersedes', count(*) FILTER (WHERE page_id % 41 = 0) FROM ok
  UNION ALL SELECT 'duplicate_node_ids', CASE WHEN (SELECT count(*) FROM lost) > 0 THEN 1 ELSE 0 END
  UNION ALL SELECT 'duplicate_canonical', 0
  UNION ALL SELECT 'alias_collisions', count(*) FROM (SELECT alias FROM al GROUP BY alias HAVING count(DISTINCT id) > 1)
  UNION ALL SELECT 'orphan_typed_nodes', count(*) FILTER (WHERE page_id % 3 = 1 AND id NOT IN (SELECT subject FROM rl SEMI JOIN nd USING (page_id) UNION SELECT object FROM rl SEMI JOIN nd USING (page_id))) FROM nd
  UNION ALL SELECT 'pages_scanned', count(*) FROM pages UNION ALL SELECT 'nodes', count(*) FROM nd)
SELECT name, CAST(n AS BIGINT) AS n FROM c""")
def graph_report(spark, sf_dir):
    onto, predicates = corpus.ontology(spark, ONTOLOGY)
    typed, nodes, edges, aliases = G.from_files(_graph_files(spark, sf_dir), onto)
    return G.summary(G.report(typed, nodes, edges, aliases, predicates), typed, nodes)


@query(f"""WITH {_WIKI_GRAPH}, st AS (SELECT page_id FROM pages ANTI JOIN lost USING (page_id) WHERE page_id % 4 = 0),
x AS (SELECT DISTINCT substr(sha256(subject || chr(31) || predicate || chr(31) || object || chr(31) || source || chr(31) || evidence), 1, 24) AS id FROM ge)
SELECT 'dirty' AS part, 'page-' || page_id AS id FROM lost WHERE page_id % 4 = 0 UNION ALL SELECT 'node', id FROM nd UNION ALL SELECT 'edge', id FROM x""")
def graph_update(spark, sf_dir):
    """Every fourth page's edges are missing and come back by an incremental update; pages without a node of their own need a rebuild."""
    typed, nodes, edges, _ = _wiki_graph(spark, sf_dir)
    fourth = F.regexp_extract(F.col("rel_path"), r"(\d+)\.md$", 1).cast("long") % 4 == 0
    changed = typed.filter(fourth).select("rel_path")
    before = edges.join(changed.select(F.col("rel_path").alias("page")), "page", "left_anti")
    n, e, dirty = G.update(nodes, before, typed, changed)
    return G.fits(n).select(F.lit("node").alias("part"), "id").unionByName(G.fits(e).select(F.lit("edge").alias("part"), "id")).unionByName(dirty.select(F.lit("dirty").alias("part"), X.slug_of("rel_path").alias("id")))


@query(f"""WITH {_GRAPH}, x AS (SELECT subject AS node, id, 'in' AS direction FROM eg WHERE object = 'nation:3' UNION ALL SELECT object, id, 'out' FROM eg WHERE subject = 'nation:3')
SELECT x.node, coalesce(c_name, s_name, r_name) AS title, count(*) AS n, min(x.id) AS first FROM x LEFT JOIN customer ON x.node = 'customer:' || c_custkey LEFT JOIN supplier ON x.node = 'supplier:' || s_suppkey
LEFT JOIN region ON x.node = 'region:' || r_regionkey GROUP BY 1, 2""")
def graph_neighbor_titles(spark, sf_dir):
    v, e = graph(spark, sf_dir)
    return G.neighbor_rows(e, v, "nation:3").select("node", "title", "n", F.array_min(F.col("edges.id")).alias("first"))


_XML = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(f"""WITH {_GRAPH},
v AS (SELECT 'region:' || r_regionkey AS id, r_name AS title, 'region' AS t FROM region UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'nation' FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, c_name, 'customer' FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'supplier' FROM supplier)
SELECT '1' || id AS ord, concat_ws(chr(10), '    <node id="' || id || '">', '      <data key="d_title">' || {_XML.format('title')} || '</data>', '      <data key="d_node_type">' || t || '</data>',
  '      <data key="d_page_type" />', '      <data key="d_path" />', '    </node>') AS value FROM v
UNION ALL SELECT '2' || id, concat_ws(chr(10), '    <edge id="' || id || '" source="' || subject || '" target="' || object || '">', '      <data key="d_predicate">' || predicate || '</data>',
  '      <data key="d_confidence" />', '      <data key="d_status">current</data>', '      <data key="d_source" />', '    </edge>') FROM eg
UNION ALL SELECT '0', concat_ws(chr(10), '<?xml version=''1.0'' encoding=''utf-8''?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">',
  {", ".join(f"""'  <key id="d_{c}" for="{k}" attr.name="{c}" attr.type="string" />'""" for k, cs in (("node", G.NODE_KEYS), ("edge", G.EDGE_KEYS)) for c in cs)}, '  <graph id="wiki" edgedefault="directed">')
UNION ALL SELECT '3', '  </graph>' || chr(10) || '</graphml>'""")
def graph_export(spark, sf_dir):
    v, e = graph(spark, sf_dir)
    return G.graphml(v, e.withColumn("status", F.lit("current")))


@query(f"""WITH {_GRAPH} SELECT id, '{{"id":"' || id || '","meta":{{"a":"' || predicate || '","b":["' || object || '",null]}},"subject":"' || subject || '"}}' AS value FROM eg""")
def graph_jsonl(spark, sf_dir):
    e = graph(spark, sf_dir)[1]
    return G.json_lines(e.select("subject", F.struct(F.array("object", F.lit(None).cast("string")).alias("b"), F.col("predicate").alias("a")).alias("meta"), "id"))


@query("SELECT 'page-' || page_id AS name, CASE WHEN page_id % 3 = 0 THEN 'entities' WHEN page_id % 3 = 1 THEN 'concepts' ELSE 'sources' END || '/page-' || page_id || '.md' AS rel_path FROM pages UNION ALL SELECT 'nowhere', NULL")
def find_pages(spark, sf_dir):
    p = wiki(spark, sf_dir)
    names = p.select(F.col("slug").alias("name")).unionByName(spark.range(1).select(F.lit("nowhere").alias("name")))
    return L.find_page(p, names)


@query(f"""WITH {_LOG}, m AS (SELECT max(seq) // 2 AS h FROM vs),
b AS (SELECT path, sha256 FROM (SELECT vs.* FROM vs, m WHERE seq <= h QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1) WHERE NOT deleted),
f AS (SELECT la.* FROM la, m WHERE seq > h)
SELECT coalesce(b.path, f.path) AS path, CASE WHEN f.path IS NULL THEN b.sha256 ELSE f.sha256 END AS sha256 FROM b FULL JOIN f ON b.path = f.path WHERE f.path IS NULL OR NOT f.deleted""")
def mirror_merge(spark, sf_dir):
    v = versions(spark, sf_dir)
    half = table(spark, sf_dir, "events").agg(F.call_function("div", F.max("event_id"), F.lit(2))).first()[0]
    old = St.as_of(v, half).select("path", "content", "sha256")
    return St.mirror(old, old.select("path", "sha256"), St.changes(v, half).select("path", "content", "sha256", "deleted"))[0].select("path", "sha256")


@query("WITH a AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 10 <> 1) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'new' WHEN a.doc_id IS NULL THEN 'stale' WHEN a.h = b.h THEN 'kept' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.doc_id = b.doc_id")
def index_sync_states(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    old = d.filter("doc_id % 10 <> 1").withColumn("h", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("h")))
    return St.stale_rows(d.filter("doc_id % 10 <> 0"), old, ["doc_id"], "h")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'unchanged' WHEN doc_id % 3 = 1 THEN 'conflict' ELSE 'stored' END AS outcome FROM documents")
def raw_put_outcomes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"))
    old = d.filter("doc_id % 3 < 2").select("path", F.when(F.col("doc_id") % 3 == 0, F.col("sha256")).otherwise(F.lit("other")).alias("sha256"))
    return St.put_raw(old, d.select("path", "sha256")).select(F.col("path").cast("long").alias("doc_id"), "outcome")


@query("SELECT event_type AS split, count(*) FILTER (WHERE user_id % 2 = 0 AND value > 50) AS baseline_passed, count(*) FILTER (WHERE user_id % 2 = 0) AS baseline_runs, count(*) FILTER (WHERE user_id % 2 = 1 AND value > 50) AS candidate_passed, count(*) FILTER (WHERE user_id % 2 = 1) AS candidate_runs FROM events GROUP BY event_type")
def pass_totals(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("split"), F.when(F.col("user_id") % 2 == 0, "baseline").otherwise("candidate").alias("variant"), F.coalesce(F.col("value") > 50, F.lit(False)).alias("passed"))
    return E.pass_totals(e)


@query("SELECT item_id, CASE WHEN row_number() OVER (ORDER BY item_id) % 2 = 1 THEN 'tune' ELSE 'test' END AS fold FROM benchmark")
def tune_test_split(spark, sf_dir):
    return E.alternate_split(table(spark, sf_dir, "benchmark").select("item_id"), "item_id")


@query(r"""SELECT doc_id, array_to_string(string_split(text, chr(10))[2:3], chr(10)) AS rest, length(text) > 140 AS long_text,
CASE WHEN length(text) > 140 THEN regexp_replace(substr(text, 1, 139), '\s+$', '') || '…' ELSE text END AS cut, substr(text, 1, 1000) AS clipped FROM documents""")
def text_slices(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", X.line_slice("text", 2, 3).alias("rest"), (F.length("text") > 140).alias("long_text"), X.truncate_evidence("text").alias("cut"), X.clip("text").alias("clipped"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def daily_counts(spark, sf_dir):
    from textloom.streaming import feed

    return feed.counts_by(table(spark, sf_dir, "events"), "ts", "event_type", "1 day", "1 hour")


@query(f"""WITH {_LOG}, t AS (SELECT event_id AS seq, 'u' || user_id AS path, event_type || ':' || coalesce(props, '') AS content FROM events), m AS (SELECT max(seq) // 2 AS h FROM vs),
b AS (SELECT path, content FROM (SELECT vs.* FROM vs, m WHERE seq <= h QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1) JOIN t USING (path, seq) WHERE NOT deleted),
a AS (SELECT path, content FROM la JOIN t USING (path, seq) WHERE NOT deleted)
SELECT path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' ELSE 'changed' END AS status,
       '--- before' || chr(10) || '+++ after' || chr(10) || '@@ -1 +1 @@' || chr(10) || '-' || coalesce(b.content, '') || chr(10) || '+' || coalesce(a.content, '') AS diff
FROM a FULL JOIN b USING (path) WHERE a.content IS DISTINCT FROM b.content""")
def snapshot_diffs(spark, sf_dir):
    """Unified diffs between two states of the log."""
    v = versions(spark, sf_dir)
    half = table(spark, sf_dir, "events").agg(F.call_function("div", F.max("event_id"), F.lit(2))).first()[0]
    return St.diff_snapshots(St.as_of(v, half).select("path", "content"), St.live(v).select("path", "content"))
