"""Ranked retrieval: BM25, vectors, reciprocal rank fusion, per-page caps.

A single BM25 query needs no inverted index: term frequencies of its terms are expressions over a row's tokens, the
corpus statistics are one global aggregation (partial sums, one row), and the best rows come from a distributed top-k.
For many queries postings() is the index: one tokenization, kept in a folder per bucket of terms, so that a query reads
the buckets of its own terms only and scores by one grouped sum over their postings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import text as X

K1, B = 1.5, 0.75
RRF = 60
POOL = 50
MAX_DISTANCE = 0.35


def tokens_of(query: str) -> list[str]:
    import re

    return re.findall(X.TOKEN, query.lower())


def _times(tokens: str, term: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t == F.lit(term)))


def bm25(rows: DataFrame, text: str, query: str, where: Column | None = None, scope: str = "filtered", distinct_terms: bool = False, k1: float = K1, b: float = B) -> DataFrame:
    """rows with a positive score, and the column score.

    where: which rows may be found. scope "filtered": statistics of those rows only; "index": of all rows.
    A repeated query term counts again, unless distinct_terms.
    """
    terms = tokens_of(query)
    if distinct_terms:
        terms = list(dict.fromkeys(terms))
    if not terms:
        return rows.withColumn("score", F.lit(0.0)).limit(0)
    unique = list(dict.fromkeys(terms))
    base = rows if where is None or scope == "index" else rows.filter(where)
    counted = base.withColumn("_tokens", X.tokenize(text))
    counted = counted.select(
        *rows.columns, F.size("_tokens").alias("_dl"),
        *[_times("_tokens", w).alias(f"_tf{i}") for i, w in enumerate(unique)],
    )
    stats = counted.agg(F.count("*").alias("_n"), F.avg("_dl").alias("_avg"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(unique))])
    if where is not None and scope == "index":
        counted = counted.filter(where)
    hit = counted.filter(F.greatest(F.lit(0), *[F.col(f"_tf{i}") for i in range(len(unique))]) > 0).crossJoin(F.broadcast(stats))  # stats is one row
    score = F.lit(0.0)
    for t in terms:
        i = unique.index(t)
        tf, df = F.col(f"_tf{i}"), F.col(f"_df{i}")
        idf = F.log(1 + (F.col("_n") - df + 0.5) / (df + 0.5))
        length = 1 - b + b * F.when(F.col("_avg") > 0, F.col("_dl") / F.col("_avg")).otherwise(F.lit(1.0))
        score = score + F.when(tf > 0, idf * (tf * (k1 + 1)) / (tf + k1 * length)).otherwise(F.lit(0.0))
    return hit.select(*rows.columns, score.alias("score")).filter("score > 0")


def term_counts(tokens: Column | str) -> Column:
    """A row's (term, tf) of each of its terms: equal tokens are neighbours after sorting, so it is linear in the row."""

    def runs(order: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(order) - 1), lambda i: (i == 0) | (F.get(order, i) != F.get(order, i - 1)))
        return X.let(starts, lambda ps: F.transform(ps, lambda p, i: F.struct(F.get(order, p).alias("term"), (F.coalesce(F.get(ps, i + 1), F.size(order)) - p).alias("tf"))))

    return F.when(F.size(tokens) > 0, X.let(F.sort_array(tokens), runs)).otherwise(F.array().cast("array<struct<term:string,tf:int>>"))


def postings(rows: DataFrame, key: list[str], text: str) -> tuple[DataFrame, DataFrame]:
    """(postings: key, term, tf, dl; rows: key, dl) as tables to keep. Terms are counted within their row: nothing is shuffled."""
    t = rows.select(*key, X.tokenize(text).alias("_t")).select(*key, F.size("_t").alias("dl"), term_counts("_t").alias("_r"))
    # of a plain inline() Spark asks first whether the array is empty, and so counts and tokenizes each row again
    return t.select(*key, "dl", F.inline_outer("_r")).filter("term is not null").select(*key, "term", "tf", "dl"), rows.select(*key, F.size(X.tokenize(text)).alias("dl"))


def bucket_of(term: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_postings(posts: DataFrame, path: str, buckets: int = 64) -> None:
    """Postings in folders by bucket of the term, sorted by term: a query's terms prune folders, and row groups within."""
    p = posts.withColumn("bucket", bucket_of("term", buckets))
    # a frequent term's postings may be most of a bucket, so a bucket is dealt to several tasks
    p.repartition("bucket", F.pmod(F.xxhash64(*[c for c in posts.columns if c not in ("term", "tf", "dl")]), F.lit(8))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)


def bm25_postings(posts: DataFrame, docs: DataFrame, key: list[str], query: str, allowed: DataFrame | None = None, scope: str = "filtered", buckets: int | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """key, score as bm25() gives them, from postings. allowed: the keys that may be found.

    The query's terms are a handful: their postings are filtered, counted by term, and summed by key.
    """
    terms = tokens_of(query)
    wanted = F.col("term").isin(*dict.fromkeys(terms)) if terms else F.lit(False)
    if buckets is not None and terms:
        spark = posts.sparkSession
        ids = [r[0] for r in spark.range(1).select(F.explode(F.array(*map(F.lit, dict.fromkeys(terms)))).alias("t")).select(bucket_of("t", buckets)).distinct().collect()]
        wanted &= F.col("bucket").isin(*ids)
    hits = posts.filter(wanted).select(*key, "term", "tf", "dl")
    among = docs
    if allowed is not None and scope == "filtered":
        hits, among = hits.join(allowed.select(*key), key, "left_semi"), docs.join(allowed.select(*key), key, "left_semi")
    stats = among.agg(F.count("*").alias("_n"), F.avg("dl").alias("_avg"))  # one row
    df = hits.groupBy("term").agg(F.count("*").alias("_df"))  # a row per query term
    if allowed is not None and scope != "filtered":
        hits = hits.join(allowed.select(*key), key, "left_semi")
    times = F.lit(0)
    for t in dict.fromkeys(terms):
        times = F.when(F.col("term") == t, terms.count(t)).otherwise(times)
    j = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    length = 1 - b + b * F.when(F.col("_avg") > 0, F.col("dl") / F.col("_avg")).otherwise(F.lit(1.0))
    part = times * idf * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * length)
    return j.groupBy(*key).agg(F.sum(part).alias("score")).filter("score > 0")


def document_frequencies(rows: DataFrame, text: str) -> DataFrame:
    """term, df, cf: documents and places of every term, by one aggregation of the rows' own counts."""
    t = rows.select(X.tokenize(text).alias("_t")).select(F.inline_outer(term_counts("_t"))).filter("term is not null")
    return t.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def top(scored: DataFrame, n: int, score: str = "score", *ties: str) -> DataFrame:
    """The best n rows with rank 1..n; ties by the given columns."""
    best = scored.orderBy(F.desc(score), *ties).limit(n)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc(score), *ties)))


def nearest(vectors: DataFrame, embedding: str, query: DataFrame, n: int = POOL, where: Column | None = None, post_filter: bool = False, cutoff: float | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """Exact nearest rows by cosine distance, with distance and rank. query: one row, its first column the vector.

    where before the top n (only allowed rows compete), or after it (post_filter: fewer rows may be left).
    """
    q = query.select(F.col(query.columns[0]).alias("_q")).limit(1)
    v = vectors if where is None or post_filter else vectors.filter(where)
    scored = v.crossJoin(F.broadcast(q)).withColumn("distance", 1 - X.cosine(embedding, "_q")).filter("distance is not null").drop("_q")
    best = scored.orderBy("distance", *ties).limit(n)
    if where is not None and post_filter:
        best = best.filter(where)
    if cutoff is not None:
        best = best.filter(F.col("distance") <= cutoff)
    return best.withColumn("rank", F.row_number().over(W.orderBy("distance", *ties)))


def fuse(lexical: DataFrame, semantic: DataFrame, key: list[str], k: int = RRF) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (key, rank): score, retrievers, rank. Ties keep lexical, then semantic order."""
    a = lexical.select(*key, F.col("rank").alias("_l"))
    b = semantic.select(*key, F.col("rank").alias("_s"))
    j = a.join(b, key, "full_outer")
    score = F.coalesce(1 / (F.lit(k) + F.col("_l")), F.lit(0.0)) + F.coalesce(1 / (F.lit(k) + F.col("_s")), F.lit(0.0))
    j = j.select(
        *key, score.alias("score"), F.array_compact(F.array(F.when(F.col("_l").isNotNull(), "lexical"), F.when(F.col("_s").isNotNull(), "vector"))).alias("retrievers"),
        F.coalesce("_l", F.lit(1_000_000) + F.col("_s")).alias("_ord"),
    )
    return j.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "_ord"))).drop("_ord")


def cap_per_page(ranked: DataFrame, page: str, per_page: int, n: int) -> DataFrame:
    """The first per_page hits of every page in rank order, then the first n, ranked anew."""
    own = ranked.withColumn("_k", F.row_number().over(W.partitionBy(page).orderBy("rank"))).filter(F.col("_k") <= per_page).drop("_k")
    best = own.orderBy("rank").limit(n)
    return best.withColumn("rank", F.row_number().over(W.orderBy("rank")))


@dataclass(frozen=True)
class Filters:
    type: str | None = None
    tags: tuple[str, ...] = ()
    since: str | None = None

    def column(self) -> Column | None:
        parts = []
        if self.type:
            parts.append(F.coalesce(F.col("type") == self.type, F.lit(False)))
        if self.tags:
            parts.append(X.has_all(list(self.tags), "tags"))
        if self.since:
            parts.append(X.since("updated", self.since))
        out = None
        for p in parts:
            out = p if out is None else out & p
        return out


def search(sections: DataFrame, query: str, filters: Filters = Filters(), n: int = 10, per_page: int = 3, vectors: DataFrame | None = None, query_vector: DataFrame | None = None, scope: str = "filtered", cutoff: float = MAX_DISTANCE) -> DataFrame:
    """The evidence rows of a search over section rows; hybrid if vectors (rel_path, section_index, embedding) are given.

    Without a usable vector side the result is the lexical one.
    """
    key = ["rel_path", "section_index"]
    where = filters.column()
    lex = bm25(sections, "searchable_text", query, where, scope)
    if vectors is None or query_vector is None:
        ranked = top(lex.select(*key, "score"), max(POOL, n * per_page), "score", *key).withColumn("retrievers", F.array(F.lit("lexical")))
    else:
        allowed = sections if where is None else sections.filter(where)
        own = vectors.join(allowed.select(*key), key, "left_semi")
        near = nearest(own, "embedding", query_vector, POOL, cutoff=cutoff, ties=tuple(key))
        ranked = fuse(top(lex.select(*key, "score"), POOL, "score", *key), near, key)
    picked = cap_per_page(ranked, "rel_path", per_page, n)
    rows = sections.join(F.broadcast(picked), key)  # at most n rows
    return rows.select(
        "rank", "slug", "rel_path", "type", "title", "heading_path", "section_index", F.round("score", 4).alias("score"), "retrievers",
        X.snippet("text").alias("snippet"), "updated", "tags", "sources", "neighbors",
    ).orderBy("rank")


def search_pages(pages: DataFrame, query: str, filters: Filters = Filters(), n: int = 10) -> DataFrame:
    """Lexical search at page granularity."""
    return top(bm25(pages, "body", query, filters.column()).select("rel_path", "slug", "title", "type", "score"), n, "score", "rel_path")
