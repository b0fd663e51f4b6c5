"""Structural findings and corpus statistics over parsed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import links as L
from textloom.operators.graph import first_k

SOFT, HARD = 400, 800
REQUIRED = ("type", "title", "tags", "created", "updated")
STALE_DAYS, STALE_INBOUND = 90, 3
# Phrases that begin with one of these are section headers, not names.
HEADERS = ("Section", "Where", "Sources", "Tags", "Type", "Title")
PHRASE = r"(?U)\b([A-Z][a-zA-Z0-9]+(?:\s+[A-Z][a-zA-Z0-9]+){0,3})\b"
#: What report() reads of pages, and what it reads for suggested pages besides: to be chosen before pages are kept, so that sections aren't parsed.
READ, READ_BY_PHRASES = ("rel_path", "slug", "meta", "malformed", "line_count", "links", "updated", "read_error"), ("title", "body")
CATEGORIES = ("orphans", "broken_links", "oversized_hard", "oversized_soft", "missing_frontmatter", "malformed_frontmatter", "duplicate_slugs", "stale_pages", "suggested_pages", "read_errors")


def oversized(pages: DataFrame, soft: int = SOFT, hard: int = HARD) -> DataFrame:
    c = F.when(F.col("line_count") > hard, "oversized_hard").when(F.col("line_count") > soft, "oversized_soft")
    return pages.select("rel_path", "line_count", c.alias("category")).filter("category is not null")


def duplicate_slugs(pages: DataFrame, most: int = 50) -> DataFrame:
    """slug, n, paths (the first ones) of slugs that several pages have."""
    return first_k(pages.select("slug", "rel_path").distinct(), ["slug"], ["rel_path"], most, "paths").filter("n > 1")


def missing_fields(pages: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    empty = lambda f: F.size(F.filter(F.coalesce(F.col("meta")[f]["items"], F.array().cast("array<string>")), lambda v: v != "")) == 0
    missing = F.array_compact(F.array(*[F.when(empty(f), f) for f in required]))
    return pages.select("rel_path", missing.alias("missing")).filter(F.size("missing") > 0)


def stale(pages: DataFrame, resolved: DataFrame, today: str, days: int = STALE_DAYS, at_least: int = STALE_INBOUND) -> DataFrame:
    p = pages.select("rel_path", "slug", X.age_days("updated", today).alias("age")).filter(F.col("age") > days)
    return p.join(L.inbound(resolved), "slug").filter(F.col("inbound") >= at_least)


def phrases(rows: DataFrame, text: str, page: str, at_least: int, known: DataFrame | None = None, n: int = 30) -> DataFrame:
    """Capitalized phrases on many pages: phrase, page_count, pages (the first five). Ties by phrase.

    known: rows (name) in lower case that already have a page.
    """
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.col(text), F.lit(PHRASE), F.lit(1)), lambda p: F.trim(p)))
    each = rows.select(page, F.explode(found).alias("phrase")).filter(~F.substring_index(F.regexp_replace("phrase", r"\s+", " "), " ", 1).isin(*HEADERS)).distinct()
    counts = each.groupBy("phrase").agg(F.count("*").alias("page_count")).filter(F.col("page_count") >= at_least)
    if known is not None:
        counts = counts.join(known.select(F.col("name").alias("_known")), F.lower("phrase") == F.col("_known"), "left_anti")
    best = counts.orderBy(F.desc("page_count"), "phrase").limit(n)
    # the pages are looked up for at most n phrases; five per phrase are kept by a ranked window, not a collected list
    from pyspark.sql import Window as W

    first = each.join(F.broadcast(best), "phrase").withColumn("_k", F.row_number().over(W.partitionBy("phrase").orderBy(page))).filter("_k <= 5")
    return first.groupBy("phrase", "page_count").agg(F.sort_array(F.collect_list(page)).alias("pages"))


def report(pages: DataFrame, today: str, suggest_min: int | None = None) -> DataFrame:
    """All findings as rows (category, path, detail). Unreadable pages (read_error) are findings of that kind only."""
    unreadable = pages.filter("read_error") if "read_error" in pages.columns else pages.limit(0)
    pages = pages.filter("not read_error") if "read_error" in pages.columns else pages
    resolved = L.resolve(L.link_rows(pages), pages)
    row = lambda df, category, path, detail: df.select(F.lit(category).alias("category") if isinstance(category, str) else category.alias("category"), path.alias("path"), detail.cast("string").alias("detail"))
    parts = [
        row(L.orphans(pages, resolved), "orphans", F.col("rel_path"), F.col("slug")),
        row(L.broken(resolved), "broken_links", F.col("src"), F.col("raw")),
        row(oversized(pages), F.col("category"), F.col("rel_path"), F.col("line_count")),
        row(missing_fields(pages.filter("not malformed")), "missing_frontmatter", F.col("rel_path"), F.array_join("missing", ",")),
        row(pages.filter("malformed"), "malformed_frontmatter", F.col("rel_path"), F.lit("")),
        row(duplicate_slugs(pages), "duplicate_slugs", F.get("paths", 0), F.array_join("paths", ",")),
        row(stale(pages, resolved, today), "stale_pages", F.col("rel_path"), F.col("age")),
        row(unreadable, "read_errors", F.col("rel_path"), F.lit("not UTF-8")),
    ]
    if suggest_min is not None:
        known = pages.select(F.explode(F.array(F.lower("title"), F.lower(F.replace("slug", F.lit("-"), F.lit(" "))))).alias("name")).distinct()
        parts.append(row(phrases(pages, "body", "slug", suggest_min, known), "suggested_pages", F.get("pages", 0), F.concat_ws(":", "phrase", "page_count")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def summary(findings: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """category, n, with zeros."""
    names = findings.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, categories))).alias("category"))
    return names.join(findings.groupBy("category").agg(F.count("*").alias("n")), "category", "left").fillna(0, ["n"])


#: What a text report calls a category.
LABELS = {
    "orphans": "Pages that no page links to", "broken_links": "Links to no page", "oversized_hard": "Too long, to be split", "oversized_soft": "Long", "missing_frontmatter": "Frontmatter fields missing",
    "malformed_frontmatter": "Frontmatter that does not end", "duplicate_slugs": "Several pages of one name", "stale_pages": "Much linked, but not updated", "read_errors": "Unreadable pages", "suggested_pages": "Names without a page",
}


def text_report(findings: DataFrame, most: int = 50) -> DataFrame:
    """Lines (ord, value) of a report: per category with findings its label and number, the first of them, and how many more; sort by ord."""
    g = first_k(findings.select("category", "path", F.coalesce("detail", F.lit("")).alias("detail")), ["category"], ["path", "detail"], most, "first")
    place = F.create_map(*[x for i, c in enumerate(CATEGORIES) for x in (F.lit(c), F.lit(i))])[F.col("category")]
    label = F.coalesce(F.create_map(*[x for c, v in LABELS.items() for x in (F.lit(c), F.lit(v))])[F.col("category")], F.col("category"))
    items = F.transform("first", lambda x: F.concat(F.lit("  - "), x["path"], F.when(x["detail"] == "", "").otherwise(F.concat(F.lit(": "), x["detail"]))))
    more = F.when(F.col("n") > most, F.array(F.concat(F.lit("  ... and "), F.col("n") - most, F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    lines = g.select(F.coalesce(place, F.lit(99)).alias("c"), F.posexplode(F.concat(F.array(F.concat(label, F.lit(" ("), "n", F.lit("):"))), items, more)).alias("i", "value"))
    return lines.select((F.col("c") * 1000 + F.col("i")).alias("ord"), "value")


def totals(pages: DataFrame) -> DataFrame:
    """One row of corpus statistics over (line_count, word_count, n_links)."""
    t = pages.agg(F.count("*").alias("pages"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("lines"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"), F.coalesce(F.sum("n_links"), F.lit(0)).alias("links"))
    per = lambda c: F.when(F.col("pages") > 0, F.call_function("div", F.col(c), F.col("pages")))
    return t.select("*", per("lines").alias("avg_lines"), per("words").alias("avg_words"), F.when(F.col("pages") > 0, F.round(F.col("links") / F.col("pages"), 1)).alias("link_density"))


def shares(pages: DataFrame, by: str) -> DataFrame:
    return pages.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by)


def largest(pages: DataFrame, path: str = "rel_path", n: int = 10) -> DataFrame:
    """The longest pages with their verdict; ties by path, the last first."""
    cap = F.when(F.col("line_count") > HARD, "over_hard_cap").when(F.col("line_count") > SOFT, "over_soft_cap").otherwise("")
    return pages.select(path, "line_count", cap.alias("verdict")).orderBy(F.desc("line_count"), F.desc(path)).limit(n)


def scaling_advice(total_pages, index_lines, has_shards):
    """What a corpus of this size should do, as a column."""
    return (
        F.when(total_pages < 50, "flat")
        .when((total_pages < 150) & (index_lines < 300), "single_index")
        .when(((total_pages >= 150) | (index_lines >= 300)) & ~has_shards, "shard")
        .when(total_pages >= 300, "search_fallback")
        .otherwise("sharded")
    )
