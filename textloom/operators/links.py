"""Link resolution, backlinks and link counts.

A bare link names a page by its slug; a link with a directory names exactly that path. Resolution is two equi joins on
distinct build sides, so no link row fans out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as X


def link_rows(pages: DataFrame) -> DataFrame:
    """One row per link of pages (rel_path, slug, links): src, src_slug, ord, raw, clean, has_slash."""
    p = pages.select(F.col("rel_path").alias("src"), F.col("slug").alias("src_slug"), F.posexplode("links").alias("ord", "raw"))
    p = p.withColumn("clean", X.clean_target("raw"))
    return p.withColumn("has_slash", F.col("clean").contains("/"))


def resolve(links: DataFrame, pages: DataFrame) -> DataFrame:
    """links with target, the slug of the page they name, or null; key: the target, or what the link says."""
    by_path = pages.select(X.without_md("rel_path").alias("_path"), F.col("slug").alias("_by_path")).dropDuplicates(["_path"])
    by_slug = pages.select(F.col("slug").alias("_by_slug")).distinct()
    j = links.withColumn("_want_path", F.when(F.col("has_slash"), F.col("clean"))).withColumn("_want_slug", F.when(~F.col("has_slash") & (F.col("clean") != ""), F.col("clean")))
    j = j.join(by_path, j["_want_path"] == by_path["_path"], "left").join(by_slug, j["_want_slug"] == by_slug["_by_slug"], "left")
    target = F.coalesce("_by_path", "_by_slug")
    return j.select(*links.columns, target.alias("target"), F.coalesce(target, "clean").alias("key"))


def backlinks(resolved: DataFrame, slug: str) -> DataFrame:
    """Pages that link to a page, each once."""
    return resolved.filter(F.col("target") == slug).select(F.col("src").alias("rel_path"), F.col("src_slug").alias("slug")).distinct()


def top_linked(resolved: DataFrame, n: int = 20) -> DataFrame:
    """Targets by how often they are linked, every occurrence counting; ties by first occurrence."""
    c = resolved.filter("key <> ''").groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("src", "ord")).alias("_first"))
    return c.orderBy(F.desc("n"), "_first").limit(n).select("key", "n")


def inbound(resolved: DataFrame) -> DataFrame:
    """slug, inbound: the distinct pages' slugs that link there."""
    return resolved.filter("target is not null").groupBy(F.col("target").alias("slug")).agg(F.countDistinct("src_slug").alias("inbound"))


def broken(resolved: DataFrame) -> DataFrame:
    return resolved.filter("target is null").select("src", "raw", "clean")


def orphans(pages: DataFrame, resolved: DataFrame) -> DataFrame:
    """Pages that no link names; a page's own link counts."""
    return pages.join(resolved.select(F.col("target").alias("slug")), "slug", "left_anti")


def find_page(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """For names (column name), a page by its whole path in any case, else the first path with that stem in any case."""
    p = pages.select("rel_path", F.lower(X.without_md("rel_path")).alias("_path"), F.lower("slug").alias("_stem"))
    w = wanted.select("name", F.lower(X.without_md("name")).alias("_name"))
    full = p.groupBy("_path").agg(F.min("rel_path").alias("_full"))
    stem = p.groupBy("_stem").agg(F.min("rel_path").alias("_first"))
    return w.join(full, w["_name"] == full["_path"], "left").join(stem, w["_name"] == stem["_stem"], "left").select("name", F.coalesce("_full", "_first").alias("rel_path"))
