"""Corpus sources: scans of Markdown trees, the parse cache, import and raw scans, configuration, and sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.sources import parse

# What each tool leaves out of a corpus.
SEARCH_SKIP_FILES = ("index.md", "log.md", "SCHEMA.md")
LINT_SKIP_FILES = ("index.md", "log.md", "SCHEMA.md", "README.md")
SKIP_DIRS = ("indexes", "graph", "raw", ".evolution", ".wiki-cache")
MAX_FILE = 1_500_000


def files(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """rel_path, bytes, size, sha256 of every file under root."""
    base = root.rstrip("/")
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(base)
    marker = base.split("://")[-1].lstrip("/") if "://" in base else base.lstrip("/")
    rel = F.regexp_replace("path", r"^[a-z]+:/*", "")
    return f.select(F.substring(rel, F.lit(len(marker) + 2), F.length(rel)).alias("rel_path"), F.col("content").alias("bytes"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def decoded(raw: DataFrame) -> DataFrame:
    """raw with content (null where the bytes aren't UTF-8)."""
    return raw.withColumn("content", F.try_validate_utf8(F.col("bytes").cast("string")))


def pages(spark: SparkSession, root: str, skip_files: tuple[str, ...] = SEARCH_SKIP_FILES, skip_dirs: tuple[str, ...] = SKIP_DIRS) -> DataFrame:
    """rel_path, content, sha256 of readable pages."""
    f = decoded(files(spark, root)).filter(X.searchable("rel_path", skip_files, skip_dirs))
    return f.filter("content is not null").select("rel_path", "content", "sha256")


def lint_pages(spark: SparkSession, root: str) -> DataFrame:
    """Parsed pages, unreadable ones kept with read_error."""
    f = decoded(files(spark, root)).filter(X.searchable("rel_path", LINT_SKIP_FILES, SKIP_DIRS))
    return parse.parse_pages(f.select("rel_path", "content", F.col("content").isNull().alias("read_error")))


def parse_incremental(current: DataFrame, cache: DataFrame | None) -> DataFrame:
    """Parsed pages of current (rel_path, content, sha256); rows of the cache with the same digest are reused."""
    if cache is None:
        return parse.parse_pages(current)
    same = current.select("rel_path", "sha256")
    return cache.join(same, ["rel_path", "sha256"], "left_semi").unionByName(parse.parse_pages(current.join(cache.select("rel_path", "sha256"), ["rel_path", "sha256"], "left_anti")))


def import_scan(raw: DataFrame, generated: tuple[str, ...] = ("index.md", "log.md")) -> DataFrame:
    """rel_path, reason (null: importable) of files. Rows may have the column link: symbolic links aren't imported."""
    d = decoded(raw)
    link = F.coalesce(F.col("link"), F.lit(False)) if "link" in raw.columns else F.lit(False)
    reason = (
        F.when(link, "symlink").when(~F.lower("rel_path").endswith(".md"), "not_text").when(F.col("rel_path").isin(*generated), "generated").when(F.col("size") > MAX_FILE, "too_large")
        .when(F.col("content").isNull(), "not_utf8").otherwise(X.path_error("rel_path"))
    )
    return d.select("rel_path", "sha256", reason.alias("reason"))


def raw_scan(spark: SparkSession, root: str) -> DataFrame:
    """rel_path, size, sha256 of every file under a folder of sources, but for hidden ones."""
    return files(spark, root, "*").filter(~F.exists(F.split("rel_path", "/"), lambda p: p.startswith("."))).select("rel_path", "size", "sha256")


def snapshot_hash(listing: DataFrame) -> DataFrame:
    """One row: files and the digest of a listing (rel_path, sha256), whatever its order."""
    h = F.sha2(F.concat_ws("\0", "rel_path", "sha256"), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")) for i in range(8)]
    return listing.agg(F.count("*").alias("files"), F.sha2(F.concat_ws(":", *[F.coalesce(p, F.lit(0).cast("decimal(38,0)")).cast("string") for p in parts]), 256).alias("digest"))


def compare_listings(a: DataFrame, b: DataFrame) -> DataFrame:
    """rel_path, state of files that differ between two listings: removed, added or changed."""
    j = a.select("rel_path", F.col("sha256").alias("_a")).join(b.select("rel_path", F.col("sha256").alias("_b")), "rel_path", "full_outer")
    return j.filter("not (_a <=> _b)").select("rel_path", F.when(F.col("_b").isNull(), "removed").when(F.col("_a").isNull(), "added").otherwise("changed").alias("state"))


def ontology(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """(node type rules, predicates) of an ontology in YAML: a configuration, so small."""
    import yaml

    o = yaml.safe_load(text) or {}
    rules = []
    for i, (name, spec) in enumerate((o.get("node_types") or {}).items()):
        maps = (spec or {}).get("maps_from") or {}
        rules.append((name, maps.get("type"), maps.get("kind"), bool((spec or {}).get("explicit_only")), i))
    preds = [(n, list((s or {}).get("subject_types") or []), list((s or {}).get("object_types") or []), bool((s or {}).get("requires_evidence", True))) for n, s in (o.get("predicates") or {}).items()]
    return (
        spark.createDataFrame(rules, "node_type string, type string, kind string, explicit_only boolean, ord int"),
        spark.createDataFrame(preds, "predicate string, subject_types array<string>, object_types array<string>, requires_evidence boolean"),
    )


def questions(spark: SparkSession, text: str) -> DataFrame:
    """name, threshold, spec of the decision questions in JSON."""
    return spark.createDataFrame([(k, float(v.get("threshold", 0.5)), json.dumps(v, sort_keys=True)) for k, v in json.loads(text).items()], "name string, threshold double, spec string")


def write_snapshot(df: DataFrame, root: str, snapshot: int, partition_by: list[str] | None = None) -> str:
    """Writes one immutable snapshot folder and returns it; readers change over by the path they are given."""
    path = f"{root.rstrip('/')}/snapshot={snapshot}"
    w = df.write.mode("errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return path


def envelope(results: DataFrame, query: str, mode: str, granularity: str = "section") -> DataFrame:
    """One row: the result list as one JSON text (a top-k, so bounded)."""
    rows = results.agg(F.sort_array(F.collect_list(F.struct(*results.columns))).alias("results"))
    return rows.select(F.to_json(F.struct(F.lit(query).alias("query"), F.lit(granularity).alias("granularity"), F.lit(mode).alias("mode"), "results")).alias("value"))
