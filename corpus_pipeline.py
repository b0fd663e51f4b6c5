"""The training-data pipeline: stages over `documents`, each written as Parquet and read again as the next one's input.

All stages keep extra columns, whatever their names, and give an empty result for an empty table. Rows with a null doc_id
are judged by the rules and for contamination like others; line dedup and the join leave them as they are. Repeated rows
are judged one by one, and each is kept or dropped as its text says; of rows with one doc_id but different texts, too.
Very long texts are treated whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontamination, line_dedup, ngram_join, packing, quality_rules
from textloom.llm._shared import fresh_path
from textloom.llm.queries import tokenizer_path
from textloom.runtime import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; null and empty texts go."""
    ship(spark)
    return quality_rules.clean(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; those with no word left go. n_chars follows the text."""
    ship(spark)
    kept = line_dedup.shorten(docs).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.select(*[F.length("text").cast("long").alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: the smallest doc_id, with all of its rows."""
    ship(spark)
    return ngram_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item: no item's tiles cover half of it. Items without id or text are none."""
    ship(spark)
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: Executors and their Python workers still hold memory of the stages before, so packing has a smaller cache of tokens here.
CACHE_ENTRIES = 100_000


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, as packing.pack gives them."""
    ship(spark)
    return packing.pack(docs, tokenizer_path(), entries=CACHE_ENTRIES)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]

#: Tokens and tilings can't be had in SQL; the tests compare run()'s rows with the stages in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = fresh_path(spark, f"stage{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
