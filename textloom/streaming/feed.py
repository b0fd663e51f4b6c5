"""Structured Streaming over the change feed and over page files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of Parquet files as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def drain(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Processes what is there in micro-batches and ends; a restart goes on after the last finished batch."""
    q = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def apply_changes(target: str, versions: DataFrame, batch: int) -> None:
    """Writes the newest version per path of a micro-batch as batch `batch`; writing it again gives the same folder."""
    from textloom.operators.store import latest

    latest(versions).write.mode("overwrite").parquet(f"{target}/batch={batch}")


def counts_by(df: DataFrame, time: str, key: str, window: str, late: str) -> DataFrame:
    """Windowed counts with a watermark, for append sinks."""
    return df.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
