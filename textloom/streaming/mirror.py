"""A mirror of the store, kept by a stream of changes: a merge for foreachBatch whose state lasts over batches.

The state is three tables of one generation: files (path, content, sha256) as they are here, base (path, sha256) as last
synchronized, and pending (path, content, sha256, deleted, seq): changes of paths that couldn't be written yet. A batch takes the newest
change of each path, pending ones included, and

* leaves changes of blocked paths pending, so that a later batch takes them up again, unless a newer one has come;
* puts a file that was edited here aside (kept) before the change replaces it: one that differs from its base and from the change;
* writes or deletes the file, and moves its base digest with it.

Each batch writes a generation of its own and then the pointer to it, so a broken batch leaves the last generation, and a
batch that comes again (Structured Streaming repeats the last one after a failure) changes nothing. Paths that a batch
doesn't touch are copied by one full outer join on path.

Defined results: a change with a seq not above the base's is old and changes nothing; a delete of a missing file moves its base only.
Edits are kept with the batch's number, so that a path can be put aside again later.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import snapshots
from textloom.operators.store import latest

FILES = "path string, content string, sha256 string"
BASE = "path string, sha256 string, seq long"
PENDING = "path string, content string, sha256 string, deleted boolean, seq long"
KEPT = "path string, content string, sha256 string, batch long"
TABLES = {"files": FILES, "base": BASE, "pending": PENDING, "kept": KEPT}


class Mirror:
    def __init__(self, spark: SparkSession, folder: str, blocked: Callable[[], DataFrame] | None = None):
        """blocked: the paths (path) that can't be written now, asked for at every batch."""
        self.spark, self.blocked, self.store = spark, blocked, snapshots.Snapshots(spark, folder)

    def table(self, name: str) -> DataFrame:
        return self.store.table(name, TABLES[name])

    def start(self, files: DataFrame) -> None:
        """Takes files (path, content, sha256) as they are for synchronized."""
        f = files.select("path", "content", "sha256")
        self.store.publish("start", {"files": f, "base": f.select("path", "sha256", F.lit(-1).cast("long").alias("seq"))})

    def apply(self, changes: DataFrame, batch: int) -> None:
        """One micro-batch of versions. Use as foreachBatch."""
        name = f"batch-{batch}"
        if self.store.has(name):
            return
        spark, now = self.spark, changes.select("path", "content", "sha256", "deleted", "seq")
        base, files, pending, kept = (self.table(t) for t in ("base", "files", "pending", "kept"))
        new = latest(now.withColumn("rev", F.lit(0).cast("long")).unionByName(pending.withColumn("rev", F.lit(0).cast("long")))).drop("rev")
        f = new.select("path", F.col("content").alias("_c"), F.col("sha256").alias("_s"), "deleted", F.col("seq").alias("_seq"))
        j = files.join(base.select("path", F.col("sha256").alias("_b"), "seq"), "path", "full_outer").join(f, "path", "full_outer")
        blocked = (spark.createDataFrame([], "path string") if self.blocked is None else self.blocked()).select("path", F.lit(True).alias("_blocked")).distinct()
        fresh = F.col("_seq").isNotNull() & (F.col("_seq") > F.coalesce("seq", F.lit(-2)))
        j = self.store.stage(name, "joined", j.join(blocked, "path", "left").withColumn("_new", fresh).withColumn("_now", fresh & F.col("_blocked").isNull()))
        take, here = F.col("_now"), F.col("sha256").isNotNull()
        edited = take & here & ~F.col("sha256").eqNullSafe(F.col("_b")) & ~F.col("sha256").eqNullSafe(F.when(~F.col("deleted"), F.col("_s")))
        self.store.publish(name, {
            "files": j.filter((take & ~F.col("deleted")) | (~take & here)).select("path", F.when(take, F.col("_c")).otherwise(F.col("content")).alias("content"), F.when(take, F.col("_s")).otherwise(F.col("sha256")).alias("sha256")),
            "base": j.filter(take | F.col("seq").isNotNull()).select("path", F.when(take, F.when(~F.col("deleted"), F.col("_s"))).otherwise(F.col("_b")).alias("sha256"), F.when(take, F.col("_seq")).otherwise(F.col("seq")).alias("seq")),
            "pending": j.filter(F.col("_new") & ~take).select("path", F.col("_c").alias("content"), F.col("_s").alias("sha256"), "deleted", F.col("_seq").alias("seq")),
            "kept": kept.unionByName(j.filter(edited).select("path", "content", "sha256", F.lit(batch).cast("long").alias("batch"))),
        })
