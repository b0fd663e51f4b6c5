"""Helpers of the training-data operators: scratch space, skew-proof joins, components, batch iteration."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key held by more than 1/HEAVY of all rows is heavy, and so is one with more than HEAVY_ROWS rows, unless that
#: could make more than MOST_HEAVY heavy keys.
HEAVY, HEAVY_ROWS, MOST_HEAVY = 2000, 1_000_000, 100_000


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where it is unset, a local session gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="textloom-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder, so lost executors cost no recomputation."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def skew_join(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, uid: Column) -> DataFrame:
    """left LEFT JOIN right USING (key), where right has unique keys and `weight` says how many left rows hold each.

    Heavy keys are fewer than MOST_HEAVY, so they are broadcast; right's rows must be of bounded size (numbers, hashes, short
    names). Left rows of those keys go to random partitions of the second, shuffled join instead of gathering in one, and so do
    rows with a null key, which have no partner.
    Output: the columns of left, then the columns of right except key.
    """
    payload = [c for c in right.columns if c != key]
    bound = max(8, min(total // HEAVY, HEAVY_ROWS), total // MOST_HEAVY)
    heavy = right.filter(F.col(weight) > bound).select(key, *[F.col(c).alias(f"_h_{c}") for c in payload])
    # always 0, but not a constant that the optimizer would take out of the join's keys
    rest = right.filter(F.col(weight) <= bound).select(key, F.when(F.col(weight) > bound, -1).otherwise(0).alias("_salt"), *[F.col(c).alias(f"_r_{c}") for c in payload])
    salted = left.join(F.broadcast(heavy), key, "left").withColumn(
        "_salt", F.when(F.col(f"_h_{weight}").isNotNull() | F.col(key).isNull(), (F.pmod(F.xxhash64(uid), F.lit(1 << 20)) + 1).cast("int")).otherwise(F.lit(0))
    )
    joined = salted.join(rest, [key, "_salt"], "left")
    return joined.select(*left.columns, *[F.coalesce(f"_h_{c}", f"_r_{c}").alias(c) for c in payload])


def own_key(docs: DataFrame, name: str) -> DataFrame:
    """docs with a column `name`: doc_id, or a number of its own where that is null, for joins that null ids shall not gather in.

    Such a number may be some document's id: the join must ask for doc_id, too.
    """
    return docs.withColumn(name, F.coalesce(docs["doc_id"].cast("long"), -1 - F.monotonically_increasing_id()))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list: rows (node, component), component the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014): every step is a grouped minimum with map-side
    combining, and joins with it salt nodes with many neighbours; the number of edges never grows beyond nodes + edges. Nodes without edges don't appear.
    """
    cur = cut(edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).filter("lo <> hi").distinct())
    size = cur.count()
    before = None
    while True:
        both = cur.select(F.col("lo").alias("n"), "hi").unionByName(cur.select(F.col("hi").alias("n"), F.col("lo").alias("hi")))
        # large star: every larger neighbour is tied to the smallest of the neighbourhood (the node itself included)
        least = both.groupBy("n").agg(F.least("n", F.min("hi")).alias("m"), F.count("*").alias("c"))
        large = skew_join(both, least, "n", "c", 2 * size, F.col("hi")).filter("hi > n and m <> hi").select(F.col("m").alias("lo"), F.col("hi").alias("n")).distinct()
        # small star: smaller neighbours and the node itself are tied to the smallest
        low = large.groupBy("n").agg(F.min("lo").alias("m"), F.count("*").alias("c"))
        small = skew_join(large, low, "n", "c", 2 * size, F.col("lo")).select(F.col("m").alias("lo"), F.explode(F.array("lo", "n")).alias("hi"))
        cur = cut(small.filter("lo <> hi").distinct())
        size, digest = cur.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
        if (size, digest) == before:
            break
        before = size, digest
    return cur.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component")).unionByName(
        cur.select(F.col("lo").alias("node")).distinct().withColumn("component", F.col("node"))
    )


#: Labelled rows of each class that a classifier is fitted on, at most.
FIT_ROWS = 10_000


def fit_sample(labels: DataFrame, label: str, modulus: int, held_out: int, rows: int = FIT_ROWS) -> tuple[DataFrame, dict[int, float]]:
    """A bounded sample of the labelled rows outside the held-out fold, and each class's weight (all its rows / sampled).

    Rows (doc_id, y) by the smallest hashes of doc_id, at most `rows` of each class. Null labels and ids are no examples;
    a doc_id with both labels counts as 1.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus))
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold != held_out))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col(label) > 0).cast("int")).alias("y"))
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    part = lambda y: known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return cut(part(0).unionByName(part(1))), {y: n / min(n, rows) for y, n in sizes.items()}
