"""Line dedup's choice of lines by the keys that recur."""

from pyspark.sql import functions as F

from textloom.llm import line_dedup


def test_plans_stay_short_whatever_the_number_of_nodes(spark):
    """The nodes' marks were a literal of the plan, written out in each of its texts."""
    docs = spark.createDataFrame([(i, f"item {i} was moved to shelf {i}\nthe same line in each of them") for i in range(8)], "doc_id long, text string")
    filed = line_dedup._filed(docs, line_dedup.LIMITS)
    own = filed.select(F.explode("l.node").alias("key")).distinct()
    keys = own.unionByName(spark.range(50_000).select((F.col("id") * 4 + line_dedup._NODE).alias("key")))
    opened = line_dedup._opened(filed, keys, line_dedup.LIMITS)
    assert len(opened._jdf.queryExecution().toString()) < 500_000
    assert opened.select("uid", "i").distinct().count() == 16
    # tasks read the marks where they are: no row carries them
    plan = opened._jdf.queryExecution().executedPlan().toString()
    assert "AS _marks" not in plan


def test_lines_are_chosen_by_their_keys(spark):
    docs = spark.createDataFrame([(i, "\n".join(f"line number {'abcdefgh'[j % 8] * (1 + j // 8)} of text {'uvwxyz'[i]}" for j in range(40))) for i in range(6)], "doc_id long, text string")
    filed = line_dedup._filed(docs, line_dedup.LIMITS).checkpoint()
    keys = filed.filter("doc_id = 3").select(F.explode("l.k").alias("key")).distinct()
    got = line_dedup._kept(filed, keys, "k", ["i", "k"]).select("doc_id", F.explode("l").alias("x")).select("doc_id", "x.i", F.col("x.k").alias("key"))
    assert got.join(keys, "key", "left_semi").count() == 40
    every = filed.select(F.explode("l.k").alias("key")).join(keys, "key", "left_semi")
    assert every.count() == 40 and got.count() < 80
