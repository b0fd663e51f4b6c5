"""Scans hand on blocks of counts: rows by tasks and blocks, not by tasks and phrases."""

import pyarrow as pa
from pyspark.sql import functions as F

from textloom.llm import phrases


class _Value:
    def __init__(self, value):
        self.value = value


def test_a_task_makes_a_row_a_block():
    words = [f"a w{i}" for i in range(6000)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 3), pa.array([f"{w}, a w7".encode() for w in (words[7], words[5000], "b b")], pa.binary())], ["lang", "text"])
    out = list(phrases._scan("blocks", _Value({"en": (10, words)}))([batch]))
    assert sum(b.num_rows for b in out) == 2
    (counted,) = [phrases._add_scans(_Value(pa.array(range(7000)).to_numpy()))(pa.Table.from_batches([b, b])) for b in out[:1]]
    assert counted.to_pylist() == [{"id": 17, "n": 8}]


def test_counts_of_shards_and_langs(spark):
    docs = spark.range(300).select(F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 3 == 1, "y").alias("lang"), F.concat_ws(" ", F.lit("p q"), F.concat(F.lit("r"), (F.col("id") % 20).cast("string")), F.lit("p q")).alias("text")).repartition(5)
    found = spark.createDataFrame([(lang, p) for lang in ("x", "y", "und") for p in ("p q", "q r3", "q p", *(f"r{i} p" for i in range(20)))], "lang string, phrase string").withColumn("id", F.monotonically_increasing_id())
    want = {(lang, "p q"): 200 for lang in ("x", "y", "und")} | {(lang, p): 5 for lang in ("x", "y", "und") for p in ("q r3", *(f"r{i} p" for i in range(20)))}
    for size in (1000, 7):
        assert {(r.lang, r.phrase): r.a for r in phrases.scan(docs, found, size).collect()} == want
