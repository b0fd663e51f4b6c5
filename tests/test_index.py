"""The maintained index against a search without one."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import search as S
from textloom.operators.index import Index

ROWS = "key string, text string"


def scores(df):
    return {r.key: round(r.score, 9) for r in df.collect()}


@pytest.mark.parametrize("share", [0.3, 100.0])
def test_equal_to_a_rebuild_after_edits(spark, tmp_path, share):
    r = random.Random(3)
    words = "river heron stone lake bank reed moon fish boat rain".split()
    text = lambda: " ".join(r.choice(words) for _ in range(r.randint(0, 12)))
    index, have = Index(spark, str(tmp_path / "index"), "key", buckets=4, share=share), {}
    assert scores(index.search("heron")) == {}
    first = None
    for step in range(4):
        change = {f"d{i}": text() for i in r.sample(range(14), 14 if step == 0 else 4)} | ({"null": None} if step == 1 else {})
        gone = r.sample(sorted(have), min(len(have), 3)) if step else []
        rows = [*change.items(), (None, "heron heron")]
        index.update(spark.createDataFrame(rows, ROWS), "text", spark.createDataFrame([(k,) for k in gone], "key string") if gone else None)
        have = {k: t for k, t in (have | change).items() if k not in gone and t is not None}
        first = first or (index.store.current(), dict(have))
        frame = spark.createDataFrame(list(have.items()), ROWS)
        for query in ("heron lake", "heron heron moon", "absent", ""):
            assert scores(index.search(query)) == scores(S.bm25(frame, "text", query)), (step, query)
        m = index.manifest()
        assert m["n"] == len(have) and m["dl"] == sum(len(t.split()) for t in have.values())
        assert {x.key: x.dl for x in index.rows().collect()} == {k: len(t.split()) for k, t in have.items()}
    some = spark.createDataFrame([(k,) for k in sorted(have)[::2]], "key string")
    assert scores(index.search("heron lake", some)) == scores(S.bm25(frame, "text", "heron lake", F.col("key").isin(sorted(have)[::2]), scope="index"))
    pin, before = first
    assert scores(index.search("heron lake", pin=pin)) == scores(S.bm25(spark.createDataFrame(list(before.items()), ROWS), "text", "heron lake"))
    merged = any("merged" in x for x in index.folders("heron lake moon fish"))
    assert merged == (share < 1)


def test_reads_its_terms_buckets_only(spark, tmp_path):
    index = Index(spark, str(tmp_path / "index"), "key", buckets=32)
    index.update(spark.createDataFrame([(f"d{i}", f"w{i} all") for i in range(40)], ROWS))
    assert len(index.folders("w3")) == 1 and len(index.folders("w3 all")) <= 2
    read = index.search("w3")
    assert len(read.inputFiles()) <= 4 and scores(read).keys() == {"d3"}
    assert "d3" in scores(index.search("all")) and len(scores(index.search("all"))) == 40


def test_unchanged_rows_write_nothing(spark, tmp_path):
    index = Index(spark, str(tmp_path / "index"), "key", buckets=4)
    rows = spark.createDataFrame([("a", "one two"), ("b", "two")], ROWS)
    index.update(rows)
    before = index.manifest()
    index.update(rows)
    after = index.manifest()
    assert after["postings"] == before["postings"] and after["version"] == 2 and scores(index.search("two")).keys() == {"a", "b"}
