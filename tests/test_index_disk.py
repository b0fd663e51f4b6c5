"""What an index's updates put on disk beside the index, and merges of its buckets by either way."""

import os
import random

import pytest

from textloom.operators import index as I
from textloom.operators import search as S

ROWS = "key string, text string"


def held(folder):
    return sum(os.path.getsize(f"{d}/{x}") for d, _, names in os.walk(folder) for x in names)


def test_updates_keep_no_copy_of_texts_or_postings(spark, tmp_path):
    r = random.Random(5)
    rows = [(f"d{i}", " ".join("%06x" % r.randrange(1 << 24) for _ in range(400))) for i in range(200)]
    shared = spark.conf.get("spark.checkpoint.dir")
    index, before = I.Index(spark, str(tmp_path / "index"), "key", buckets=2), held(shared)
    index.update(spark.createDataFrame(rows, ROWS))
    index.update(spark.createDataFrame([(k, t[::-1]) for k, t in rows[:40]], ROWS))
    assert held(shared) - before < sum(len(t) for _, t in rows) / 4
    assert index.manifest()["n"] == 200


@pytest.mark.parametrize("most, share", [(0, 0.1), (1000, 0.1), (1000, 0.45)])
def test_merges(spark, tmp_path, monkeypatch, most, share):
    monkeypatch.setattr(I, "MOST_KEYS", most)
    r = random.Random(6)
    text = lambda: " ".join(r.choice("river heron stone lake bank".split()) for _ in range(r.randint(0, 6)))
    index, have, merged = I.Index(spark, str(tmp_path / "index"), "key", buckets=2, share=share), {}, set()
    for step in range(4):
        change = {f"d{i}": text() for i in r.sample(range(9), 9 if step == 0 else 2)}
        gone = r.sample(sorted(have), 2) if step in (1, 3) else []
        # the largest text of a key counts
        rows = [x for k, t in change.items() for x in ((k, t), (k, t[:-1]))]
        index.update(spark.createDataFrame(rows, ROWS), "text", spark.createDataFrame([(k,) for k in gone], "key string") if gone else None)
        have = {k: t for k, t in (have | change).items() if k not in gone}
        want = S.bm25(spark.createDataFrame(list(have.items()), ROWS), "text", "heron lake bank").collect()
        assert {x.key: round(x.score, 9) for x in index.search("heron lake bank").collect()} == {x.key: round(x.score, 9) for x in want}, step
        merged |= {x for own in index.manifest()["postings"].values() for x in own if "merged" in x}
    assert merged and index.manifest()["n"] == len(have)
