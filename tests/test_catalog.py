"""Every registered query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from textloom.plans import catalog, operations  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf}/{t}.parquet").exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, db, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = db.execute(catalog.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want


def test_evidence_in_any_place(spark, tmp_path):
    docs = ["One two three four five six", "xone two three four fivex", '"one two three four five"', "two", "a (one two) b", None, "", "one  two\nthree four  FIVE"]
    items = ["one two three four five", "two", "one two", "e two three fou", "ne two three four fiv", "absent", " ", None, "three four five six"]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    flat = lambda t: " ".join(t.lower().split())
    want = {(i, d) for i, e in enumerate(items) if e and flat(e) for d, t in enumerate(docs) if t and flat(e) in flat(t)}
    assert {tuple(r) for r in catalog.evidence_contains(spark, str(tmp_path)).select("item_id", "doc_id").collect()} == want


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 50
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
