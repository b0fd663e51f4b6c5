"""An index's first update has nothing to compare with: its rows are kept once."""

from textloom.operators import index as I


def test_first_update_keeps_its_rows_once(spark, tmp_path, monkeypatch):
    kept = []
    monkeypatch.setattr(I, "cut", lambda df: kept.append(1) or df.checkpoint())
    index = I.Index(spark, str(tmp_path / "index"), "k", buckets=2)
    index.update(spark.createDataFrame([("a", "one two two"), ("b", "two"), ("c", ""), ("d", None)], "k string, text string"))
    assert len(kept) == 1
    m = index.manifest()
    assert (m["n"], m["dl"]) == (3, 4)
    assert {r.k: r.dl for r in index.rows().collect()} == {"a": 3, "b": 1, "c": 0}
    counts, _ = index._read("frequencies", m)
    assert {r.term: r.d for r in counts.collect()} == {"one": 1, "two": 2}
    index.update(spark.createDataFrame([("b", "one")], "k string, text string"))
    assert len(kept) == 3 and sorted(r.k for r in index.search("one").collect()) == ["a", "b"]
