"""Queries against their SQL on tables that the small ones are not like: long conversations, large ids, many rows of one key."""

import duckdb
from test_catalog import plain

from textloom.operators import evaluation as E
from textloom.operators import evidence
from textloom.plans import catalog, operations  # noqa: F401


def same(spark, tmp_path, name, **tables):
    c = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(str(tmp_path / f"{t}.parquet"))
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = c.execute(catalog.SQL[name])
    names = [d[0] for d in cur.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want and got


def conversations(spark, turns):
    return spark.createDataFrame([(c, t, "user" if t % 2 else "agent", f"text {t}") for c, n in turns.items() for t in range(n)], "conv_id long, turn int, role string, text string")


def test_contradiction_pairs_of_long_conversations(spark, tmp_path):
    same(spark, tmp_path, "contradiction_pairs", conversations=conversations(spark, {1: 900, 2: 5, 3: 700}))


def test_contradiction_pairs_in_any_order(spark):
    import random

    r = random.Random(5)
    for pages, ords, n in ((2, 40, 3), (3, 6, 2), (1, 9, 2), (6, 300, 4)):
        rows = [(r.choice("ab"), r.randrange(ords), r.choice([1, 1, 1, 1, *range(pages)]), "") for _ in range(150)] + [("a", -1, 1, "")] * 30 + [("b", None, 1, ""), (None, 1, 1, ""), ("b", 0, None, "")]
        keep = [x for x in rows if None not in x]
        want = sorted((a[0], a[1], b[1]) for a in keep for b in keep if a[0] == b[0] and a[1] < b[1] and a[2] != b[2])[:n]
        got = E.contradiction_pairs(spark.createDataFrame(rows, "entity string, ord long, path long, text string"), n).select("entity", "i", "j").collect()
        assert list(map(tuple, got)) == want


def test_vectors_whose_numbers_meet(spark, tmp_path):
    # 1,000,000 after a section's number is another section's number; two sections have one number
    same(spark, tmp_path, "vector_carry_over", conversations=conversations(spark, {1: 8, 2: 150, 3: 60, 10_001: 8, 10_002: 60, 20_003: 8}))


def test_one_long_sentence_is_not_copied_once_a_word(spark):
    """20,000 distinct words in one sentence: with the sentence and its words beside each of them, 400 million words were shuffled."""
    words = " ".join(f"w{i}" for i in range(20_000))
    pages = spark.createDataFrame([("p", f"First one. {words}. Last one."), ("q", "Something else.")], "source string, body string")
    edges = spark.createDataFrame([(1, "p", "none", words), (2, "p", "none", "w5 w6 absent"), (3, "q", "none", "w5 w6"), (4, "x", "none", "a"), (5, "p", "one. w0 w1", None), (6, "p", "none", None)], "edge_id long, source string, quote string, claim string")
    got = {r.edge_id: (r.status, r.probability) for r in evidence.check(edges, pages).collect()}
    assert got == {1: ("supported", 1.0), 2: ("supported", 0.6667), 3: ("unsupported", None), 4: ("missing_source", None), 5: ("quoted", None), 6: ("unsupported", None)}


def test_postings_tokenize_a_row_once(spark):
    """A filter that Spark inferred from inline() counted and tokenized every row a second and a third time."""
    from textloom.operators import search as S

    docs = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "doc_id long, text string")
    posts, _ = S.postings(docs, ["doc_id"], "text")
    plan = posts.filter("term = 'a'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    assert sorted(map(tuple, posts.collect())) == [(1, "a", 2, 3), (1, "b", 1, 3)]
