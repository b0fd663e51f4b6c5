"""The pipeline and the registered queries."""

import random
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from test_operators import SPACE, brute_join, brute_tiles, brute_tree, lower

import corpus_pipeline
from textloom.llm import decontamination, line_dedup, ngram_join, packing, quality_rules
from textloom.llm import queries as Q

TABLES = ("documents", "pages", "benchmark", "labels")


def test_stages_chain(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.judge(docs).collect() if r.kept}
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if i < 4:
            assert out.columns == docs.columns
        before = docs
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "quality rules":
            assert ids == kept
        elif name == "line dedup":
            want = {r.doc_id: r.text for r in line_dedup.clean(before).collect() if r.text.strip(" \t\n\x0b\f\r")}
            assert {r.doc_id: r.text for r in docs.collect()} == want and all(r.n_chars == len(r.text) for r in docs.collect())
        elif name == "n-gram Jaccard join":
            assert ids == {r.doc_id for r in ngram_join.join(before).collect() if r.doc_id == r.component_id}
        elif name == "benchmark decontamination":
            assert ids == {r.doc_id for r in decontamination.matches(before, bench).collect() if not r.contaminated}
        else:
            assert ids == {r.doc_id for r in before.select("doc_id").collect()}
            whole = packing.pack(before, Q.tokenizer_path())
            key = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
            assert key(docs) == key(whole)


def made_up(r):
    """Rows (doc_id, text) with copies, near copies, a shared passage, benchmark passages, short ones, repeats and nulls."""
    words = "the of and river heron stone water flies over lake sings trees morning with that quiet bank reeds under sky".split()
    prose = lambda n: "\n".join(" ".join(r.choice(words) + r.choice("abcdefghij") * r.randint(0, 2) for _ in range(12)) + " the" for _ in range(n))
    passage = " ".join(r.choice(words) + str(chr(97 + i % 26)) for i in range(55))
    item = " ".join(r.choice(words) + chr(97 + i % 26) + "x" for i in range(20))
    rows = [(i, prose(r.randint(6, 12))) for i in range(24)]
    rows += [(100 + i, rows[i][1]) for i in range(3)] + [(110, rows[0][1]), (120, rows[4][1].replace("the", "thee", 1)), (121, rows[5][1] + " end")]
    rows += [(130 + i, prose(7) + "\n" + passage) for i in range(4)] + [(140 + i, f"{prose(7)}\nDear friend {n} welcome back to this quiet site") for i, n in enumerate("Ann Bob Cleo Dan Eve Flo Gus".split())]
    w = item.split()
    rows += [(150, prose(6) + "\n" + " ".join(w[10:] + ["pad"] + w[:10])), (151, prose(6) + "\n" + " ".join(w[:8])), (160, "too short"), (161, None), (162, ""), (163, "again and again " * 40), (164, "word\n" * 80), (165, "### *** the " * 40)]
    rows += [(170, prose(200)), (170, prose(8)), (None, prose(8)), (None, None), (3, rows[3][1])]
    return rows, [(1, item), (2, "never seen anywhere at all in these"), (3, None), (None, item)]


def passes(text):
    """The rules in plain Python."""
    t = text or ""
    w, lines = re.findall(SPACE, t), [x for x in t.split("\n") if re.search(SPACE, x)]
    n, seen = len(w), Counter(zip(w, w[1:], w[2:], strict=False))
    again = {p for i, k in enumerate(zip(w, w[1:], w[2:], strict=False)) if seen[k] > 1 for p in (i, i + 1, i + 2)}
    stop, symbols = sum(x in set(quality_rules.STOP_WORDS) for x in w), len(re.findall(r"[#*$%&|<>]", t))
    return n >= 50 and 2 * len(again) <= n and 2 * n <= sum(map(len, w)) <= 14 * n and 5 * symbols <= n and 10 * t.count("!") <= 3 * n and 50 * stop >= n and 2 * (len(lines) - len(set(lines))) <= len(lines)


def test_run_equals_plain_python(spark, tmp_path):
    rows, items = made_up(random.Random(6))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = [(i, t) for i, t in rows if passes(t)]
    gone, _ = brute_tree(kept)
    short = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get((i, t), ()))) for i, t in kept]
    short = [(i, t) for i, t in short if re.search(SPACE, t)]
    # a doc_id with two texts is judged text by text
    keys = {n: i for n, (i, _) in enumerate(short) if i is not None}
    least = brute_join([((i, n), short[n][1]) for n, i in keys.items()])
    unique = [x for n, x in enumerate(short) if n not in keys or least[keys[n], n][1][0] == keys[n]]
    words = lambda t: re.findall(r"[^\x20\x09-\x0d!-/:-@\[-`{-~]+", lower(t))
    clean = [(i, t) for i, t in unique if not any(2 * brute_tiles(words(t), words(x), 5) >= len(words(x)) for k, x in items if k is not None and x)]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(kept) < len(rows) and gone and len(unique) < len(short) and len(clean) < len(unique)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.tokenizer_path())
    want = Counter()
    for i, text in clean:
        ids = np.asarray(t.encode(text, add_special_tokens=False).ids + [0], "<u4")
        want.update((i, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    for s in {r.sequence_id for r in got}:
        own = sorted((r.offset, r.length) for r in got if r.sequence_id == s)
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and own[0][0] == 0 and sum(own[-1]) <= 2048


def test_run_of_nothing_and_clashing_names(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, fp string, _kept string, n_words string, matches string"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    text = " ".join(f"the {a}{b} of" for a in "abcdef" for b in "ghijk")
    docs = spark.createDataFrame([(1, text, "en", "s", 1, *["x"] * 5)], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 1, name


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_matches_sql(spark, sf, name):
    c = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf}/{t}.parquet").exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = Q.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    cur = c.execute(Q.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(r[names.index(x)] for x in cols) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(r[x] for x in cols) for r in df.collect()), key=repr) == want
