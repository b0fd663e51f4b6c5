"""Each operator against a brute-force version, and on nulls, empty texts, ties, repeats, empty tables and extra columns."""

import gzip
import hashlib
import io
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import _shared, decontamination, hashing, licenses, line_dedup, ngram_join, packing, quality_model, quality_rules, toxicity, url_filters, warc
from textloom.llm.queries import tokenizer_path

SPACE = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, family string"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def corpus(seed=1, n=150):
    r = random.Random(seed)
    base = [[r.choice("abcdefghijklmnopq") * r.randint(1, 2) for _ in range(r.randint(3, 80))] for _ in range(10)]
    out = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.randint(0, max(1, len(w) // 25))):
            w[r.randrange(len(w))] = r.choice("xyzabc")
        if r.random() < 0.2:
            w += base[0][:20]
        out.append((i * 7, " ".join(w)))
    return out + [(9001, None), (9002, ""), (9003, " \t\n"), (9004, "one two"), (9005, "One  TWO"), (9006, "x " * 3000), (9006 + 1, "x " * 3000)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash") for i, t in rows], DOCS).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- shared


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in _shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert _shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_skew_join_splits_heavy_keys_and_keeps_all_rows(spark):
    left = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 500).cast("string"))).alias("k"))
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("m"))
    joined = _shared.skew_join(left, right.filter("m < 400"), "k", "n", 9000, F.col("id"))
    assert re.search(r"Join \[k#\d+, _salt#\d+\]", joined._jdf.queryExecution().executedPlan().toString()), "the salt is a key of the join"
    got = joined.orderBy("id").collect()
    want = left.join(right.filter("m < 400"), "k", "left").select("id", "k", "n", "m").orderBy("id").collect()
    assert got == want


def test_word_hashes_follow_words():
    texts = [b"The  cat sat\n on the mat the CAT", b"", b"one two", b" \t ", b"a b c d e f a b c d e", "é ü À x".encode()]
    words, starts = hashing.word_hashes(texts)
    want = [re.findall(rb"[^\x20\x09-\x0d]+", t.lower()) for t in texts]
    assert np.diff(starts).tolist() == list(map(len, want))
    names = {}
    for a, b in zip([x for t in want for x in t], words.tolist(), strict=True):
        assert names.setdefault(a, b) == b
    assert len(set(names.values())) == len(names)
    shingles, at = hashing.shingle_hashes(words, starts, 5)
    assert np.diff(at).tolist() == [4, 0, 1, 0, 7, 1] and shingles[at[4]] == shingles[at[4] + 6]
    alone, _ = hashing.shingle_hashes(*hashing.word_hashes([b"ONE two"]), 5)
    assert alone[0] == shingles[at[2]]


# --- 1


def brute_join(rows):
    def shingles(t):
        w = re.findall(SPACE, lower(t))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1))))

    sets, parent = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("block", [10**6, 500])
def test_join_equals_all_pairs(spark, block):
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(frame(spark, rows), block_tokens=block).collect()}
    assert got == brute_join(rows)


@pytest.mark.parametrize("block", [10**6, 500])
def test_join_counts_all_links(spark, block):
    rows = corpus(3, 100) + [(20_000 + i, " ".join("abcdefghijklmnopqrstuvwxyz" * 3) + f" end{i}") for i in range(12)]
    rows += rows[:5]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1)))} for i, t in rows for w in [re.findall(SPACE, lower(t))]}
    want = {i: sum(i != j and bool(a and b) and 100 * len(a & b) >= 75 * len(a | b) for j, b in sets.items()) for i, a in sets.items()}
    got = ngram_join.join(frame(spark, rows), block_tokens=block).collect()
    assert len(got) == len(rows) and {r.doc_id: r.n_links for r in got} == want and want[20_000] == 11


def test_join_keeps_one(spark):
    rows = corpus(5, 60)
    want = brute_join(rows)
    kept = ngram_join.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and {r.doc_id for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c}


def test_join_of_nothing(spark):
    assert ngram_join.join(empty(spark)).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f")]
    assert [(r.doc_id, r.component_id) for r in ngram_join.join(frame(spark, rows)).collect()] == [(1, 1), (1, 1)]


def test_join_of_rows_repeated_across_partitions(spark):
    """Doubled codes must make no link: four texts that are just under the similarity, one of them in every partition."""
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)]
    rows = [(1, " ".join(words))]
    for k in (2, 3, 4):
        w = list(words)
        for j in range(k, 120, 40):
            w[j] = f"changed{k}"
        w[60 + k : 60 + k] = [f"more{k}{chr(97 + x)}" for x in range(14)]
        rows.append((k, " ".join(w)))
    want = brute_join(rows)
    assert all(c == i for i, (_, c) in want.items())
    docs = frame(spark, rows + rows[:1] * 3, 4).unionByName(frame(spark, rows[:1]))
    for r in ngram_join.join(docs).collect():
        assert (r.n_shingles, r.component_id, r.n_links) == (*want[r.doc_id], 0)


def test_join_of_one_id_with_two_texts(spark):
    texts = [" ".join(chr(97 + i) * (1 + (i + k) % 3) for i in range(26)) for k in range(3)]
    rows = [(1, texts[0]), (2, texts[0]), (1, texts[1]), (3, texts[1] + " end"), (4, texts[2])]
    got = Counter((r.doc_id, r.component_id) for r in ngram_join.join(frame(spark, rows)).collect())
    assert got == Counter([(1, 1), (2, 1), (1, 1), (3, 1), (4, 4)])


def test_join_in_small_ranges_and_bands(spark):
    """Many hash ranges, and a family over the bound whose sets have very different lengths."""
    r = random.Random(4)
    base = [f"{a}{b}" for a in "abcdefghijklm" for b in "nopqrstuvwxyz"]
    rows = []
    for i in range(60):
        w = base[: r.randint(20, 169)]
        w[r.randrange(len(w))] = f"x{chr(97 + i % 26)}{i // 26}"
        rows.append((i, " ".join(w)))
    want = brute_join(rows)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.join(frame(spark, rows), block_tokens=300, range_codes=100).collect()}
    assert got == want and len({c for _, c in want.values()}) > 1


def test_trie_finds_links_a_scan_finds():
    r = random.Random(9)
    sets = []
    for _ in range(80):
        s = set(r.choice(sets)[1]) if sets and r.random() < 0.7 else set(r.sample(range(200), r.randint(3, 60)))
        s ^= set(r.sample(range(200), r.randint(0, 4)))
        sets.append((len(sets), sorted(s) or [1]))
    trie = ngram_join.TrieJoin(step=4)
    for i, s in sets:
        trie.add(i, len(s), s)
    parent = list(range(len(sets)))
    for i, a in sets:
        for j, b in sets[:i]:
            if 100 * len({*a} & {*b}) >= 75 * len({*a} | {*b}):
                old, new = parent[i], parent[j]
                parent = [new if p == old else p for p in parent]
    for i, _ in sets:
        for j, _ in sets:
            assert (trie.find(i) == trie.find(j)) == (parent[i] == parent[j])


# --- 2


def brute_tree(rows):
    """Dropped lines by (doc_id, text) and the recurring templates, from a tree of dictionaries."""
    mask = lambda x: ["<*>" if re.search("[0-9@]", w) else w for w in re.findall(SPACE, x)]
    holders, out = {}, {}
    for d, text in rows:
        if d is not None and text is not None:
            holders[text] = min(d, holders.get(text, d))
    lines = [(t, i, tuple(w)) for t in holders for i, w in enumerate(map(mask, t.split("\n"))) if len(w) >= 3]
    docs, at, templates = {}, {}, {}
    for t, _, w in lines:
        docs.setdefault((len(w), w[:2]), set()).add(t)
        for p, x in enumerate(w):
            at.setdefault((len(w), w[:2], p, x), set()).add(t)
    for t, i, w in lines:
        n, lead = len(w), w[:2]
        templates.setdefault((0, w), []).append((t, i))
        if len(docs[n, lead]) >= 5:
            k = [len(at[n, lead, p, x]) for p, x in enumerate(w)]
            word = [len(x) > 1 for x in w]
            for v, fixed in ((1, [c >= 5 for c in k]), (2, [c >= 5 and c >= 0.2 * len(docs[n, lead]) for c in k])):
                own = sum(a and b for a, b in zip(word, fixed, strict=True))
                if own >= 3 and 2 * own >= sum(word):
                    templates.setdefault((v, tuple(x if f else "<*>" for x, f in zip(w, fixed, strict=True))), []).append((t, i))
    shown = {}
    for (v, w), places in templates.items():
        found = {t for t, _ in places}
        if len(found) >= (2 if v == 0 and len(w) >= 20 else 5):
            first = min(found, key=lambda t: holders[t])
            shown[" ".join(w)] = max(len(found), shown.get(" ".join(w), 0))
            for t, i in places:
                if t != first:
                    out.setdefault(t, set()).add(i)
    return {(d, t): sorted(out[t]) for d, t in rows if d is not None and t in out}, set(shown.items())


def fixed_depth_tree(lines, like=0.5):
    """Groups of lines as a log parser's tree finds them: by token count and two leading tokens, then by the group most alike."""
    tree, of = {}, []
    for w in lines:
        groups = tree.setdefault((len(w), *w[:2]), [])
        best = max(groups, key=lambda g: sum(a == b for a, b in zip(g["w"], w, strict=True)), default=None)
        if best is None or sum(a == b for a, b in zip(best["w"], w, strict=True)) < like * len(w):
            best = {"w": list(w), "n": 0, "id": len(of)}
            groups.append(best)
        best["w"] = [a if a == b else "<*>" for a, b in zip(best["w"], w, strict=True)]
        best["n"] += 1
        of.append(best)
    return of


NAMES = "Anna Bob Carla Dan Eve Frank Gina Hans Iris Jan Kim Leo Mona Nils Olga Paul Quin Rosa Sven Tina".split()
CITIES = "Bonn Cork Dover Essen Faro Genoa Hull Izmir Jena Kyoto Lima Milan Nancy Oslo Paris Quito Riga Soria Turin Ulm".split()


@pytest.mark.parametrize("line", [
    "Hello dear {n} welcome back to the forum", "This story was first told by {n} who lives in {c} with two dogs", "Yesterday evening our dear reader {n} wrote a long letter from {c} to us",
    "Dear reader we thank {n} {c} for this", "Posted by {n} today", "Written by {n} in {c} for you all", "The reader {n} and the {c} are both here again now", "a b {n} {c} {n}",
])
def test_lines_with_fields_go(spark, line):
    """Fields in any places, two of them, neighbours, in short lines; a line of hardly more than fields isn't a template."""
    rows = [(i, f"{line.format(n=n, c=c)}\nOnly {n} wrote this") for i, (n, c) in enumerate(zip(NAMES, CITIES, strict=True))]
    got = {r.doc_id: r.n_dropped for r in line_dedup.clean(frame(spark, rows)).collect()}
    assert got == {i: int(i > 0 and line != "a b {n} {c} {n}") for i in range(20)}


def test_fields_of_few_values_go(spark):
    rows = [(i, f"Our friend {NAMES[i % 6]} sends you greetings from lovely {CITIES[i // 6 % 10]} today") for i in range(60)]
    assert sum(r.n_dropped for r in line_dedup.clean(frame(spark, rows)).collect()) == 59


def test_recall_against_a_fixed_depth_tree(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 3)))
    rows = []
    for k in range(30):  # templates of one to three fields, among lines of prose
        n = r.randint(4, 16)
        fields, w = set(r.sample(range(2, n), min(r.randint(1, 3), (n - 2) // 2 or 1))), [word() for _ in range(n)]
        rows += [" ".join(r.choice([word() + word(), *NAMES]) if p in fields else x for p, x in enumerate(w)) for _ in range(r.randint(8, 25))]
    rows += [" ".join(r.choice("the of and to in is it".split()) if r.random() < 0.5 else word() for _ in range(r.randint(4, 16))) for _ in range(600)]
    r.shuffle(rows)
    of = fixed_depth_tree([x.split() for x in rows])
    first, want = {}, set()
    for i, g in enumerate(of):
        if g["n"] >= 5 and first.setdefault(g["id"], i) != i:
            want.add(i)
    got = {x.doc_id for x in line_dedup.decisions(frame(spark, list(enumerate(rows)))).collect()}
    assert len(want) > 300 and len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.05 * len(got)


def test_templates_are_shown(spark):
    rows = [(i, f"Hello dear {n} welcome back to {c} today\nOnly {n} wrote this") for i, (n, c) in enumerate(zip(NAMES, CITIES, strict=True))]
    got = {r.doc_id: r for r in line_dedup.clean(frame(spark, rows)).collect()}
    assert got[0].n_dropped == 0 and got[0].n_lines == 2 and got[0].family == "clash"
    assert all(got[i].text == f"Only {n} wrote this" and got[i].n_dropped == 1 for i, n in enumerate(NAMES) if i)
    shown = {(r.template, r.tokens, r.documents, r.first_doc) for r in line_dedup.templates(frame(spark, rows)).collect()}
    assert shown == {("Hello dear <*> welcome back to <*> today", 8, 20, 0)}


def test_all_lines_of_a_shared_footer_go(spark):
    footer = "All about our site\nWrite to us at any time\nThe terms of use apply here\nThank you for reading this"
    rows = [(i, f"{chr(97 + i)} alone\n{footer}") for i in range(20)]
    got = {r.doc_id: r.text for r in line_dedup.clean(frame(spark, rows)).collect()}
    assert got[0] == rows[0][1] and all(got[i] == f"{chr(97 + i)} alone" for i in range(1, 20))


def test_a_refrain_of_one_document_stays(spark):
    rows = [(1, "\n".join(f"sing the same song again\nverse {chr(97 + i)} is another one" for i in range(8))), (2, "something else entirely in here")]
    assert {r.text for r in line_dedup.clean(frame(spark, rows)).collect()} == {t for _, t in rows}


def test_long_lines_need_two_documents(spark):
    passage = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = [(i, f"{chr(97 + i)} one two three\n{passage}\nthree two one {chr(97 + i)}") for i in range(2)]
    assert {r.doc_id: r.n_dropped for r in line_dedup.clean(frame(spark, rows)).collect()} == {0: 0, 1: 1}


def test_line_tree_equals_brute_force(spark):
    r = random.Random(12)
    long = [" ".join(f"v{chr(97 + k)}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(50)) for k in range(3)]
    rows = [(20 + i, f"the intro\n{long[0]}\n{long[1]}\nthe outro{chr(97 + i)}") for i in range(2)] + [(31, f"x\n{long[2]}\ny\n{long[2]}\nz\n{long[2]}")]
    for i in range(100):
        line = lambda n: " ".join(r.choice("abc" if r.random() < 0.7 else "abcdefgh7") * 2 for _ in range(n))
        rows.append((40 + i, "\n".join(f"in some {line(r.randint(0, 10))}".rstrip() for _ in range(6))))
    rows += [(200 + i, rows[10][1]) for i in range(3)] + [(50, rows[11][1])] * 2 + [(None, rows[12][1])] * 7 + [(300, None), (301, ""), (302, "a\n\na\n"), (303, "\n".join(f"line {k} of a very long text here" for k in range(3000)))]
    rows += [(304 + i, f"\t{x}  in  some a b c\r") for i, x in enumerate("abcdef")]
    want, shown = brute_tree(rows)
    got = line_dedup.decisions(frame(spark, rows)).collect()
    assert {(x.doc_id, tuple(x.dropped)) for x in got} == {(d, tuple(i)) for (d, _), i in want.items()} and len(want) >= 30
    assert {(x.template, x.documents) for x in line_dedup.templates(frame(spark, rows)).collect()} == shown
    whole = line_dedup.clean(frame(spark, rows)).collect()
    assert len(whole) == len(rows)
    cut = lambda d, t: t and "\n".join(y for k, y in enumerate(t.split("\n")) if k not in want.get((d, t), ()))
    assert Counter((x.doc_id, x.text) for x in whole) == Counter((d, cut(d, t)) for d, t in rows)


def test_clashing_columns(spark):
    """Extra columns named like those that operators make."""
    names = ("n_lines", "n_dropped", "_dropped", "_id", "_gone", "key", "fp", "i", "_salt", "n_words", "kept", "matches", "_0", "_text", "component_id", "lo", "hi", "part", "score")
    docs = frame(spark, [(i, f"{chr(97 + i)} first line\nthe very same boilerplate line\n{chr(97 + i)} last line " + "the end of it " * 20) for i in range(9)])
    wide = docs.select("*", *[F.lit("x").alias(n) for n in names])
    assert line_dedup.shorten(wide).columns == wide.columns and {r.n_dropped for r in line_dedup.clean(wide).collect()} == {0, 1}
    assert ngram_join.keep_one(wide).columns == wide.columns and ngram_join.keep_one(wide).count() == ngram_join.keep_one(docs).count()
    assert quality_rules.clean(wide).columns == wide.columns and quality_rules.judge(wide).count() == 9
    bench = spark.createDataFrame([(1, "a first line the very same", "x")], "item_id long, text string, doc_id string")
    assert decontamination.clean(wide, bench).columns == wide.columns
    assert packing.pack(wide, tokenizer_path()).count() == 9 and licenses.scan(wide).count() == 9


def test_null_ids(spark):
    docs = frame(spark, [(None, "a b c d e f g"), (1, "a b c d e f g"), (None, None), (2, None), (None, "a b c d e f g")])
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(docs).collect()]
    assert sorted(got, key=str) == sorted([(None, 3, None), (1, 3, 1), (None, 0, None), (2, 0, 2), (None, 3, None)], key=str)
    assert ngram_join.keep_one(docs).count() == 5 and packing.pack(docs, tokenizer_path()).count() == 5 and line_dedup.clean(docs).count() == 5
    bench = spark.createDataFrame([(None, "a b c d e f g"), (3, None), (4, "a b c d e")], "item_id long, text string")
    assert sorted(r.item_ids for r in decontamination.matches(docs, bench).collect()) == [[], [], [4], [4], [4]]
    assert licenses.scan(docs).count() == 5 and quality_rules.judge(docs).count() == 5
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    for m in (toxicity, quality_model):
        assert {r.held_out for r in m.score(docs, m.fit(docs, labels)).collect()} <= {True, False}
    p = spark.createDataFrame([(None, None, None), (None, "http://a.com/", "x" * 100), (3, "u", "x" * 100)], "page_id long, url string, html string")
    assert url_filters.judge(p).count() == 3 and warc.plan(p).filter("refers_to is not null").count() == 0


def test_lines_of_nothing(spark):
    assert line_dedup.clean(empty(spark)).count() == 0


def test_null_keys_are_dealt_out(spark):
    """Half of the rows have no id, no text or no html: no task of a join gets most of them."""
    parts = lambda df: Counter(r["_p"] for r in df.withColumn("_p", F.spark_partition_id()).collect())
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        docs = frame(spark, [(None if i % 2 else i, f"the same line of all here\n{i % 3} one" if i % 4 else None) for i in range(800)])
        pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("doc_id").isNotNull(), F.repeat(F.col("text"), 9)).alias("html"))
        for made, rows in ((line_dedup.clean(docs), 800), (ngram_join.keep_one(docs), None), (warc.plan(pages), 800)):
            found = parts(made)
            assert max(found.values()) < 0.3 * sum(found.values()) and rows in (None, sum(found.values()))
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


# --- 3 and 9


def labelled(spark, n=400):
    r = random.Random(2)
    words = ["the", "bird", "flies", "over", "lake", "and", "sings", "to", "trees"]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(5, 60))]
        bad = i % 4 == 0
        if bad:
            w[r.randrange(len(w))] = r.choice(["stupido", "STUPIDA"])
        if i % 5 == 0:
            w = [x + "###" for x in w]
        docs.append((i, " ".join(w)))
        labels.append((i, int(i % 5 != 0), int(bad)))
    docs += [(9000, None), (9001, ""), (9002, "ab")]
    return frame(spark, docs), spark.createDataFrame([*labels, (None, 1, 1), (9000, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module, label, modulus, held", [(toxicity, 2, 5, 0), (quality_model, 1, 3, 1)])
def test_classifiers_hold_out_and_tell(spark, module, label, modulus, held):
    docs, labels = labelled(spark)
    truth = {r[0]: r[label] for r in labels.collect()}
    got = {r.doc_id: r for r in module.score(docs, module.fit(docs, labels)).collect()}
    assert len(got) == 403 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % modulus == held) for i, r in got.items())
    own = [r for i, r in got.items() if r.held_out and i < 9000]
    assert sum(r.predicted == truth[r.doc_id] for r in own) >= 0.95 * len(own)


def test_toxicity_equals_dictionaries_of_ngrams(spark):
    """The same classifier over plain sets of character n-grams."""
    docs, labels = labelled(spark)
    texts = {r.doc_id: lower(r.text) for r in docs.collect()}
    y = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id in texts and r.toxic is not None}
    train = [i for i in sorted(y) if zlib.crc32(str(i).encode()) % 5]
    grams = {i: {t[k : k + n] for n in toxicity.SIZES for k in range(len(t) - n + 1)} for i, t in texts.items()}
    counts = [Counter(g for i in train if y[i] == c for g in grams[i]) for c in (0, 1)]
    n = [sum(y[i] == c for i in train) for c in (0, 1)]
    ratio = lambda g: np.log((counts[1][g] + 1) / (n[1] + 2)) - np.log((counts[0][g] + 1) / (n[0] + 2))
    gain = lambda g: (counts[1][g] * (n[0] - counts[0][g]) - counts[0][g] * (n[1] - counts[1][g])) ** 2 / ((counts[0][g] + counts[1][g]) * (sum(n) - counts[0][g] - counts[1][g]) + 1)
    kept = [g for g in set(counts[0]) | set(counts[1]) if counts[0][g] + counts[1][g] >= 3 and abs(ratio(g)) > toxicity.LEAST_RATIO]
    kept = sorted(kept, key=lambda g: -gain(g))[: toxicity.KEPT]
    x = np.array([[(g in grams[i]) * ratio(g) for g in kept] for i in train])
    truth = np.array([y[i] for i in train])
    weight = np.where(truth > 0, toxicity.TOXIC_WEIGHT, 1.0)
    w, b = np.zeros(len(kept)), 0.0
    for _ in range(4000):  # plain gradient steps
        error = weight * (1 / (1 + np.exp(-(x @ w + b))) - truth) / weight.sum()
        w, b = w - 0.05 * (x.T @ error + 1e-3 * w), b - 0.05 * error.sum()
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    want = {i: 1 / (1 + np.exp(-(sum(w[k] * ratio(g) for k, g in enumerate(kept) if g in grams[i]) + b))) for i in texts}
    assert np.mean([abs(got[i] - want[i]) < 0.1 for i in texts]) > 0.97 and all((got[i] >= 0.5) == (want[i] >= 0.5) for i in texts if abs(want[i] - 0.5) > 0.1)


def test_quality_rules_score_as_by_hand(spark):
    docs, labels = labelled(spark)
    model = quality_model.fit(docs, labels)
    assert model.rules and all(model.weights)
    stop = set(quality_rules.STOP_WORDS)
    for r in quality_model.score(docs, model).collect():
        t = next(x.text for x in docs.filter(F.col("doc_id") == r.doc_id).collect()) if r.doc_id in (0, 5, 9000, 9001) else None
        if t is None and r.doc_id not in (9000,):
            continue
        words, lines = re.findall(SPACE, t or ""), [x for x in (t or "").split("\n") if re.search(SPACE, x)]
        seen = Counter(zip(words, words[1:], words[2:], strict=False))
        again = {p for i, k in enumerate(zip(words, words[1:], words[2:], strict=False)) if seen[k] > 1 for p in (i, i + 1, i + 2)}
        n = max(len(words), 1)
        x = np.array([[len(words), len(lines), sum(map(len, words)) / n, len(re.findall(r"[#*$%&|<>]", t or "")) / n, (t or "").count("!") / n, sum(w in stop for w in words) / n, len(again) / n, (len(lines) - len(set(lines))) / max(len(lines), 1), len(words) / max(len(lines), 1)]])
        z = model.intercept + sum(w for rule, w in zip(model.rules, model.weights, strict=True) if rule.holds(x)[0])
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)))


def test_lasso_meets_its_conditions():
    r = np.random.default_rng(1)
    x = r.random((300, 12)) < 0.4
    y = (x[:, 0] | x[:, 3]).astype(float)
    weight = r.random(300) + 0.5
    w, b = quality_model.lasso(x, y, weight, 0.01, 5000)
    gradient = x.T @ (weight / weight.sum() * (1 / (1 + np.exp(-(x @ w + b))) - y))
    assert np.all(np.abs(gradient[w == 0]) <= 0.0101) and np.allclose(gradient[w != 0], -0.01 * np.sign(w[w != 0]), atol=1e-4) and 0 < (w != 0).sum() < 12


@pytest.mark.parametrize("module", [toxicity, quality_model])
def test_classifiers_without_examples(spark, module):
    docs, labels = labelled(spark, 20)
    none = labels.limit(0)
    assert {r.score for r in module.score(docs, module.fit(docs, none)).collect()} == {0.5}
    one = labels.filter("quality = 1 and toxic = 0")
    assert module.score(docs, module.fit(docs, one)).count() == 23
    assert module.score(empty(spark), module.fit(empty(spark), labels)).count() == 0


def test_sample_is_bounded_and_weighted(spark):
    _, labels = labelled(spark)
    sample, weights = _shared.fit_sample(labels, "toxic", 5, 0, rows=30)
    n = Counter(r.y for r in sample.collect())
    assert n == {0: 30, 1: 30} and weights[0] > weights[1] > 1


# --- 4


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, n string")


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 60 + "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n"
    rows = [(5, "http://a", big), (3, "http://b\r\nX: y", big), (9, None, big), (1, "u", None), (2, "u", ""), (4, "u", "small"), (6, "u", "small"), (7, "u", "z" * 100), (8, "u", "z" * 100), (10, "u", "z" * 99), (11, "u", "z" * 99)]
    path = str(tmp_path / "w")
    warc.write(warc.plan(pages(spark, rows)), path, file_bytes=3 << 15)
    got = {r.page_id: r for r in warc.resolve(warc.read(spark, path)).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if (h or "") == (html or "")]
        revisit = len(data) >= 100 and min(same) != i
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert (got[i].record_type, got[i].refers_to) == (("revisit", min(same)) if revisit else ("response", None))
    again = str(tmp_path / "again")
    warc.dedupe(spark, path, again)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(warc.resolve(warc.read(spark, again))) == key(warc.resolve(warc.read(spark, path)))


def test_archives_are_plain_warc(spark, tmp_path):
    warc.write(warc.plan(pages(spark, [(1, "http://a", "x" * 200)])), str(tmp_path / "w"), compression="none")
    raw = b"".join(p.read_bytes() for p in (tmp_path / "w").glob("part-*"))
    (h, block), = warc.parse(io.BytesIO(raw))
    assert raw.endswith(b"\r\n\r\n") and h["warc-type"] == "response" and block.endswith(b"x" * 200) and len(block) == int(h["content-length"])
    (h2, _), = warc.parse(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(raw)))))
    assert h2 == h
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(raw[:-150])))


def test_no_pages(spark, tmp_path):
    warc.write(warc.plan(pages(spark, []).limit(0)), str(tmp_path / "w"))
    assert warc.resolve(warc.read(spark, str(tmp_path / "w"))).count() == 0


# --- 5


def test_licenses(spark):
    mit = licenses.TEMPLATES[1].text
    rows = [
        (1, "Prose.\nReleased under the MIT License.\nMore prose."), (2, "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0."), (3, "the license of the river"),
        (4, "Licensed under CC BY 4.0."), (5, mit.replace("any person", "anybody").upper()), (6, None), (7, ""), (8, "x" * 50_000), (9, "Licensed under the Apache License, Version 1.1."), (10, "\n".join(mit[i : i + 60] for i in range(0, len(mit), 60))),
    ]
    got = {r.doc_id: r.licenses for r in licenses.scan(frame(spark, rows)).collect()}
    assert got == {1: ["MIT"], 2: ["CC-BY-NC-4.0", "GPL-3.0"], 3: [], 4: ["CC-BY-4.0"], 5: ["MIT"], 6: [], 7: [], 8: [], 9: [], 10: ["MIT"]}
    assert licenses.scan(empty(spark)).count() == 0


def test_wrapped_and_adjoining_licenses(spark):
    prose = "the grey heron stood in the shallow water of the lake and waited "
    rows = [
        (1, f"{prose}\nThis Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.\n{prose}"), (2, "This work is licensed under the GNU General Public License,\nversion 3."),
        (3, "Licensed under CC\nBY-NC 4.0."), (4, "Released under the MIT License. Licensed under CC BY 4.0. All rights reserved."), (5, f"{prose * 20}\nLicensed under CC\nBY-SA 4.0.\n{prose * 20}"),
        (6, "\n".join(licenses.TEMPLATES[1].text.split())), (7, f"Released\nunder the MIT License. {prose * 9}\n{prose * 9}\nLicensed under the Apache\nLicense, Version\n2.0."), (8, f"Licensed under CC\n{prose}\nBY-NC 4.0."),
    ]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    want = {1: ["MPL-2.0"], 2: ["GPL-3.0"], 3: ["CC-BY-NC-4.0"], 4: ["CC-BY-4.0", "MIT", "proprietary"], 5: ["CC-BY-SA-4.0"], 6: ["MIT"], 7: ["Apache-2.0", "MIT"], 8: []}
    assert {i: r.licenses for i, r in got.items()} == want
    assert [x.line for x in got[1].found] == [1] and [x.line for x in got[7].found] == [0, 3]


def test_whole_license_texts(spark):
    import textwrap

    def wrap(t, n=70):
        return "\n".join(textwrap.wrap(t, n))

    mit, bsd = licenses._MIT_GRANT + licenses._MIT_REST, licenses._BSD_HEAD + licenses._BSD_TWO + licenses._BSD_THREE + licenses._BSD_END
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one."
    prose = "the grey heron stood in the shallow water of the lake and waited "
    rows = [
        (1, f"{wrap(mit)}\n{wrap(bsd)}"), (2, wrap(mpl, 40)), (3, "// SPDX-License-Identifier: MIT\ncode"), (4, "# SPDX-License-Identifier: Apache-2.0"), (5, wrap(licenses._GNU.format("General Public License", "3"))), (6, wrap(licenses._ISC, 33)),
        (7, wrap(licenses._BSD_HEAD + licenses._BSD_TWO + licenses._BSD_END)), (8, prose * 3000 + "Licensed under CC BY 4.0. " + prose * 3000 + "\n" + wrap(licenses._UNLICENSE)), (9, wrap(mit.replace("copyright notice", "copyright line"))), (9, "copyright law " * 3000),
    ]
    got = Counter((r.doc_id, tuple(r.licenses)) for r in licenses.scan(frame(spark, rows)).collect())
    assert got == Counter([(1, ("BSD-3-Clause", "MIT")), (2, ("MPL-2.0",)), (3, ("MIT",)), (4, ("Apache-2.0",)), (5, ("GPL-3.0-or-later",)), (6, ("ISC",)), (7, ("BSD-2-Clause",)), (8, ("CC-BY-4.0", "Unlicense")), (9, ("MIT",)), (9, ())])


def test_every_template_finds_itself():
    scanner = licenses.Scanner()
    for t in licenses.TEMPLATES:
        assert [x[1] for first, b in licenses.blocks(t.text) for x in scanner.every(first, b)][:1] == [t.name], t.text


def brute_licenses(text, templates):
    """Names by comparing all windows of words with all templates, and taking those that save most bytes first."""
    import zstandard as z

    low = text.lower()
    spans = [m.span() for m in re.finditer("[0-9a-z]+", low)]
    have, found = [low[a:b] for a, b in spans], []
    pack = lambda data, **kw: len(z.ZstdCompressor(level=3, write_content_size=False, **kw).compress(data))
    for i, t in enumerate(templates):
        want = re.findall("[0-9a-z]+", t.text.lower())
        slack = int(max(2, 0.15 * len(want)))
        given = z.ZstdCompressionDict(t.text.encode(), dict_type=z.DICT_TYPE_RAWCONTENT)
        fits, own = [], set()
        for a in range(len(have)):
            best = [(0, ())] * (len(want) + 1)  # longest common subsequence of the words so far, and its words
            for b in range(a, min(len(have), a + len(want) + slack)):
                new = [(0, ())]
                for k, w in enumerate(want):
                    new.append(max(new[-1], best[k + 1], (best[k][0] + 1, (*best[k][1], w)) if w == have[b] else (0, ())))
                best = new
                n, words = best[-1]
                missing, inserted = len(want) - n, b + 1 - a - n
                if have[a] in words and have[b] in words and missing <= 0.15 * len(want) and 0 <= inserted <= slack and set(t.decisive) <= set(words):
                    fits.append((missing + inserted, missing, inserted, a, b))
        for n, _, _, a, b in sorted(fits):  # a template's places are those with the fewest differences
            if not own & set(range(a, b + 1)):
                own |= set(range(a, b + 1))
                part = low[spans[a][0] : spans[b][1]].encode()
                found.append((pack(part, dict_data=given) - pack(part), n, i, a, b))
    taken, out = set(), []
    for _, _, i, a, b in sorted(found):
        if not taken & set(range(a, b + 1)):
            taken |= set(range(a, b + 1))
            out.append((a, templates[i].name))
    return [name for _, name in sorted(out)]


def test_licenses_equal_brute_force():
    r = random.Random(5)
    templates = tuple(t for t in licenses.TEMPLATES if len(t.text.split()) <= 12)
    scanner, grow = licenses.Scanner(templates), licenses._longest(templates)
    some = 0
    for _ in range(150):
        parts = []
        for _ in range(r.randint(1, 4)):
            w = r.choice(templates).text.split()
            if r.random() < 0.4:
                w.insert(r.randrange(len(w) + 1), r.choice(["kindly", "and", "2", "license"]))
            if r.random() < 0.3:
                w.pop(r.randrange(len(w)))
            parts += [" ".join(w), r.choice(["", "the grey heron\n", "2 license gnu\n", "\n"])]
        text = " ".join(parts)
        got = [x[1] for first, b in licenses.blocks(text, grow) for x in scanner.every(first, b)]
        want = brute_licenses(text, templates)
        some += len(want)
        assert got == want, text
    assert some > 200


def test_spdx_expressions():
    want = {
        "MIT OR Apache-2.0": ["MIT", "Apache-2.0"], "(MIT AND BSD-2-Clause)": ["MIT", "BSD-2-Clause"], "GPL-2.0+": ["GPL-2.0-or-later"], "gpl-3.0-only WITH Classpath-exception-2.0 OR (mit AND LicenseRef-own)": ["GPL-3.0-only", "MIT", "LicenseRef-own"],
        "LGPL-2.1 */": ["LGPL-2.1-only"], "Apache-2.0.": ["Apache-2.0"], "MIT and more": ["MIT", "more"],
    }
    scanner = licenses.Scanner()
    for expression, ids in want.items():
        assert [x[1] for first, b in licenses.blocks(f"x\n# SPDX-License-Identifier: {expression}\ny") for x in scanner.every(first, b)] == ids, expression


def test_whole_texts_of_a_folder(spark, tmp_path):
    r = random.Random(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{r.randrange(9)}" for i in range(3000)]
    text = " ".join([*words[:1500], "GNU General Public License version 3.", *words[1500:]])
    (tmp_path / "GPL-3").write_text(text)
    templates = licenses.TEMPLATES + licenses.whole_texts(str(tmp_path))
    assert licenses.whole_texts(str(tmp_path / "none")) == () and len(templates) == len(licenses.TEMPLATES) + 1
    near = " ".join("other" if w[0] == "w" and r.random() < 0.05 else w for w in text.split())
    far = " ".join("other" if r.random() < 0.5 else w for w in words)
    rows = [(1, f"license\n{text}\n{text}"), (2, f"license {near}"), (3, f"license {far}"), (4, None), (5, "")]
    got = {r.doc_id: [x.license for x in r.found] for r in licenses.scan(frame(spark, rows), templates).collect()}
    assert got == {1: ["GPL-3.0"] * 2, 2: ["GPL-3.0"], 3: [], 4: [], 5: []}


def test_many_notices_in_one_text():
    import time

    notices = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY 4.0.", "This work is licensed under the GNU General Public License, version 3."]
    scanner, took = licenses.Scanner(), []
    for n in (5000, 20_000):
        began = time.process_time()
        assert sum(1 for first, b in licenses.blocks("\n".join(notices[i % 4] for i in range(n))) for _ in scanner.every(first, b)) == n
        took.append(time.process_time() - began)
    assert took[1] < 20 and took[1] < 8 * took[0] + 1


# --- 6


def test_chunk_ids_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(tokenizer_path()), packing.ChunkEncoder(tokenizer_path(), entries=50)
    texts = ["", "  ", "á ́b", "İstanbul ΑΣ ΟΔΟΣ \x1c x\x1dy \xa0z w", "<|endoftext|> a<|startoftext|>b", "<|ENDOFTEXT|> x", "don't CAN'T'll 123 4", "\r\n\ta", "ẹ́ ﬁ Å", "日本 語　テスト。.", "a" * 3000, "\x00 \x85 힣", "Hello, WORLD!! a.b. (x)., it's! ’. é."]
    texts += ["".join(random.Random(i).choices("aAbé'. ,!|<>#\n\t1２ßΣςſK̈", k=40)) for i in range(300)]
    for x in texts:
        assert next(e.encode([x.encode()])) == np.asarray(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), repr(x)


def check_packing(rows, got, capacity=2048):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    total = 0
    for i, text in rows:
        ids = np.asarray(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        own = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == i)
        assert own == [(k, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
        total += len(ids)
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return total


@pytest.mark.parametrize("parts", [1, 12])
def test_packing(spark, parts):
    rows = corpus(4, 120) + [(5000 + i, "word " * (300 * i)) for i in range(12)]
    got = packing.pack(frame(spark, rows, parts), tokenizer_path()).collect()
    total = check_packing(rows, got)
    assert len({r.sequence_id for r in got}) <= -(-total // 2048) + 4
    assert packing.pack(empty(spark), tokenizer_path()).count() == 0


def test_packing_in_small_merges(spark):
    rows = [(i, "word " * 700) for i in range(40)]
    got = packing.pack(frame(spark, rows, 10), tokenizer_path(), merge_rows=5).collect()
    check_packing(rows, got)


def test_chunks_equal_whole_texts():
    """Characters of all categories before every trailing mark, in any order."""
    import unicodedata

    from tokenizers import Tokenizer

    r = random.Random(9)
    by_category = {}
    for c in range(0x20, 0x20000):
        if not 0xD800 <= c < 0xE000:
            by_category.setdefault(unicodedata.category(chr(c)), []).append(chr(c))
    kinds, whole = [*by_category.values(), list("İıŞǅΣςﬁẞŉK"), list("abcXYZ019")], Tokenizer.from_file(tokenizer_path())
    marks = [".", ",", ";", ":", "!", "?", "|", "#", "*", "$", "%", "&", "...", "?!", "&&&", ".,", " ", "\n"]
    texts = [f"{c}{m}" for k in kinds for c in r.sample(k, min(len(k), 40)) for m in marks]
    texts += ["".join(r.choice(r.choice(kinds)) if r.random() < 0.7 else r.choice(marks) for _ in range(r.randint(1, 12))) for _ in range(20_000)]
    encoder = packing.ChunkEncoder(tokenizer_path())
    for text, ids in zip(texts, encoder.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_best_fit_is_best_fit():
    r = np.random.default_rng(0)
    sizes = r.integers(1, 101, 500)
    into, at, fills = packing.best_fit(sizes, 100)
    rooms = []
    for i in np.argsort(-sizes, kind="stable"):
        fit = [k for k, room in enumerate(rooms) if room >= sizes[i]]
        if fit:
            rooms[min(fit, key=lambda k: rooms[k])] -= sizes[i]
        else:
            rooms.append(100 - sizes[i])
    assert len(fills) == len(rooms) and sorted(100 - f for f in fills) == sorted(rooms)


# --- 7


def brute_tiles(doc, item, least):
    least = min(least, len(item))
    marked_doc, marked_item = set(), set()
    while item:
        best = None
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and not {i + n} & marked_item and not {d + n} & marked_doc:
                    n += 1
                if n >= least and (best is None or n > best[0]):
                    best = (n, i, d)
        if best is None:
            return len(marked_item)
        n, i, d = best
        marked_item |= set(range(i, i + n))
        marked_doc |= set(range(d, d + n))
    return 0


def test_tiling_equals_brute_force(spark):
    r = random.Random(8)
    items = [(k, " ".join(r.choice("abcdef") + r.choice("xyz") for _ in range(n))) for k, n in enumerate([3, 8, 15, 30, 30, 0])] + [(77, None)]
    docs = []
    for i in range(40):
        w = r.choice(items[:5])[1].split()
        k = r.randrange(len(w))
        docs.append((i, "Intro. " + ", ".join(w[k:] + ["PAD"] + w[:k]).upper() + " end " + " ".join(r.choice("abcdef") + r.choice("xyz") for _ in range(10))))
    docs += [(100, None), (101, "")]
    words = lambda t: re.findall(r"[^\x20\x09-\x0d!-/:-@\[-`{-~]+", lower(t))
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    want = {}
    for i, t in docs:
        found = [(-(n := brute_tiles(words(t), words(x), 5)) / len(words(x)), k, n) for k, x in items if words(x)]
        want[i] = sorted((c, k) for c, k, n in found if n and -c >= 0.5)
    for chunk in (10**6, 20):
        got = {x.doc_id: x for x in decontamination.matches(frame(spark, docs), bench, chunk_words=chunk).collect()}
        assert {i: x.item_ids for i, x in got.items()} == {i: [k for _, k in w] for i, w in want.items()}
        assert all(x.contaminated == bool(want[i]) for i, x in got.items())
    kept = decontamination.clean(frame(spark, docs), bench)
    assert {x.doc_id for x in kept.collect()} == {i for i, w in want.items() if not w} and "family" in kept.columns
    assert not any(x.contaminated for x in decontamination.matches(frame(spark, docs), bench.limit(0)).collect())
    assert decontamination.matches(empty(spark), bench).count() == 0


def test_rows_are_the_same_in_any_chunks(spark):
    item = "one two three four five six seven eight"
    rows = [(1, f"intro {item}"), (1, f"intro {item}"), (None, f"{item} end"), (2, None), (None, "nothing"), (3, "")]
    bench = spark.createDataFrame([(1, item), (1, item), (2, "nine ten eleven twelve thirteen"), (3, "five six seven eight nine"), (4, item + " x y z")] * 3, "item_id long, text string")
    key = lambda df: sorted(map(str, df.collect()))
    whole = key(decontamination.matches(frame(spark, rows), bench))
    assert len(whole) == 6 and sum("item_ids=[1, 4]" in r for r in whole) == 3
    assert all(key(decontamination.matches(frame(spark, rows), bench, chunk_words=n)) == whole for n in (5, 40))
    left = sorted(str(tuple(r)) for r in frame(spark, rows).collect() if r.text in (None, "", "nothing"))
    assert all(sorted(str(tuple(r)) for r in decontamination.clean(frame(spark, rows), bench, chunk_words=n).collect()) == left for n in (5, 10**6))


def test_tiles_without_listed_places():
    r = random.Random(3)
    for _ in range(120):
        item, doc = ([r.choice("ab" if r.random() < 0.8 else "cd") for _ in range(r.randint(1, 40))] for _ in range(2))
        got = {}
        for most in (0, 10**6):
            seeds = decontamination.SeedIndex([0], [" ".join(item).encode()], 3, most)
            got[most] = list(seeds.covered([b"x y", " ".join(doc).encode()], 0.3))
        want = brute_tiles(doc, item, 3)
        assert got[0] == got[10**6] == ([(1, 0, want)] if want and want >= 0.3 * len(item) else [])


def test_equal_words_without_end():
    """Memory in proportion to the texts: 20,000 equal words against an item of 2,000 have 40 million places."""
    import tracemalloc

    seeds = decontamination.SeedIndex([1, 2], [b"word " * 2000, b"a b " * 1000], 5)
    tracemalloc.start()
    got = list(seeds.covered([b"word " * 20_000, b"a b " * 10_000], 0.5))
    assert got == [(0, 0, 2000), (1, 1, 2000)] and tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


# --- 8


def test_quality_counts(spark):
    rows = corpus(6, 60) + [(7000, "a b c a b c a b c d\nx\nx\n \nx #*$%&|<>!!")]
    for r in quality_rules.judge(frame(spark, rows)).collect():
        t = dict(rows)[r.doc_id] or ""
        w = re.findall(SPACE, t)
        seen = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {p for i, k in enumerate(zip(w, w[1:], w[2:], strict=False)) if seen[k] > 1 for p in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if re.search(SPACE, x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and (not r.base_failed or not r.kept)
    assert quality_rules.judge(empty(spark)).count() == 0


def test_clean_keeps_what_is_kept(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id for r in quality_rules.judge(d).collect() if r.kept}
    got = quality_rules.clean(d)
    assert got.columns == d.columns and {r.doc_id for r in got.collect()} == want


# --- 10


def test_url_rules(spark):
    urls = [
        "http://a.com", "http://a.com/", "HTTP://WWW.Example.COM/en/x?y", "http://example.com/en/", "http://m.example.com/en/1", "http://notexample.com/en/", "http://x.net/fr/1#t", "http://net/es/", "http://x.net/de/", None, "", "no scheme", "http://?q", "http://x.org/com/", "://com/", "a://b://c.com/",
    ]
    rows = [(i, u) for i, u in enumerate(urls)] + [(100 + i, f"http://h{i}.{t}/{p}/{i}") for i in range(300) for t, p in [(("com", "net", "org")[i % 3], ("en", "fr", "es")[i % 7 % 3])]]
    got = url_filters.judge(spark.createDataFrame([(i, u, "x") for i, u in rows], "page_id long, url string, host string"))
    for r in got.collect():
        u = dict(rows)[r.page_id] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host, path = lower(re.match(r"[^/?#]*", rest)[0]), re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = [x for x in url_filters.RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.key), default=None)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best and best.key, best.verdict if best else "allow"), u


def test_cascade_is_exact(spark):
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter("crc32(key) % 40 = 0")
    c = url_filters.build(listed, universe)
    assert len(c.levels) > 1
    got = {r.key for r in universe.filter(c.lists(F.col("key"))).collect()}
    assert got == {r.key for r in listed.collect()}
    assert not url_filters.build(listed.limit(0), universe).levels


def test_no_urls(spark):
    p = spark.createDataFrame([], "page_id long, url string")
    assert url_filters.judge(p).count() == 0
