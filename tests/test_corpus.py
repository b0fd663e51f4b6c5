"""Parsing, links, lint, graph and search on a small wiki of our own."""

import re

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import graph as G
from textloom.operators import links as L
from textloom.operators import lint
from textloom.operators import search as S
from textloom.sources import corpus, parse

PAGES = {
    "entities/falcon.md": "---\ntype: entity\ntitle: Falcon\ntags: [bird, fast]\ncreated: 2024-01-01\nupdated: 2024-01-02\nsources: [field-notes]\n---\nA falcon hunts. See [[heron|the heron]] and [[concepts/flight.md#speed]].\n\n## Speed\nVery fast falcon.\n\n```\n# not a heading\n```\n### Records\nFalcon Falcon.\n",
    "entities/heron.md": "---\ntype: entity\ntitle: Heron\ntags:\n  - bird\n  - water\nupdated: 2023-05-01\n---\nHerons wade. [[falcon]] [[missing]] [[sources/flight]] [[heron]]\n",
    "concepts/flight.md": "---\ntype: concept\ntitle: Flight\ntags: []\n---\n[[falcon]]\n# Lift\n### Drag\n## Thrust\ntext\n",
    "sources/field-notes.md": "---\ntype: source\ntitle: Notes\nraw: raw/notes.txt\n---\nNo links.\n",
    "concepts/broken.md": "---\ntype: concept\nno end",
    "index.md": "# Index\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("wiki")
    for name, text in PAGES.items():
        (base / name).parent.mkdir(exist_ok=True)
        (base / name).write_text(text)
    (base / "bad.md").write_bytes(b"\xff\xfe\xff")
    return str(base)


@pytest.fixture(scope="module")
def pages(spark, root):
    return parse.parse_pages(corpus.pages(spark, root)).persist()


def test_scan_leaves_out_index_and_unreadable(pages):
    assert {r.rel_path for r in pages.collect()} == {k for k in PAGES if k != "index.md"}


def test_lint_scan_keeps_unreadable(spark, root):
    got = {r.rel_path: r.read_error for r in corpus.lint_pages(spark, root).collect()}
    assert got["bad.md"] and not got["entities/heron.md"]


def test_frontmatter(pages):
    r = {x.slug: x for x in pages.collect()}
    assert r["falcon"].tags == ["bird", "fast"] and r["heron"].tags == ["bird", "water"]
    assert r["broken"].malformed and not r["heron"].malformed
    assert r["heron"].links == ["falcon", "missing", "sources/flight", "heron"]


def fields(spark, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(parse.frontmatter("t").alias("f"))
    return [({k: v["items"] if v["is_list"] else v["items"][0] for k, v in r.f.meta.items()}, r.f.body, r.f.malformed) for r in df.collect()]


def test_frontmatter_values(spark):
    got = fields(
        spark, "---\ntags:\n  - a\ntitle: T\n  - b\n---\nx", "---\na: [x, 'y', , \"z\"]\nb: \"q'\nb: last\n\nc:\n  - '1'\nd:\n  - 2\n - no\ne-f: no\n--- \nbody\n---\n", "---\nopen: 1", "plain", None, "---\n\n---\n",
    )
    assert got == [
        ({"tags": ["a", "b"], "title": "T"}, "x", False), ({"a": ["x", "y", "z"], "b": "last", "c": ["1"], "d": ["2"]}, "body\n---\n", False),
        ({}, "---\nopen: 1", True), ({}, "plain", False), ({}, "", False), ({}, "", False),
    ]


def test_sections_nest_and_skip_fences():
    s = parse.sections(PAGES["entities/falcon.md"].split("---\n", 2)[2])
    assert [x["heading_path"] for x in s] == [[], ["Speed"], ["Speed", "Records"]]
    s = parse.sections("# Lift\n### Drag\n## Thrust\ntext")
    assert [x["heading_path"] for x in s] == [[], ["Lift"], ["Lift", "Drag"], ["Lift", "Thrust"]]
    assert s[0]["text"] == "" and parse.sections(None)[0]["section_index"] == 0


def test_sections_equal_plain_python(spark):
    """Random Markdown with fences, deep and closed headings, odd line ends and white space; no Python in the plan."""
    import random

    r = random.Random(6)
    parts = ["# One", "## Two ##", "### deep three", "#", "#tag", "###### six  ", "####### seven", "```", "```py", "~~~", "  ```", "text", "", " # no", "##\ttab", "# a # b #", "\u2003", "x\u2028# y", "- ```", "# \u00e9"]
    texts = [r.choice(["\n", "\r\n", "\n", "\x0b"]).join(r.choice(parts) for _ in range(r.randint(0, 14))) + r.choice(["", "\n"]) for _ in range(400)] + [None, "", "\n", "\n".join(f"# h{i}\nx" for i in range(2000))]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(parse.split_sections("t").alias("s"))
    assert [[x.asDict() for x in row.s] for row in df.collect()] == [parse.sections(t) for t in texts]
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def plain_frontmatter(block):
    """Entries of a block's lines, from last to first."""
    lines = [(x, re.match(r"([a-zA-Z_]+):\s*(.*)$", x)) for x in block.split("\n")]
    found = {m[1]: (i, m[2].strip()) for i, (_, m) in enumerate(lines) if m}
    bare = lambda x: x.strip().strip('"').strip("'")

    def owner(i):
        return next((m[1] for _, m in reversed(lines[:i]) if m and not m[2].strip()), None)

    out = {}
    for name, (at, value) in found.items():
        below = [bare(x[4:]) for i, (x, m) in enumerate(lines) if i > at and not m and x.startswith("  - ") and owner(i) == name]
        inside = [bare(x) for x in value[1:-1].split(",") if x.strip()] if value[:1] == "[" and value[-1:] == "]" and len(value) > 1 else None
        out[name] = below if not value else value.strip('"').strip("'") if inside is None else inside + below
    return out


def test_frontmatter_equals_plain_python(spark):
    import random

    r = random.Random(2)
    parts = ["a:", "b:", "c: [x]", "a: [p, 'q']", "b: one", 'c: "two"', "  - i1", "  - 'i2'", " - no", "", "d: []", "a:  ", "e-f: x", "  -", "c:"]
    blocks = ["\n".join(r.choice(parts) for _ in range(r.randint(1, 10))) for _ in range(600)]
    got = fields(spark, *[f"---\n{b}\n---\nbody" for b in blocks])
    assert [g[0] for g in got] == [plain_frontmatter(b) for b in blocks]


def test_sentences_of_fences(spark):
    import random

    r = random.Random(3)
    parts = ["```", "~~~py", "One is. Two", "code.", "", "# H", "- item", "---", "  ```"]
    texts = ["\n".join(r.choice(parts) for _ in range(r.randint(1, 9))) for _ in range(300)] + ["x\n```", "```", "a\n```\nb.\n```\nc"]

    def prose(t):
        out, shut = [], False
        for x in t.split("\n"):
            fence = re.match(r"\s*(```|~~~)", x)
            shut ^= bool(fence)
            out.append("" if fence or shut else x)
        return "\n".join(out)

    frame = lambda ts: spark.createDataFrame([(t,) for t in ts], "t string").coalesce(1).select(parse.split_sentences("t").alias("s"))
    assert [x.s for x in frame(texts).collect()] == [x.s for x in frame([prose(t) for t in texts]).collect()]


def test_page_body_round_trip(pages):
    r = pages.filter("slug = 'flight'").select(parse.page_body("sections").alias("b"), "body").first()
    assert [x for x in r.b.split("\n") if x] == [x for x in r.body.split("\n") if x]


def test_sentences(spark):
    texts = [
        "# H\nOne is. Two is!\ncontinued?\n\n- item a\n- item b\n```\ncode.\n```\n", "## Title\n\nFirst sentence. Second one!\ncontinues here? Yes.\n\n- item one\n```\ncode. not a sentence.\n```\n> quoted line",
        "a  b\tc\n---\nd\n~~~\nx\n~~~\ne", "#\n#tag\n1) one\n2. two\n-no\n> - q", "x" * 500, "open\n```\nnever closed.\n", None, "", "   \n \nlast\n \n",
    ]
    got = [r.s for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(parse.split_sentences("t").alias("s")).collect()]
    assert got == [
        ["H", "One is.", "Two is!", "continued?", "item a", "item b"], ["Title", "First sentence.", "Second one!", "continues here?", "Yes.", "item one", "quoted line"],
        ["a b c", "d", "e"], ["# #tag", "one", "two", "-no", "- q"], ["x" * 300], ["open"], [], [], ["last"],
    ]
    cut = spark.createDataFrame([("a. b. c. d.",)], "t string").select(parse.split_sentences("t", 2).alias("s")).first().s
    assert cut == ["a.", "b."]


def test_sections_by_heading_and_place(spark, pages):
    body = "# Index\n\n## Concepts\n- a\n### Deep\nx\n\n## Sources\n- s\n"
    df = spark.createDataFrame([(body,)], "b string").withColumn("s", parse.split_sections("b"))
    one = lambda c: df.select(c.alias("x")).first().x
    assert one(parse.heading_section("s", "## concepts")) == "## Concepts\n- a\n### Deep\nx\n" and one(parse.heading_section("s", "none")) is None
    assert one(parse.section_excerpt("b", body.index("- a"))) == "## Concepts\n- a" and one(parse.section_excerpt("b", 0)) == "# Index\n"
    assert one(parse.section_excerpt("b", 10_000, 5)) == "## So"
    assert one(parse.schema_gaps("b", ("## Sources", "## Source", "Deep", "lost"))) == ["## Source", "lost"]
    out = parse.outline(spark.createDataFrame([("p", "# A b\n## A b\n# C\n## a B!\n")], "rel_path string, b string").withColumn("sections", parse.split_sections("b")))
    assert [(r.level, r.heading, r.anchor) for r in out.orderBy("section_index").collect()] == [(1, "A b", "a-b"), (2, "A b", "a-b-1"), (1, "C", "c"), (2, "a B!", "a-b-2")]
    kinds = spark.createDataFrame([("---\nx: 1\ntype: 'a b'\ntype: c\n---\n",), ("---\ntypes: 1\n---\n",), ("type: x",)], "t string").coalesce(1).select(parse.page_type("t").alias("k"))
    assert [r.k for r in kinds.collect()] == ["a b", None, None]


def test_yaml(spark):
    df = spark.createDataFrame([("---\na: [1, {b: 2}]\n---\n",), ("---\n: : [\n---\n",), ("none",)], "t string").coalesce(1)
    assert [r.j for r in df.select(parse.yaml_frontmatter("t").alias("j")).collect()] == ['{"a": [1, {"b": 2}]}', "{}", "{}"]


def test_parse_cache_changes_nothing(spark, root, pages):
    files = corpus.pages(spark, root)
    cold = corpus.parse_incremental(files, None)
    stale = pages.withColumn("sha256", F.when(F.col("slug") == "heron", "old").otherwise(F.col("sha256")))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(corpus.parse_incremental(files, stale)) == key(cold)


def test_links_resolve(pages):
    r = L.resolve(L.link_rows(pages), pages)
    got = {(x.src_slug, x.raw): x.target for x in r.collect()}
    assert got["falcon", "heron"] == "heron" and got["falcon", "concepts/flight.md#speed"] == "flight"
    assert got["heron", "sources/flight"] is None and got["heron", "missing"] is None
    assert {x.slug for x in L.backlinks(r, "falcon").collect()} == {"heron", "flight"}
    assert L.top_linked(r, 1).first().key == "falcon"
    assert {x.slug for x in L.orphans(pages, r).collect()} == {"field-notes", "broken"}


def test_find_page(spark, pages):
    w = spark.createDataFrame([("FALCON",), ("Concepts/Flight",), ("nope",)], "name string")
    assert {r.name: r.rel_path for r in L.find_page(pages, w).collect()} == {"FALCON": "entities/falcon.md", "Concepts/Flight": "concepts/flight.md", "nope": None}


def test_lint_report(pages):
    rows = {(r.category, r.path) for r in lint.report(pages, "2024-06-01", 1).collect()}
    assert ("broken_links", "entities/heron.md") in rows and ("malformed_frontmatter", "concepts/broken.md") in rows
    assert ("missing_frontmatter", "concepts/broken.md") not in rows and ("missing_frontmatter", "concepts/flight.md") in rows and ("missing_frontmatter", "entities/falcon.md") not in rows
    n = {r.category: r.n for r in lint.summary(lint.report(pages, "2024-06-01")).collect()}
    assert n["oversized_hard"] == 0 and n["orphans"] == 2


def test_search_sections(pages):
    s = parse.section_rows(pages)
    got = S.search(s, "falcon", n=10, per_page=2).collect()
    assert got[0].slug == "falcon" and got[0].heading_path == ["Speed", "Records"] and sum(r.slug == "falcon" for r in got) == 2
    assert got[0].neighbors.prev == "Speed" and got[0].neighbors.next is None
    only = S.search(s, "falcon", S.Filters(tags=("water",)))
    assert {r.slug for r in only.collect()} == {"heron"}
    assert {r.slug for r in S.search(s, "falcon", S.Filters(since="2024-01-01")).collect()} == {"falcon"}
    assert S.search(s, "?!").count() == 0


def test_hybrid_falls_back_and_fuses(spark, pages):
    s = parse.section_rows(pages)
    v = s.select("rel_path", "section_index", F.when(F.col("slug") == "flight", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).cast("array<float>").alias("embedding"))
    q = spark.createDataFrame([([1.0, 0.0],)], "q array<float>")
    got = {r.slug: r.retrievers for r in S.search(s, "falcon", vectors=v, query_vector=q, per_page=1).collect()}
    assert got["falcon"] == ["lexical"] and "vector" in got["flight"]


def test_bm25_by_hand(spark):
    import math

    rows = [(1, "a b a"), (2, "b c"), (3, "c c c c"), (4, "")]
    got = {r.id: r.score for r in S.bm25(spark.createDataFrame(rows, "id int, t string"), "t", "a c a").collect()}
    n, avg = 4, (3 + 2 + 4 + 0) / 4
    idf = lambda d: math.log(1 + (n - d + 0.5) / (d + 0.5))
    part = lambda tf, dl, d: idf(d) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    assert got == pytest.approx({1: 2 * part(2, 3, 1), 2: part(1, 2, 2), 3: part(4, 4, 2)})


def test_graph(spark, pages):
    onto, preds = corpus.ontology(spark, "node_types:\n  bird: {maps_from: {type: entity}}\npredicates:\n  eats: {subject_types: [bird], object_types: [bird], requires_evidence: true}\n")
    rel = "array<struct<predicate:string,object:string,source:string,evidence:string,confidence:string,status:string>>"
    t = pages.select("rel_path", "slug", "title", "type", "sources", F.coalesce(parse.meta_text("raw"), F.lit("")).alias("raw"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("explicit_type"), F.lit(None).cast("string").alias("node_id"), F.array().cast("array<string>").alias("aliases"))
    eats = F.array(F.struct(F.lit("eats").alias("predicate"), F.lit("bird:heron").alias("object"), F.lit("").alias("source"), F.lit(None).cast("string").alias("evidence"), F.lit("sure").alias("confidence"), F.lit("current").alias("status")))
    t = G.node_types(t.withColumn("relationships", F.when(F.col("slug") == "falcon", eats).otherwise(F.array()).cast(rel)), onto)
    nodes, slugs, _ = G.build_nodes(t)
    assert {r.id for r in nodes.collect()} == {"bird:falcon", "bird:heron", "concept:flight", "concept:field-notes", "concept:broken"}
    e = G.build_edges(nodes, slugs, L.resolve(L.link_rows(pages), pages)).persist()
    got = {(r.subject, r.predicate, r.object) for r in e.collect()}
    assert got == {
        ("bird:falcon", "eats", "bird:heron"), ("bird:falcon", "mentions", "bird:heron"), ("bird:falcon", "mentions", "concept:flight"), ("bird:heron", "mentions", "bird:falcon"),
        ("concept:flight", "mentions", "bird:falcon"), ("bird:falcon", "sourced_from", "concept:field-notes"), ("concept:field-notes", "summarizes_raw", "raw:raw/notes.txt"),
    }
    path = G.shortest_path(e, nodes, "bird:heron", "concept:flight").orderBy("hop").collect()
    assert [r.node for r in path] == ["bird:heron", "bird:falcon", "concept:flight"]
    assert [r.node for r in G.shortest_path(e, nodes, "bird:heron", "bird:heron").collect()] == ["bird:heron"]
    assert G.shortest_path(e, nodes, "concept:broken", "bird:heron").count() == 0 and G.shortest_path(e, nodes, "x", "bird:heron").count() == 0
    assert {(r.node, r.distance) for r in G.neighbors(e, "concept:flight", 2).collect()} == {("bird:falcon", 1), ("bird:heron", 2), ("concept:field-notes", 2)}
    found = {r.category for r in G.lint_edges(e.withColumn("contradicts", F.lit("bird:falcon")).withColumn("supersedes", F.lit("nobody")), nodes, preds).collect()}
    assert found == {"missing_evidence", "missing_source_field", "invalid_confidence", "broken_supersedes"}
    found = {r.category for r in G.lint_edges(e, nodes, preds).collect()}
    assert found == {"missing_evidence", "missing_source_field", "invalid_confidence"}
    assert {r.id for r in G.orphan_nodes(nodes, e).collect()} == {"concept:flight", "concept:field-notes", "concept:broken"}
    assert G.neighbor_rows(e, nodes, "bird:heron").first().title == "Falcon"
    xml = "\n".join(r.value for r in G.graphml(nodes, e).orderBy("ord").collect())
    import xml.etree.ElementTree as ET

    assert len(ET.fromstring(xml.encode()).findall(".//{*}edge")) == 7


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(X.split_lines(F.lit("a\r\nb\u2028c\n"))) == ["a", "b", "c"]
    assert one(X.snippet(F.lit("  a\n b  "))) == "a b"
    assert one(X.line_slice(F.lit("1\n2\n3\n4"), 2, 3)) == "2\n3"
    assert one(X.replace_unique(F.lit("aba"), "b", "c")) == "aca" and one(X.replace_unique(F.lit("aba"), "a", "c")) is None
    assert one(X.truncate_evidence(F.lit("x" * 150))).endswith("…") and len(one(X.truncate_evidence(F.lit("x" * 150)))) == 140
    assert one(X.clean_target(F.lit("/a\\b.MD#c|d"))) == "a/b" and one(X.slug_of(F.lit("a/.hidden"))) == ".hidden"
    assert one(X.path_error(F.lit("a/../b.md"))) == "bad_component" and one(X.path_error(F.lit("a/b.md"))) is None
    assert one(X.iso_date(F.lit("2026-2-3"))) is None and str(one(X.iso_date(F.lit("2026-02-03T10")))) == "2026-02-03"
    assert one(X.since(F.lit("x"), "2024-01-01")) is False and one(X.since(F.lit(None).cast("string"), "junk")) is True
    assert one(X.renormalize(F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.lit(3.0), F.lit("z"), F.lit(9.0)), ["a", "b"])) == {"a": 0.25, "b": 0.75}
    assert one(X.types_match(F.array(F.lit("*")), F.lit("q"))) and not one(X.types_match(F.array(F.lit("p")), F.lit("q")))
    assert one(X.heading_slug(F.lit(" A b! C "))) == "a-b-c" and one(X.escape_xml(F.lit('<a&">'))) == "&lt;a&amp;&quot;&gt;"


def test_import_scan(spark, root):
    got = {r.rel_path: r.reason for r in corpus.import_scan(corpus.files(spark, root)).collect()}
    assert got["bad.md"] == "not_utf8" and got["index.md"] == "generated" and got["entities/heron.md"] is None


def test_order_and_partitions_do_not_matter(pages):
    a = S.search_pages(pages.repartition(8), "falcon heron").collect()
    assert a == S.search_pages(pages.coalesce(1).orderBy(F.desc("slug")), "falcon heron").collect()


def test_folding_clipping_and_ranges(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(X.folded(F.lit(" Straße ΣΟΦΟΣ "))) == one(X.folded(F.lit("STRASSE σοφοσ")))
    assert one(X.clip(F.lit("a😀b"), 2)) == "a😀"
    assert one(X.bounded(F.array(F.lit("aa"), F.lit("b" * 5), F.lit("c")), 14, 4)) == ["aa", "bbbb"]
    assert one(X.renormalize(F.create_map(F.lit("yes"), F.lit(0.25)), ["yes", "no"])) == {"yes": 0.25, "no": 0.75}
    assert one(X.link_stem(F.lit("a/b/C.md#x|y"))) == "C"
    text = "aé😀z"
    data = text.encode()
    for offset in range(len(data)):
        for length in range(1, len(data) + 2):
            r = one(X.byte_range(F.lit(bytearray(data)), offset, length))
            raw = data[offset : offset + length]
            low = next((k for k in range(min(4, len(raw) + 1)) if k == len(raw) or raw[k] & 0xC0 != 0x80), 0)
            body = raw[low:]
            while body and offset + len(raw) < len(data):
                try:
                    body.decode()
                    break
                except UnicodeDecodeError:
                    body = body[:-1]
            assert r.encoding == "utf-8" and (r.text, r.offset, r.length, r.total_bytes) == (body.decode(), offset + low, len(body), len(data)), (offset, length)
    r = one(X.byte_range(F.lit(bytearray(b"\xff\xfe\x00")), 0, 2))
    assert (r.encoding, r.data, r.more) == ("base64", "//4=", True) and one(X.byte_range(F.lit(bytearray(b"abc")), 5, 2)) is None


def test_phrases_of_all_languages(spark, sf):
    import re
    from collections import defaultdict

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    on = defaultdict(set)
    for r in docs.collect():
        for m in re.finditer(r"\b([A-Z][a-zA-Z0-9]+(?:\s+[A-Z][a-zA-Z0-9]+){0,3})\b", r.text or ""):
            on[m[1].strip()].add(r.doc_id)
    want = sorted(((-len(v), k) for k, v in on.items() if len(v) >= 5 and k.split()[0] not in lint.HEADERS))[:30]
    got = lint.phrases(docs, "text", "doc_id", 5).collect()
    assert {(-r.page_count, r.phrase) for r in got} == set(want) and all(r.pages == sorted(on[r.phrase])[:5] for r in got)


def test_postings_in_buckets(spark, pages, tmp_path):
    posts, docs = S.postings(pages, ["rel_path"], "body")
    S.write_postings(posts, str(tmp_path / "p"), 8)
    kept = spark.read.parquet(str(tmp_path / "p"))
    want = {r.rel_path: round(r.score, 9) for r in S.bm25(pages, "body", "falcon heron falcon").collect()}
    hits = S.bm25_postings(kept, docs, ["rel_path"], "falcon heron falcon", buckets=8)
    assert {r.rel_path: round(r.score, 9) for r in hits.collect()} == want
    assert "PartitionFilters: [isnotnull" in hits._jdf.queryExecution().toString() or "bucket#" in hits._jdf.queryExecution().toString()
    assert S.bm25_postings(posts, docs, ["rel_path"], "?!").count() == 0 and S.bm25_postings(posts, docs, ["rel_path"], "absent").count() == 0
    for scope in ("filtered", "index"):
        want = {r.rel_path: round(r.score, 9) for r in S.bm25(pages, "body", "falcon heron", F.col("type") == "entity", scope).collect()}
        allowed = pages.filter("type = 'entity'").select("rel_path")
        assert {r.rel_path: round(r.score, 9) for r in S.bm25_postings(posts, docs, ["rel_path"], "falcon heron", allowed, scope).collect()} == want


def test_only_changed_texts_are_embedded(spark, tmp_path):
    from textloom.operators import vectors as V

    seen = str(tmp_path / "seen")

    def embed(texts):
        with open(seen, "a") as f:
            f.writelines(t + "\n" for t in texts)
        return [[1.0] for _ in texts]

    now = spark.createDataFrame([("a", "same"), ("b", "new text"), ("c", "added")], "path string, t string")
    before = spark.createDataFrame([("a", "same"), ("b", "old"), ("z", "gone")], "path string, t string").select("path", X.content_hash("m", "t"))
    old = spark.createDataFrame([(p, h, [0.0]) for p, h in before.collect()], "path string, content_hash string, embedding array<float>")
    got = {r.path: r.embedding for r in V.sync(now, old, ["path"], "t", "m", embed).collect()}
    assert got == {"a": [0.0], "b": [1.0], "c": [1.0]} and set(open(seen).read().split("\n")) == {"new text", "added", ""}
    assert {r.path: r.state for r in V.states(now, old, ["path"], "t", "m").collect()} == {"a": "kept", "b": "changed", "c": "new", "z": "stale"}
    assert V.usable(old, {"model": "x"}, {"model": "m"}).count() == 0 and [V.backoff(n) for n in (0, 1, 2, 20)] == [0, 30_000, 60_000, 3_600_000]


def test_agents_name_their_fields(spark):
    from textloom.sources import agents

    def ran(agent, *events):
        import json

        lines = spark.createDataFrame([(i, e if isinstance(e, str) else json.dumps(e)) for i, e in enumerate(events)], "ord long, value string")
        return {(r.call, r.command, r.output) for r in agents.commands(agents.observable(agents.parse_lines(lines)[0], agent)).collect()}

    call = {"type": "tool_use", "id": "1", "input": {"command": "ls"}}
    assert ran("claude", "hello", {"message": {"content": [{"type": "text", "text": "x"}, call, call | {"id": "9", "name": "StructuredOutput"}]}}, {"message": {"content": [{"type": "tool_result", "tool_use_id": "1", "content": "out"}]}}, {"message": {"content": "t"}}) == {("1", "ls", "out")}
    assert ran("cursor", {"type": "tool_call", "call_id": "a", "tool_call": {"shell": {"args": {"command": "pwd"}, "result": "here"}}}, {"type": "thinking"}) == {("a", "pwd", "here")}
    assert ran("pi", {"type": "tool_execution_start", "toolCallId": "a", "args": {"command": "x"}}, {"type": "tool_execution_end", "toolCallId": "a", "result": "r"}) == {("a", "x", "r")}
    assert ran("opencode", {"type": "tool_use", "part": {"callID": "p", "state": {"input": {"command": "c"}, "output": "o"}}}) == {("p", "c", "o")}
    assert ran("other", {"params": {"update": {"sessionUpdate": "tool_call", "toolCallId": "u", "rawInput": {"command": "c"}}}}, {"params": {"update": {"sessionUpdate": "agent_thought"}}}) == {("u", "c", None)}
    assert ran("gemini", {"type": "tool_use", "tool_id": "g", "parameters": {"command": "c"}}, {"type": "tool_result", "tool_id": "g", "output": "o"}, "[1]", "") == {("g", "c", "o")}
    checks = spark.createDataFrame([(1, ["git", "status"]), (2, ["git", "push"])], "id int, fragments array<string>")
    assert {r.id: r.passed for r in agents.command_checks(checks, spark.createDataFrame([("git -v status",), ("push",)], "command string")).collect()} == {1: True, 2: False}


def test_exports(spark, tmp_path):
    from textloom.operators import store as St
    from textloom.sources import export

    v = St.commit(spark, spark.createDataFrame([], St.VERSIONS), [{"op": "create", "path": "a/é.md", "content": "x\n\"y\""}, {"op": "create", "path": "b.md", "content": ""}], 7)
    lines = list(export.lines(export.ndjson(v)))
    assert len(lines) == 3 and export.write_tar(lines, str(tmp_path / "t.tgz")) == 7
    manifest, files = export.read_tar(str(tmp_path / "t.tgz"))
    assert files == {"a/é.md": "x\n\"y\"", "b.md": ""} and manifest["seq"] == 7 and set(manifest["files"]) == set(files)
    with pytest.raises(ValueError):
        export.write_tar(lines[:2], str(tmp_path / "u.tgz"))
    export.write_ndjson(v, str(tmp_path / "n"))
    assert spark.read.text(str(tmp_path / "n")).count() == 3


def test_raw_scans_and_snapshots(spark, root, tmp_path):
    raw = corpus.raw_scan(spark, root)
    assert {"bad.md", "index.md"} <= {r.rel_path for r in raw.collect()}
    h = corpus.snapshot_hash(raw).first()
    assert h == corpus.snapshot_hash(raw.repartition(5)).first() and h.digest != corpus.snapshot_hash(raw.limit(2)).first().digest and h.files == raw.count()
    linked = corpus.files(spark, root).withColumn("link", F.col("rel_path") == "index.md")
    assert {r.rel_path: r.reason for r in corpus.import_scan(linked).collect()}["index.md"] == "symlink"
    path = corpus.write_snapshot(raw, str(tmp_path), 3)
    assert path.endswith("snapshot=3") and spark.read.parquet(path).count() == raw.count()
    assert corpus.questions(spark, '{"a": {"threshold": 0.7}, "b": {}}').collect()[1].threshold == 0.5
    assert '"query":"q"' in corpus.envelope(raw.limit(1).select("rel_path"), "q", "lexical").first().value


def test_unreadable_pages_are_findings_of_that_kind_only(spark, root):
    rows = {(r.category, r.path) for r in lint.report(corpus.lint_pages(spark, root), "2024-06-01").collect()}
    assert {c for c, p in rows if p == "bad.md"} == {"read_errors"}
    text = [r.value for r in lint.text_report(lint.report(corpus.lint_pages(spark, root), "2024-06-01"), 1).orderBy("ord").collect()]
    assert "Unreadable pages (1):" in text and "  - bad.md: not UTF-8" in text and any(t.startswith("  ... and ") for t in text)


def test_pages_to_graph(spark):
    rel = "graph:\n  canonical: true\n  aliases: [x, 5]\n  relationships:\n    - {predicate: eats, object: 'bird:b', source: s, evidence: e, confidence: high, valid_from: 2024-01-01}\n    - {predicate: eats}\n    - text\n    - {object: o}\n"
    texts = [("a.md", f"---\ntype: page\n{rel}---\n[[b]]"), ("b.md", "---\ntype: page\ngraph: {node_type: bird, aliases: [x]}\n---\n[[a]] [[s]]"), ("s.md", "---\ntype: source\nraw: r.txt\n---\n"), ("c.md", "---\n: : [\n---\nx"), ("d/b.md", "---\ngraph: {node_id: 'bird:b'}\n---\n")]
    onto, preds = corpus.ontology(spark, "node_types: {topic: {maps_from: {type: page}}, source: {maps_from: {type: source}}}\npredicates: {eats: {subject_types: [topic], object_types: [bird]}}\n")
    typed, nodes, edges, aliases = G.from_files(spark.createDataFrame(texts, "rel_path string, content string"), onto)
    assert {(r.id, r.rel_path) for r in nodes.collect()} == {("topic:a", "a.md"), ("bird:b", "b.md"), ("source:s", "s.md"), ("concept:c", "c.md")}
    assert ("topic:a", "eats", "bird:b", "s") in {(r.subject, r.predicate, r.object, r.source) for r in edges.collect()}
    found = sorted((r.category, r.subject) for r in G.report(typed, nodes, edges, aliases, preds).collect())
    assert found == [("alias_collisions", "x"), ("duplicate_node_ids", "bird:b"), ("missing_evidence", "topic:a"), ("missing_source_field", "topic:a"), ("unknown_predicates", "topic:a")]
    n = {r.name: r.n for r in G.summary(G.report(typed, nodes, edges, aliases, preds), typed, nodes).collect()}
    assert n["pages_scanned"] == 5 and n["nodes"] == 4 and set(G.FINDINGS) <= set(n)
    lines = G.json_lines(edges.filter("predicate = 'eats'")).first().value
    assert list(__import__("json").loads(lines)) == sorted(G.EDGE)
