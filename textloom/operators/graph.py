"""Typed property graph: nodes, edges, neighbours, facts, shortest paths, integrity findings and exports."""

from __future__ import annotations

import json

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import text as X
from textloom.operators import links as L
from textloom.sources import parse

# Fixed values of the edge vocabulary.
CONFIDENCE = ("low", "medium", "high")
STATUS = ("current", "historical", "proposed", "disputed", "superseded")
EXTRAS = ("valid_from", "valid_to", "notes", "raw_ref", "contradicts", "supersedes")
IMPLICIT = ("mentions", "sourced_from", "summarizes_raw")
EDGE = ["id", "subject", "predicate", "object", "source", "evidence", "confidence", "status", "extraction_method", "page"]
FINDINGS = (
    "duplicate_node_ids", "duplicate_canonical", "alias_collisions", "unknown_predicates", "broken_object_refs", "subject_type_mismatch", "object_type_mismatch",
    "missing_evidence", "missing_source_field", "broken_source_refs", "invalid_confidence", "invalid_status", "broken_contradicts", "broken_supersedes", "orphan_typed_nodes",
)


def node_types(pages: DataFrame, ontology: DataFrame) -> DataFrame:
    """pages (with rel_path, type, kind, explicit_type) with node_type: the explicit one, else the first ontology rule for
    (type, kind), else for type alone, else concept. ontology: rows (node_type, type, kind, explicit_only, ord)."""
    rules = ontology.filter(~F.coalesce(F.col("explicit_only"), F.lit(False)))
    exact = rules.filter("kind is not null").groupBy("type", "kind").agg(F.min_by("node_type", "ord").alias("_exact"))
    loose = rules.filter("kind is null").groupBy("type").agg(F.min_by("node_type", "ord").alias("_loose"))
    j = pages.join(exact, ["type", "kind"], "left").join(loose, "type", "left")
    return j.select(*pages.columns, F.coalesce("explicit_type", "_exact", "_loose", F.lit("concept")).alias("node_type"))


def build_nodes(typed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes: the first page of every id; slug -> id, the last page with a slug wins; aliases) of typed pages."""
    t = with_id(typed)
    nodes = t.withColumn("_k", F.row_number().over(W.partitionBy("id").orderBy("rel_path"))).filter("_k = 1").drop("_k")
    slugs = nodes.groupBy("slug").agg(F.max_by("id", "rel_path").alias("id"))
    aliases = nodes.select(F.explode("aliases").alias("alias"), F.col("id").alias("node_id"))
    return nodes, slugs, aliases


def make_edges(rows: DataFrame, method: str, order: int, **columns) -> DataFrame:
    """Edges of one family from rows with page; missing parts are empty."""
    part = lambda name: columns.get(name, F.lit(None)).cast("string")
    e = rows.select(*[part(n).alias(n) for n in ("subject", "predicate", "object", "source", "evidence", "confidence", "status")], F.lit(method).alias("extraction_method"), F.col("page"), columns.get("ord", F.lit(0)).cast("long").alias("_ord"), F.lit(order).alias("_family"))
    e = e.withColumn("id", X.edge_id("subject", "predicate", "object", "source", "evidence"))
    return e.fillna("", ["source", "evidence", "confidence", "status"])


def build_edges(pages: DataFrame, slugs: DataFrame, resolved: DataFrame) -> DataFrame:
    """The four edge families, the first occurrence of an id winning.

    pages: with rel_path, slug, type, sources, raw, relationships (array of structs), those whose node is another page's
    too; resolved: links with target.
    """
    own = pages.select(F.col("rel_path").alias("page"), F.col("slug"), "type", "sources", "raw", "relationships").join(slugs.withColumnRenamed("id", "subject_id"), "slug")
    rel = own.select("page", "subject_id", F.posexplode("relationships").alias("ord", "r")).filter("r.object is not null and r.predicate is not null")
    explicit = make_edges(rel, "explicit_graph_frontmatter", 1, subject=F.col("subject_id"), predicate=F.col("r.predicate"), object=F.col("r.object"), source=F.col("r.source"), evidence=F.col("r.evidence"), confidence=F.col("r.confidence"), status=F.col("r.status"), ord=F.col("ord"))
    ids = slugs.select(F.col("slug").alias("target"), F.col("id").alias("object_id"))
    link = resolved.filter("target is not null and target <> src_slug").join(ids, "target").join(own.select(F.col("page").alias("src"), "subject_id"), "src")
    link = link.groupBy(F.col("src").alias("page"), "subject_id", "object_id").agg(F.min("ord").alias("ord"))
    mentions = make_edges(link, "body_wikilink", 2, subject=F.col("subject_id"), predicate=F.lit("mentions"), object=F.col("object_id"), confidence=F.lit("low"), status=F.lit("current"), ord=F.col("ord"))
    src = own.filter("type is null or type <> 'source'").select("page", "subject_id", F.posexplode("sources").alias("ord", "target")).join(ids, "target")
    sourced = make_edges(src, "frontmatter_sources", 3, subject=F.col("subject_id"), predicate=F.lit("sourced_from"), object=F.col("object_id"), source=F.col("target"), confidence=F.lit("high"), status=F.lit("current"), ord=F.col("ord"))
    raw = make_edges(own.filter("type = 'source' and raw <> ''"), "frontmatter_raw", 4, subject=F.col("subject_id"), predicate=F.lit("summarizes_raw"), object=F.concat(F.lit("raw:"), "raw"), confidence=F.lit("high"), status=F.lit("current"))
    every = explicit.unionByName(mentions).unionByName(sourced).unionByName(raw)
    first = every.withColumn("_k", F.row_number().over(W.partitionBy("id").orderBy("page", "_family", "_ord"))).filter("_k = 1")
    return first.select(*EDGE)


def neighbors(edges: DataFrame, node: str, depth: int = 1, predicate: str | None = None) -> DataFrame:
    """node, distance of all nodes within depth (at most 3) of a node, edges in either direction."""
    e = edges if predicate is None else edges.filter(F.col("predicate") == predicate)
    both = e.select(F.col("subject").alias("a"), F.col("object").alias("b")).unionByName(e.select(F.col("object").alias("a"), F.col("subject").alias("b")))
    seen = edges.sparkSession.createDataFrame([(node, 0)], "node string, distance int")
    front = seen
    for d in range(1, max(1, min(3, depth)) + 1):
        step = both.join(front.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct()
        front = step.join(seen, "node", "left_anti").withColumn("distance", F.lit(d))
        seen = seen.unionByName(front)
    return seen.filter("distance > 0")


def neighbor_rows(edges: DataFrame, nodes: DataFrame, node: str, most: int = 100) -> DataFrame:
    """Direct neighbours with title, the number n of connecting edges, and the first of them in order of (predicate, object, id)."""
    out = edges.filter(F.col("subject") == node).select(F.col("object").alias("node"), "predicate", "object", "id", F.lit("out").alias("direction"))
    in_ = edges.filter(F.col("object") == node).select(F.col("subject").alias("node"), "predicate", "object", "id", F.lit("in").alias("direction"))
    g = first_k(out.unionByName(in_), ["node"], ["predicate", "object", "id", "direction"], most, "edges")
    return g.join(nodes.select(F.col("id").alias("node"), "title"), "node", "left")


def first_k(rows: DataFrame, key: list[str], value: list[str], most: int, name: str) -> DataFrame:
    """key, n (rows), name (the first values in order, at most so many): no key's rows are collected in one place."""
    counts = rows.groupBy(*key).agg(F.count("*").alias("n"))
    first = rows.withColumn("_k", F.row_number().over(W.partitionBy(*key).orderBy(*value))).filter(F.col("_k") <= most)
    item = F.struct(*value) if len(value) > 1 else F.col(value[0])
    return counts.join(first.groupBy(*key).agg(F.sort_array(F.collect_list(item)).alias(name)), key)


def facts(edges: DataFrame, node: str) -> DataFrame:
    out = edges.filter(F.col("subject") == node).withColumn("direction", F.lit("out"))
    return out.unionByName(edges.filter(F.col("object") == node).withColumn("direction", F.lit("in")))


def select_edges(edges: DataFrame, subject: str | None = None, predicate: str | None = None, status: str | None = None, n: int = 100) -> DataFrame:
    e = edges
    for c, v in (("subject", subject), ("predicate", predicate), ("status", status)):
        if v is not None:
            e = e.filter(F.col(c) == v)
    return e.orderBy("subject", "predicate", "object", "id").limit(max(1, min(1000, n)))


def shortest_path(edges: DataFrame, nodes: DataFrame, start: str, goal: str, depth: int = 6) -> DataFrame:
    """hop, node, predicate, edge_id of the first shortest directed path, or no row.

    Among equally short ones that which expands nodes in visiting order and edges in order of (predicate, object, id): a
    node's place in that order is the list of these parts along its path, so a level needs no global numbering. Every hop
    is one join and one grouped minimum, combined map-side; the path is read back over the same tables.
    """
    spark = edges.sparkSession
    schema = "hop int, node string, predicate string, edge_id string"
    ends = {r.id for r in nodes.filter(F.col("id").isin(start, goal)).select("id").distinct().collect()}
    if not {start, goal} <= ends:
        return spark.createDataFrame([], schema)
    level = spark.createDataFrame([(start, None, None, None, [])], "node string, parent string, predicate string, edge_id string, place array<string>")
    seen, levels = level.select("node"), [level]
    e = edges.select("subject", "predicate", "object", F.col("id").alias("edge_id"))
    found = start == goal
    for _ in range(max(0, min(12, depth))):
        if found:
            break
        step = e.join(level.select(F.col("node").alias("subject"), F.col("place").alias("_p")), "subject")
        step = step.select(F.col("object").alias("node"), F.concat("_p", F.array("predicate", "object", "edge_id")).alias("place"), F.struct(F.col("subject").alias("parent"), "predicate", "edge_id").alias("v"))
        first = step.groupBy("node").agg(F.min_by("v", "place").alias("v"), F.min("place").alias("place")).join(seen, "node", "left_anti")
        level = first.select("node", "v.parent", "v.predicate", "v.edge_id", "place").persist()
        levels.append(level)
        seen = seen.unionByName(level.select("node"))
        found = bool(level.filter(F.col("node") == goal).limit(1).count())
        if not found and not level.limit(1).count():
            break
    if not found:
        return spark.createDataFrame([], schema)
    path, at = [], goal
    for hop in range(len(levels) - 1, -1, -1):
        r = levels[hop].filter(F.col("node") == at).first()
        path.append((hop, r.node, r.predicate, r.edge_id))
        at = r.parent
    return spark.createDataFrame(path[::-1], schema)


def predicate_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("predicate").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "predicate")


def lint_edges(edges: DataFrame, nodes: DataFrame, predicates: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Findings (category, subject, predicate, object) of typed edges against the ontology's predicates.

    predicates: rows (predicate, subject_types, object_types, requires_evidence; null: required); sources: rows (slug) of
    source pages. Edges that pages imply are left out. An unknown predicate is the only finding of its edge. Where the columns contradicts and supersedes are
    given, they must name a node or a source page.
    """
    typed = edges.filter(~F.coalesce(F.col("predicate").isin(*IMPLICIT), F.lit(False))) if "extraction_method" in edges.columns else edges
    kinds = nodes.select(F.col("id"), F.col("node_type"))
    j = typed.join(F.broadcast(predicates.withColumn("_known", F.lit(True))), "predicate", "left")  # the ontology is a configuration
    j = j.join(kinds.select(F.col("id").alias("subject"), F.col("node_type").alias("_s")), "subject", "left")
    j = j.join(kinds.select(F.col("id").alias("object"), F.col("node_type").alias("_o"), F.lit(True).alias("_there")), "object", "left")
    if sources is not None:
        j = j.join(sources.select(F.col("slug").alias("source"), F.lit(True).alias("_source")).distinct(), "source", "left")
    else:
        j = j.withColumn("_source", F.lit(True))
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    known = F.col("_known").isNotNull()
    needs = known & F.coalesce(F.col("requires_evidence"), F.lit(True))
    refs = kinds.select(F.col("id").alias("_ref")) if sources is None else kinds.select(F.col("id").alias("_ref")).unionByName(sources.select(F.col("slug").alias("_ref")))
    refs = refs.distinct()
    for c in ("contradicts", "supersedes"):
        if c in edges.columns:
            j = j.join(refs.select(F.col("_ref").alias(c), F.lit(True).alias(f"_{c}")), c, "left")
    checks = {
        "unknown_predicates": ~known,
        "broken_object_refs": known & filled("object") & F.col("_there").isNull() & ~F.coalesce(F.array_contains("object_types", "*"), F.lit(False)),
        "subject_type_mismatch": known & ~X.types_match("subject_types", "_s"),
        "object_type_mismatch": known & F.col("_there").isNotNull() & ~X.types_match("object_types", "_o"),
        "missing_evidence": needs & ~filled("evidence"),
        "missing_source_field": needs & ~filled("source"),
        "broken_source_refs": known & filled("source") & F.col("_source").isNull(),
        "invalid_confidence": known & filled("confidence") & ~F.col("confidence").isin(*CONFIDENCE),
        "invalid_status": known & filled("status") & ~F.col("status").isin(*STATUS),
    } | {f"broken_{c}": known & filled(c) & F.col(f"_{c}").isNull() for c in ("contradicts", "supersedes") if c in edges.columns}
    hits = F.array_compact(F.array(*[F.when(c, name) for name, c in checks.items()]))
    return j.select(F.explode(hits).alias("category"), "subject", "predicate", "object")


def with_id(typed: DataFrame) -> DataFrame:
    return typed.withColumn("id", F.coalesce("node_id", F.concat_ws(":", "node_type", "slug")))


def duplicate_ids(typed: DataFrame, most: int = 50) -> DataFrame:
    """id, n, paths (the first ones) of ids that several pages claim."""
    return first_k(with_id(typed).select("id", "rel_path").distinct(), ["id"], ["rel_path"], most, "paths").filter("n > 1")


def duplicate_canonical(nodes: DataFrame, most: int = 50) -> DataFrame:
    """The same of canonical rows of a node table. build_nodes keeps one page an id, so tables it made have none."""
    return first_k(nodes.filter("canonical").select("id", "rel_path").distinct(), ["id"], ["rel_path"], most, "paths").filter("n > 1")


def alias_collisions(aliases: DataFrame, most: int = 50) -> DataFrame:
    """alias, n, owners (the first ones) of aliases that several nodes have."""
    return first_k(aliases.select("alias", "node_id").distinct(), ["alias"], ["node_id"], most, "owners").filter("n > 1")


_WORD, _WORDS = T.StringType(), T.ArrayType(T.StringType())
_REL = T.StructType([T.StructField(n, _WORD) for n in ("predicate", "object", "source", "evidence", "confidence", "status", "contradicts", "supersedes", "extras")])
_META = T.StructType(
    [T.StructField(n, _WORD) for n in ("type", "kind", "title", "raw", "created", "updated")] + [T.StructField(n, _WORDS) for n in ("tags", "sources")]
    + [T.StructField("has_graph", T.BooleanType()), T.StructField("node_id", _WORD), T.StructField("explicit_type", _WORD), T.StructField("canonical", T.BooleanType()), T.StructField("aliases", _WORDS)]
    + [T.StructField("relationships", T.ArrayType(_REL))]
)


def _meta_of(text: str | None) -> dict:
    """The parts of a page's YAML frontmatter that the graph reads, in the types of _META."""
    meta = json.loads(parse.yaml_json(text))
    graph = meta.get("graph") if isinstance(meta.get("graph"), dict) else {}
    show = lambda v: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, sort_keys=True)
    word = lambda v: show(v) if v else None
    words = lambda v: [show(x) for x in v] if isinstance(v, list) else []
    out = {k: word(meta.get(k)) for k in ("type", "kind", "title", "raw", "created", "updated")} | {k: words(meta.get(k)) for k in ("tags", "sources")}
    rels = [r for r in graph["relationships"] if isinstance(r, dict)] if isinstance(graph.get("relationships"), list) else []
    extra = lambda r: json.dumps({k: r[k] for k in EXTRAS if r.get(k) is not None}, ensure_ascii=False, sort_keys=True)
    own = [{k: word(r.get(k)) for k in ("predicate", "object", "source", "evidence", "confidence", "status", "contradicts", "supersedes")} | {"extras": extra(r)} for r in rels]
    return out | {"has_graph": bool(graph), "node_id": word(graph.get("node_id")), "explicit_type": word(graph.get("node_type")), "canonical": bool(graph.get("canonical")), "aliases": words(graph.get("aliases")), "relationships": own}


@F.pandas_udf(_META)
def _meta_udf(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_meta_of(x) for x in s], columns=_META.names)


def pages_of(files: DataFrame) -> DataFrame:
    """Graph pages from rows (rel_path, content): what nodes and edges are built of, with the links of the body."""
    body = parse.frontmatter("content")["body"]
    p = files.select("rel_path", X.slug_of("rel_path").alias("slug"), _meta_udf("content").alias("m"), X.wikilinks(body).alias("links"))
    return p.select("rel_path", "slug", "links", "m.*").withColumn("title", F.coalesce("title", "slug"))


def from_files(files: DataFrame, ontology: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(typed pages, nodes, edges, aliases) of Markdown pages (rel_path, content).

    The typed pages are persisted, since all the others read them: each page is parsed once. They have no bodies.
    """
    typed = node_types(pages_of(files), ontology).persist(StorageLevel.MEMORY_AND_DISK)
    nodes, slugs, aliases = build_nodes(typed)
    return typed, nodes, build_edges(typed, slugs, L.resolve(L.link_rows(typed), typed)), aliases


def relationship_rows(typed: DataFrame) -> DataFrame:
    """What pages state: page, index, subject and the fields of each relationship, those without object or predicate too."""
    r = with_id(typed).select(F.col("rel_path").alias("page"), F.col("id").alias("subject"), F.posexplode("relationships").alias("index", "r"))
    return r.select("page", "index", "subject", "r.*")


def report(typed: DataFrame, nodes: DataFrame, edges: DataFrame, aliases: DataFrame, predicates: DataFrame) -> DataFrame:
    """All 15 kinds of findings as rows (category, subject, predicate, object)."""
    sources = typed.filter("type = 'source'").select("slug").distinct()
    stated = lint_edges(relationship_rows(typed), nodes, predicates, sources)
    row = lambda df, category, subject, object_: df.select(F.lit(category).alias("category"), F.col(subject).alias("subject"), F.lit(None).cast("string").alias("predicate"), object_.alias("object"))
    graphed = nodes.filter("has_graph")
    return (
        stated.unionByName(row(duplicate_ids(typed), "duplicate_node_ids", "id", F.array_join("paths", ",")))
        .unionByName(row(duplicate_canonical(nodes), "duplicate_canonical", "id", F.array_join("paths", ",")))
        .unionByName(row(alias_collisions(aliases), "alias_collisions", "alias", F.array_join("owners", ",")))
        .unionByName(row(orphan_nodes(graphed, edges), "orphan_typed_nodes", "id", F.col("rel_path")))
    )


def summary(findings: DataFrame, typed: DataFrame, nodes: DataFrame) -> DataFrame:
    """name, n: pages_scanned, nodes, and every category with zeros."""
    names = findings.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, FINDINGS))).alias("name"))
    n = names.join(findings.groupBy(F.col("category").alias("name")).agg(F.count("*").alias("n")), "name", "left").fillna(0, ["n"])
    count = lambda df, name: df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
    return n.unionByName(count(typed, "pages_scanned")).unionByName(count(nodes, "nodes"))


def update(nodes: DataFrame, edges: DataFrame, typed: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, paths that need a rebuild) after some pages changed.

    typed: all pages as they are now; changed: rows (rel_path). A page whose node keeps its id and slug, and whose slug no
    other page has, gets its own node and edges replaced; others (new, removed, renamed) leave everything to a rebuild.
    """
    now = with_id(typed).join(changed.select("rel_path").distinct(), "rel_path", "left_semi")
    alone = typed.groupBy("slug").agg(F.count("*").alias("_n")).filter("_n = 1").select("slug")
    same = now.join(nodes.select("rel_path", "id", "slug"), ["rel_path", "id", "slug"], "left_semi").join(alone, "slug", "left_semi")
    dirty = changed.select("rel_path").distinct().join(same.select("rel_path"), "rel_path", "left_anti")
    own = nodes.join(same.select("rel_path"), "rel_path", "left_anti").unionByName(same.select(*nodes.columns))
    slugs = own.groupBy("slug").agg(F.max_by("id", "rel_path").alias("id"))
    new = build_edges(same.drop("id"), slugs, L.resolve(L.link_rows(same), typed))
    kept = edges.join(same.select(F.col("rel_path").alias("page")), "page", "left_anti").select(*EDGE)
    return own, kept.unionByName(new.join(kept.select("id"), "id", "left_anti").select(*EDGE)), dirty


def fits(rows: DataFrame, size: int = 1_500_000) -> DataFrame:
    """rows whose texts together stay within a size in bytes."""
    total = F.lit(0)
    for f in rows.schema:
        if f.dataType.simpleString() == "string":
            total = total + F.coalesce(F.octet_length(f.name), F.lit(0))
    return rows.filter(total <= size)


def orphan_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, but for sources, that no typed edge touches."""
    t = edges.filter(~F.col("predicate").isin(*IMPLICIT))
    touched = t.select(F.col("subject").alias("id")).unionByName(t.select(F.col("object").alias("id")))
    return nodes.filter("node_type <> 'source'").join(touched, "id", "left_anti")


def canonical(rows: DataFrame) -> DataFrame:
    """rows with keys in order at every level, nested ones too: what to_json writes is canonical then."""
    return rows.select(*[_ordered(F.col(c), rows.schema[c].dataType).alias(c) for c in sorted(rows.columns)])


def _ordered(c: Column, t: T.DataType) -> Column:
    if isinstance(t, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_ordered(c[f.name], f.dataType).alias(f.name) for f in sorted(t, key=lambda f: f.name)]))
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: _ordered(x, t.elementType))
    if isinstance(t, T.MapType):
        return F.map_from_entries(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.struct(e["key"], _ordered(e["value"], t.valueType))))
    return c


def json_lines(rows: DataFrame) -> DataFrame:
    """id, value: rows as canonical JSON, nulls included."""
    return canonical(rows).select("id", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def to_jsonl(rows: DataFrame, path: str) -> None:
    """Rows as canonical JSON lines, sorted by id."""
    json_lines(rows).orderBy("id").select("value").write.mode("overwrite").text(path)


# The keys of the GraphML form.
NODE_KEYS = ("title", "node_type", "page_type", "path")
EDGE_KEYS = ("predicate", "confidence", "status", "source")


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Pieces (ord, value) of a GraphML document, two spaces a level; sort by ord, join by line breaks. Missing columns are empty."""
    spark = nodes.sparkSession

    def data(df: DataFrame, names: tuple[str, ...]) -> list[Column]:
        text = lambda n: F.coalesce(F.col(n).cast("string"), F.lit("")) if n in df.columns else F.lit("")
        line = lambda n: F.when(text(n) == "", F.lit(f'      <data key="d_{n}" />')).otherwise(F.concat(F.lit(f'      <data key="d_{n}">'), X.escape_xml(text(n), quotes=False), F.lit("</data>")))
        return [line(n) for n in names]

    attribute = lambda name, c: F.concat(F.lit(f' {name}="'), X.escape_xml(c, breaks=True), F.lit('"'))
    keys = "\n".join(f'  <key id="d_{c}" for="{k}" attr.name="{c}" attr.type="string" />' for k, cs in (("node", NODE_KEYS), ("edge", EDGE_KEYS)) for c in cs)
    one = lambda ord_, value: spark.range(1).select(F.lit(ord_).alias("ord"), F.lit(value).alias("value"))
    head = one("0", f"<?xml version='1.0' encoding='utf-8'?>\n<graphml xmlns=\"http://graphml.graphdrawing.org/xmlns\">\n{keys}\n  <graph id=\"wiki\" edgedefault=\"directed\">")
    n = nodes.select(F.concat(F.lit("1"), "id").alias("ord"), F.concat_ws("\n", F.concat(F.lit("    <node"), attribute("id", "id"), F.lit(">")), *data(nodes, NODE_KEYS), F.lit("    </node>")).alias("value"))
    begin = F.concat(F.lit("    <edge"), attribute("id", "id"), attribute("source", "subject"), attribute("target", "object"), F.lit(">"))
    e = edges.select(F.concat(F.lit("2"), "id").alias("ord"), F.concat_ws("\n", begin, *data(edges, EDGE_KEYS), F.lit("    </edge>")).alias("value"))
    return head.unionByName(n).unionByName(e).unionByName(one("3", "  </graph>\n</graphml>"))
