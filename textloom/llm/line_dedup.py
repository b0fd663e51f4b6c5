r"""Line dedup by a log-template tree of fixed depth, in built-in expressions only.

A line's tokens are what white space separates; a token with a digit or an @ (numbers, dates, ids, addresses) is
masked as <*>. The tree's levels are the token count and the first `LEADING` tokens; such a node's lines are then
generalised by the tokens that recur in it. A token is fixed at its place in a node if `documents` different documents
have it there; all others are variable fields, however many a line has and wherever they stand behind the leading tokens
(names, cities, titles; a field among the leading tokens parts the nodes, as in any tree of this kind).
A line's template is its tokens with the variable ones as <*>. Since a field may have few values, each in many
documents, a second template takes a token as fixed only if a `share` of the node's documents has it, too: the first
keeps templates apart that share a node, the second joins values. A template needs `words` fixed words (tokens of more than one
character: table marks and dashes aren't), and at least half of the line's words; apart from both, a line is filed under all of its tokens.

A template recurs if enough different documents hold it: five, or two where it is the whole line and that has 20 tokens or
more. Exact copies of a text count as one document and get the same decisions, so that the n-gram join still
finds them equal; lines repeated within one document alone never recur. Lines of a recurring template are dropped from
all documents but the first that holds it (the smallest doc_id), which stays as it is for that template; a line under
several recurring templates is dropped if one of them began in another document. Lines under three tokens never recur.

A document's distinct nodes are found within its row, so counting them is one grouped count with map-side combining. Texts are
read once and kept as hashes. Only lines of nodes with enough documents are looked at by token: a filter of those nodes by hash, a row of at most
4 MB that tasks get as a scalar subquery, picks them, and only fixed tokens go on. All joins broadcast only the heaviest keys and salt
their rows (_shared.skew_join); the last join moves each text once. No step gathers the lines of a node.

Defined results: a null text stays null, with no lines; an empty text has one empty line, which stays. Repeated rows
count once and get equal decisions; rows with a null doc_id count for nothing and keep their text. Two documents with
one doc_id are told apart by their text, texts and nodes by 62 to 64 bits of hash, tokens at one place of a node by 31. Ties don't arise: the first document
of a template is the smallest (doc_id, text hash). Very long texts are one row of hashes: 20 bytes a line and 4 a token. An empty table
gives an empty result. Extra columns are kept by clean() and shorten() and ignored by decisions() and templates().
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm._shared import cut, own_key, skew_join

LEADING = 2
#: Nodes are marked by MARKS bits each, of which there are at most so many (4 MB); with more nodes, more lines of others are looked at.
MARKS, MOST_PLACES = 16, 1 << 25
#: Kinds of keys, in their lowest bits: whole lines, whole lines that two documents are enough for, nodes.
_LINE, _LONG, _NODE = 0, 1, 2


@dataclass(frozen=True)
class Limits:
    min_tokens: int = 3
    long_tokens: int = 20
    documents: int = 5
    long_documents: int = 2
    share: float = 0.2
    words: int = 3


LIMITS = Limits()


def _masked(text: Column) -> Column:
    """The text's lines as arrays of masked tokens."""
    # both patterns begin only where they match: plain single spaces and words without a digit cost one look
    # and most texts have none of what the first one looks for, which is told without a regular expression
    wide = functools.reduce(operator.or_, [F.contains(text, F.lit(c)) for c in ("  ", "\t", "\x0b", "\f", "\r")])
    t = F.when(wide, F.regexp_replace(text, r"(?:[\t\x0B\f\r]| (?=[ \t\x0B\f\r]))[ \t\x0B\f\r]*+", " ")).otherwise(text)
    t = F.when(text.rlike("[0-9@]"), F.regexp_replace(t, r"(?<![^ \n])[^ \n0-9@]*+[0-9@][^ \n]*+", "<*>")).otherwise(t)
    return F.transform(F.split(t, "\n", -1), lambda x: F.split(F.trim(x), " ", -1))


def _key(kind: Column | int, *cols: Column) -> Column:
    return F.call_function("shiftleft", F.call_function("shiftright", F.xxhash64(*cols), F.lit(2)), F.lit(2)) + kind


def _node(w: Column) -> Column:
    return _key(_NODE, F.lit(_NODE), F.size(w), F.slice(w, F.lit(1), F.lit(LEADING)))


def _line(w: Column, limits: Limits) -> Column:
    return _key(F.when(F.size(w) >= limits.long_tokens, _LONG).otherwise(_LINE), F.lit(_LINE), F.size(w), w)


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")


def _filed(docs: DataFrame, limits: Limits, shown: bool = False) -> DataFrame:
    """uid, doc_id, h (the text's hash), l: the lines that can recur, with their number i, keys k and node, and their tokens t (and w, if shown)."""

    def line(w: Column, i: Column) -> Column:
        # a token is 31 bits of hash; the lowest bit says that it counts as a word
        token = F.transform(w, lambda x: F.hash(x).bitwiseAND(F.lit(-2)) + F.when(F.length(x) > 1, 1).otherwise(0))
        return F.struct(i.alias("i"), _line(w, limits).alias("k"), _node(w).alias("node"), token.alias("t"), *([w.alias("w")] if shown else []))

    filed = F.transform(_masked(F.col("text")), lambda w, i: F.when(F.size(w) >= limits.min_tokens, line(w, i)))
    d = _source(docs).select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.xxhash64("text").alias("h"), F.array_compact(filed).alias("l"))
    return d.filter(F.size("l") > 0)


def _texts(filed: DataFrame) -> DataFrame:
    """uid of one row of each different text, copies (its rows)."""
    texts = filed.groupBy("h").agg(F.min(F.struct("doc_id", "uid")).alias("r"), F.count("*").alias("copies"))
    return texts.select(F.col("r.uid").alias("uid"), "copies")


def recurring(filed: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """key, n (documents), most (its lines at most, copies included), first (doc_id and text hash) of lines that recur and of nodes with enough documents."""
    keys = filed.select("uid", "doc_id", "h", F.size("l").alias("lines"), F.array_union("l.k", "l.node").alias("keys"))
    each = keys.join(_texts(filed), "uid").select("doc_id", "h", (F.col("lines") * F.col("copies")).alias("c"), F.explode("keys").alias("key"))
    found = each.groupBy("key").agg(F.count("*").alias("n"), F.sum("c").alias("most"), F.min(F.struct("doc_id", "h")).alias("first"))
    return found.filter(F.col("n") >= F.when(F.col("key").bitwiseAND(F.lit(3)) == _LONG, limits.long_documents).otherwise(limits.documents))


def _total(found: DataFrame) -> int:
    return found.agg(F.coalesce(F.sum("most"), F.lit(0))).first()[0]


def _is(kind: str) -> Column:
    low = F.col("key").bitwiseAND(F.lit(3))
    return low == _NODE if kind == "node" else low != _NODE


def _kept(filed: DataFrame, keys: DataFrame, field: str, fields: list[str]) -> DataFrame:
    """filed with only the lines, and those fields of them, whose `field` is one of these keys, and few others: a bit for each of
    so many places is set where a key falls on it.

    The bits are a table of one row that tasks read as a scalar subquery: as a literal they would be written out in every text of the plan.
    """
    places = max(64, min(MARKS * keys.count(), MOST_PLACES))
    place = lambda key: F.pmod(F.call_function("shiftright", key, F.lit(2)), F.lit(places).cast("long"))
    low = lambda p: p.bitwiseAND(F.lit(63)).cast("int")
    at = keys.select(place(F.col("key")).alias("p")).select(F.shiftright("p", 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), low(F.col("p"))).alias("bit"))
    every = keys.sparkSession.range(-(-places // 64)).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("bit"))
    words = at.unionByName(every).groupBy("w").agg(F.bit_or("bit").alias("bits"))
    row = cut(words.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "bits"))), lambda x: x["bits"]).alias("marks")))
    marked = lambda x: F.getbit(F.get("_marks", F.shiftright(place(x[field]), 6).cast("int")), low(place(x[field]))) == 1
    kept = F.transform(F.filter("l", marked), lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    return filed.withColumn("_marks", row.scalar()).select("uid", "doc_id", "h", kept.alias("l")).filter(F.size("l") > 0)


def _opened(filed: DataFrame, nodes: DataFrame, limits: Limits, shown: bool = False) -> DataFrame:
    """uid, doc_id, h, i, key (and template, if shown) of the lines in these nodes (key), for both templates of each."""
    place = lambda x: F.transform(x["t"], lambda t, p: F.xxhash64(x["node"], p, t))
    fields = ["i", "node", "t", *(["w"] if shown else [])]
    mine = _kept(filed, nodes, "node", fields)
    lines = mine.select("uid", "doc_id", "h", F.explode("l").alias("x")).select("uid", "doc_id", "h", *[f"x.{f}" for f in fields])
    # documents with a token at its place: a text's copies are one, and so are its lines
    texts = mine.groupBy("h").agg(F.first("l").alias("l"), F.count("*").alias("copies"))
    keys = texts.select((F.size("l") * F.col("copies")).alias("c"), F.explode(F.array_distinct(F.flatten(F.transform("l", place)))).alias("key"))
    fixed = cut(keys.groupBy("key").agg(F.count("*").alias("n"), F.sum("c").alias("most")).filter(F.col("n") >= limits.documents))
    # a token's place and whether it is a word go as one number
    at = lambda t, p: (2 * p + t.bitwiseAND(F.lit(1))).cast("long").alias("at")
    token = F.inline(F.transform("t", lambda t, p: F.struct(at(t, p), F.xxhash64(F.col("node"), p, t).alias("key"))))
    tokens = skew_join(lines.select("uid", "i", token), fixed, "key", "most", _total(fixed), F.struct("uid", "i", "at")).filter("n is not null")
    size, words = F.size("t").alias("size"), F.size(F.filter("t", lambda t: t.bitwiseAND(F.lit(1)) == 1)).alias("words")
    own = lines.select("uid", "i", "doc_id", "h", size, words, *(["w"] if shown else []))
    # a document's lines and tokens lie side by side in one shuffle
    both = tokens.select("uid", "i", "at", "key", "n").unionByName(own, allowMissingColumns=True).repartition("uid")
    kept = F.when(F.col("at").isNotNull(), F.struct("at", "key", "n"))
    again = both.groupBy("uid", "i").agg(F.array_sort(F.collect_list(kept)).alias("f"), F.max("n").alias("docs"), *[F.max(c).alias(c) for c in own.columns if c not in ("uid", "i")])
    again = again.filter(F.size("f") > 0)

    def view(number: int, kept: Column) -> Column:
        words = F.size(F.filter(kept, lambda x: x["at"].bitwiseAND(F.lit(1)) == 1))
        shape = [F.xxhash64(F.lit(number), F.col("size"), F.transform(kept, lambda x: x["key"])).alias("key")]
        if shown:
            places = F.transform(kept, lambda x: F.shiftright(x["at"], 1).cast("int"))
            shape.append(F.array_join(F.transform("w", lambda t, p: F.when(F.array_contains(places, p), t).otherwise("<*>")), " ").alias("template"))
        return F.when((words >= limits.words) & (2 * words >= F.col("words")), F.struct(*shape))

    # all documents of a node have its leading tokens, so that the most is the number of its documents
    views = [view(1, F.col("f")), view(2, F.filter("f", lambda x: x["n"] >= limits.share * F.col("docs")))]
    return again.select("uid", "doc_id", "h", "i", F.inline(F.array_compact(F.array(*views))))


def _generalised(opened: DataFrame, limits: Limits) -> DataFrame:
    """key, n, most, first of the templates that recur."""
    each = opened.groupBy("key", "h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("c"))
    found = each.groupBy("key").agg(F.count("*").alias("n"), F.sum("c").alias("most"), F.min(F.struct("doc_id", "h")).alias("first"))
    return found.filter(F.col("n") >= limits.documents)


def decisions(docs: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """doc_id, h (the text's hash), dropped: the numbers (from 0) of the lines to drop, of documents that have any."""
    filed = cut(_filed(docs, limits))  # hashes and numbers only, for several uses
    found = cut(recurring(filed, limits).select("key", "most", F.col("first.h").alias("first")))
    whole = found.filter(_is("line"))
    lines = _kept(filed, whole, "k", ["i", "k"]).select("uid", "doc_id", "h", F.explode("l").alias("x")).select("uid", "doc_id", "h", "x.i", F.col("x.k").alias("key"))
    hits = skew_join(lines, whole, "key", "most", _total(whole), F.struct("uid", "i"))
    opened = cut(_opened(filed, found.filter(_is("node")).select("key"), limits))
    general = cut(_generalised(opened, limits).select("key", "most", F.col("first.h").alias("first")))
    more = skew_join(opened, general, "key", "most", _total(general), F.struct("uid", "i", "key"))
    hit = hits.select("doc_id", "h", "i", "first").unionByName(more.select("doc_id", "h", "i", "first")).filter("first is not null and first <> h")
    return hit.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("i")).alias("dropped"))


def templates(docs: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """template (variable fields as <*>), tokens, documents, first_doc of what recurs; templates that read alike are one."""
    filed = cut(_filed(docs, limits, shown=True))
    found = cut(recurring(filed, limits))
    whole = found.filter(_is("line"))
    own = filed.select(F.explode("l").alias("x")).select(F.col("x.k").alias("key"), F.array_join("x.w", " ").alias("template"))
    lines = skew_join(own, whole, "key", "most", _total(whole), F.col("template")).select("template", "n", "first")
    opened = cut(_opened(filed, found.filter(_is("node")).select("key"), limits, shown=True))
    general = cut(_generalised(opened, limits))
    more = skew_join(opened, general, "key", "most", _total(general), F.struct("uid", "i", "key")).select("template", "n", "first")
    shown = lines.unionByName(more).filter("n is not null").groupBy("template").agg(F.max("n").alias("documents"), F.min("first.doc_id").alias("first_doc"))
    return shown.select("template", F.size(F.split("template", " ", -1)).cast("int").alias("tokens"), "documents", "first_doc")


def _joined(docs: DataFrame, limits: Limits) -> tuple[DataFrame, Column, Column]:
    """docs with the decisions beside them, the shortened text and the dropped lines' numbers, under names of our own."""
    d = decisions(docs, limits).select(F.col("doc_id").alias("__line_dedup_id"), F.col("h").alias("__line_dedup_text"), F.col("dropped").alias("__line_dedup_dropped"))
    dropped = F.col("__line_dedup_dropped")
    text = F.when(dropped.isNull(), F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(dropped, i)), "\n"))
    keyed = own_key(docs, "__line_dedup_key")
    same = (keyed["__line_dedup_key"] == d["__line_dedup_id"]) & (F.xxhash64(keyed["text"]) == d["__line_dedup_text"]) & keyed["doc_id"].isNotNull()
    return keyed.join(d, same, "left"), text, dropped


def shorten(docs: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """docs with text shortened, in the given columns."""
    joined, text, _ = _joined(docs, limits)
    return joined.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns])


def clean(docs: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """docs with text shortened, and the columns n_lines and n_dropped, in place of any so named."""
    joined, text, dropped = _joined(docs, limits)
    return joined.select(
        *[text.alias(c) if c == "text" else F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped")],
        F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size(dropped), F.lit(0)).cast("long").alias("n_dropped"),
    )
