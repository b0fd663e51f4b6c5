"""Evidence lint: what a graph's edges claim, against the pages they cite.

An edge's quote is looked for in its source page first, case and white space aside. Where it isn't there, the page's sentences are
scored against the claim by the share of the claim's distinct tokens that a sentence has; the best one decides. A sentence
can only reach the threshold if it has one of the claim's rarest tokens: with n tokens of which m must be shared, any n - m + 1 of them
have one. So claims and sentences are joined on the hashes of those few (the rarest in the page), and only pairs that meet are scored.

Sentences are split once. Of their tokens only the hashes of those go on that a claim on the page may have, by a mask of fixed size a page; the
texts are joined to the pairs that meet, so that no text travels once a token. Claims are told apart by 64 bits of hash.

Defined results: an edge without a page is `missing_source`; one without a claim that has tokens is `unsupported` unless it is quoted. Of equally
good sentences the first of the page counts. Edges with one edge_id are judged one by one if anything else differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.runtime import cut
from textloom.sources import parse

THRESHOLD = 0.55
#: Numbers of 64 bits in a page's mask.
MASK = 32


def check(edges: DataFrame, pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """edge_id, source, status (quoted, supported, unsupported, missing_source), probability, sentence of edges (edge_id, source, quote, claim)
    against pages (source, body)."""
    e = edges.select("edge_id", "source", "quote", "claim").distinct()
    p = pages.select("source", "body").filter("body is not null and source is not null")
    j = e.join(p, "source", "left").select("edge_id", "source", "claim", F.col("body").isNull().alias("_missing"), F.coalesce(X.contains_evidence("body", "quote"), F.lit(False)).alias("_quoted"))
    j = cut(j.withColumn("_c", F.xxhash64("source", "claim")))
    claims = j.filter("not _missing and not _quoted and claim is not null").select("_c", "source", F.array_distinct(X.tokenize("claim")).alias("_tokens")).dropDuplicates(["_c"])
    n = F.size("_tokens")
    # ceil() of a product would round a threshold's last bit up
    need = F.greatest(F.ceil(n * threshold - 1e-9).cast("int"), F.lit(1))
    claims = claims.filter(n > 0).withColumn("_need", need)
    key = lambda token: F.xxhash64("source", token)
    place = lambda k: F.pmod(k, F.lit(64 * MASK)).cast("int")
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), place(k).bitwiseAND(F.lit(63)))
    asked = claims.select("_c", "source", F.explode("_tokens").alias("token")).select("_c", "source", key("token").alias("key"))
    word = F.shiftright(place(F.col("key")), 6)
    masks = asked.groupBy("source").agg(F.array(*[F.bit_or(F.when(word == i, bit(F.col("key"))).otherwise(F.lit(0).cast("long"))) for i in range(MASK)]).alias("_mask"))
    s = p.join(masks, "source").select("source", "_mask", F.posexplode(parse.split_sentences("body", None, None)).alias("place", "sentence"))
    may = lambda k: F.get("_mask", F.shiftright(place(k), 6)).bitwiseAND(bit(k)) != 0
    keys = F.filter(F.transform(F.array_distinct(X.tokenize("sentence")), key), may)
    s = cut(s.select("source", "place", "sentence", keys.alias("keys")).filter(F.size("keys") > 0))
    times = s.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("times"))
    # tokens that no sentence of the page has come first: they can't be shared, but are among the rarest
    ranked = asked.join(times, "key", "left").groupBy("_c").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "key"))).alias("t"))
    few = F.slice(F.transform("t", lambda x: x["key"]), F.lit(1), F.size("t") - F.col("_need") + 1)
    first = ranked.join(claims.select("_c", "_need"), "_c").select("_c", F.explode(few).alias("key"))
    pairs = first.join(s.select("source", "place", F.explode("keys").alias("key")), "key").select("_c", "source", "place").distinct()
    shared = F.size(F.array_intersect("_tokens", F.array_distinct(X.tokenize("sentence"))))
    met = pairs.join(claims.select("_c", "_tokens", "_need"), "_c").join(s.select("source", "place", "sentence"), ["source", "place"])
    good = met.select("_c", "place", "sentence", shared.alias("_shared"), n.alias("_n"), "_need").filter(F.col("_shared") >= F.col("_need"))
    best = good.groupBy("_c").agg(F.max(F.struct("_shared", (-F.col("place")).alias("_place"), "sentence", "_n")).alias("b"))
    best = best.select("_c", (F.col("b._shared") / F.col("b._n")).alias("probability"), "b.sentence")
    open_ = F.when(~F.col("_missing") & ~F.col("_quoted"), F.col("_c"))
    status = F.when(F.col("_missing"), "missing_source").when(F.col("_quoted"), "quoted").when(F.col("probability").isNotNull(), "supported").otherwise("unsupported")
    found = j.withColumn("_c", open_).join(best, "_c", "left")
    return found.select("edge_id", "source", status.alias("status"), F.round("probability", 4).alias("probability"), "sentence")


def findings(checked: DataFrame) -> DataFrame:
    """rule, source, edge_id of what isn't supported."""
    rule = F.when(F.col("status") == "missing_source", "evidence_missing_source").otherwise("evidence_unsupported")
    return checked.filter("status in ('unsupported', 'missing_source')").select(rule.alias("rule"), "source", "edge_id")
