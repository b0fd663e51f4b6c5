"""URL filters by a cascade of Bloom filters: exact membership in a list of rules without a join.

A rule is a host and a path; it fits the host and its subdomains where the URL's path begins with the rule's. A URL's
candidate keys are its host's suffixes at dots, each with the path's beginnings of the lengths that rules have. Level 0
encodes the listed keys; level 1 the keys of the corpus that level 0 takes for listed, level 2 the listed keys that level
1 takes for those, and so on until no false positive is left. A key is listed if the first level that lacks it is odd.
As every candidate key of the corpus was tested while building, answers on that corpus are exact. The longest listed
candidate is the rule (a longer host before a longer path); if one key is both allowed and blocked, it is blocked.

Level 0's error rate follows from the numbers of listed keys and of keys (about listed / keys), so that all levels
together take a few bytes per listed key however large the corpus is; the size is checked before they go into the plan.
Only filter words come to the driver, never keys. Everything is built-in expressions.

Defined results: a null URL, or one without ://, has an empty host and path, no rule, and the default verdict. Repeated
rows and null ids are judged one by one. Of fitting rules of equal length that with the longer host wins. Very long URLs
are judged whole; a URL has as many candidate keys as its host has labels times the number of path lengths of rules. Empty
tables and empty rule lists give empty results and the default verdict. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm._shared import cut

#: Bytes of a level at most: about five million listed keys. A level goes into the plan as one literal.
MAX_BYTES = 16 << 20


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


# The rules of the query.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def candidates(host: str, path: str, lengths: list[int]) -> Column:
    """All keys that a rule fitting this URL could have, the longest first."""
    labels = F.split(F.col(host), r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    heads = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(lengths, reverse=True)]), lambda p: p.isNotNull())
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(heads, lambda p: F.struct((-F.length(s) - F.length(p)).alias("a"), (-F.length(s)).alias("b"), F.concat(s, p).alias("k")))))
    return F.transform(F.array_sort(keys), lambda x: x["k"])


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    seed: int
    words: bytes

    @cached_property
    def literal(self) -> Column:
        return F.lit(bytearray(self.words))

    def has(self, key: Column) -> Column:
        """Whether all of the key's bits are set."""
        filter_ = self.literal
        found = F.lit(True)
        for p in positions(key, self.bits, self.hashes, self.seed):
            byte = F.conv(F.hex(F.substr(filter_, (F.call_function("div", p, F.lit(8)) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            found &= F.call_function("shiftright", byte, (p % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
        return found


def positions(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed + j)), F.lit(bits).cast("long")) for j in range(hashes)]


def encode(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """One level over a column `key` of n keys. Only the filter's non-zero bytes, at most its size, come here."""
    hashes = max(1, round(math.log2(1 / rate)))
    bits = max(64, math.ceil(n * hashes / math.log(2)))
    if bits > 8 * MAX_BYTES:
        raise ValueError(f"a level of {bits // 8} bytes is over the bound of {MAX_BYTES}")
    at = keys.select(F.explode(F.array(*positions(F.col("key"), bits, hashes, seed))).alias("p"))
    byte = at.groupBy(F.call_function("div", F.col("p"), F.lit(8)).alias("b")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("p") % 8).cast("int"))).alias("v"))
    words = bytearray(bits // 8 + 1)
    for r in byte.toLocalIterator():
        words[r.b] = r.v
    return Level(bits, hashes, seed, bytes(words))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def lists(self, key: Column) -> Column:
        """Exact for every key of the universe it was built over."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(~self.levels[i].has(key), F.lit(i % 2 == 1)).otherwise(out)
        return out


def build(listed: DataFrame, universe: DataFrame) -> Cascade:
    """listed, universe: distinct keys in a column `key`."""
    r, n = listed.count(), universe.count()
    if not r:
        return Cascade(())
    levels = [encode(listed, r, min(0.5, math.sqrt(0.5) * r / max(n, 1)), 1000)]
    # what level 0 wrongly takes for listed: about 0.7 keys per listed key
    wrong = cut(universe.filter(levels[0].has(F.col("key"))).join(listed, "key", "left_anti"))
    sides = [listed, wrong]
    while True:
        m = sides[1].count()
        if not m:
            return Cascade(tuple(levels))
        level = encode(sides[1], m, 0.5, 1000 * (len(levels) + 1))
        levels.append(level)
        sides = [sides[1], cut(sides[0].filter(level.has(F.col("key"))))]


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row."""
    spark = pages.sparkSession
    lengths = sorted({len(r.path) for r in rules})
    host, path = host_and_path(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"))
    p = p.withColumn("_keys", candidates("host", "path", lengths) if rules else F.array().cast("array<string>"))
    universe = cut(p.select(F.explode("_keys").alias("key")).distinct())
    keys = {v: sorted({r.key for r in rules if r.verdict == v}) for v in ("block", "allow")}
    # rows made in the JVM, a thousand keys to an array
    some = lambda own: spark.range(1).select(F.explode(F.array(*map(F.lit, own)).cast("array<string>")).alias("key"))
    listed = lambda v: reduce(DataFrame.unionByName, [some(keys[v][i : i + 1000]) for i in range(0, max(len(keys[v]), 1), 1000)])
    cascades = {v: build(listed(v), universe) for v in ("block", "allow")}
    verdict = lambda k: F.when(cascades["block"].lists(k), F.lit("block")).when(cascades["allow"].lists(k), F.lit("allow"))
    hit = F.get(F.filter(F.transform("_keys", lambda k: F.struct(k.alias("k"), verdict(k).alias("v"))), lambda x: x["v"].isNotNull()), F.lit(0))
    p = p.select("page_id", "host", "path", hit.alias("_hit"))
    return p.select("page_id", "host", "path", F.col("_hit")["k"].alias("rule"), F.coalesce(F.col("_hit")["v"], F.lit(default)).alias("verdict"))
