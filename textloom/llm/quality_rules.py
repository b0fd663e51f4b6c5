"""Quality rules: a threshold table compiled into one Spark projection, without user functions or shuffles.

Words are runs of characters other than space and 0x09-0x0D. Every figure is computed on the whole text of a row by
built-in expressions, so the plan is one scan and one projection whatever the size of the corpus.

Defined results: a null or empty text has no words, all counts are 0, it fails the base rules and isn't kept. Repeated
rows and null ids are judged one by one; there are no ties. Very long texts are counted whole, in memory in proportion to
their words; windows are compared by 64 bits of hash. An empty table gives an empty result. Extra columns are ignored by
judge() and kept by clean(), whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Common function words of English, German, French and Spanish, in lower case as in running text.
STOP_WORDS = (
    "the be to of and that have with is in for on as at by an was it this are or from not "
    "der die das und in ist ein eine zu mit von auf den im nicht sich es auch an "
    "le la les de des et un une du en que qui pour par dans sur au ou est avec "
    "el los las del y una por con para es se lo su no al como más"
).split()

_SPACE = r"[\x20\x09-\x0D]"


@dataclass(frozen=True)
class Rule:
    """Keeps a row if low * per <= 100 * value <= high * per; None is no bound. Both sides are whole numbers."""

    name: str
    value: str
    per: str
    low: int | None
    high: int | None


#: Percentages. The first two are the base rules.
RULES = (
    Rule("enough_words", "n_words", "one", 5000, None),
    Rule("repeated_windows", "n_repeat_words", "n_words", None, 50),
    Rule("mean_word_length", "word_chars", "n_words", 200, 1400),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 20),
    Rule("exclamations_per_word", "n_exclamations", "n_words", None, 30),
    Rule("stop_words", "n_stop_words", "n_words", 2, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 50),
)
BASE = ("enough_words", "repeated_windows")


def statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), stop_words: tuple[str, ...] = tuple(STOP_WORDS)) -> DataFrame:
    """keep, and the counts that the rules read, all long."""
    d = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    d = d.select(*keep, "_t", F.split("_t", _SPACE, -1).alias("_pieces"))
    d = d.select(
        *keep,
        F.array_remove("_pieces", "").alias("_words"),
        (F.length("_t") - F.size("_pieces") + 1).cast("long").alias("word_chars"),
        (F.size(F.split("_t", r"[#*$%&|<>]", -1)) - 1).cast("long").alias("n_symbols"),
        (F.octet_length("_t") - F.octet_length(F.replace(F.col("_t"), F.lit("!"), F.lit("")))).cast("long").alias("n_exclamations"),
        F.filter(F.split("_t", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    n = F.size("_words").cast("long")
    # A 3-word window is 64 bits of hash and its position, so that equal windows are neighbours after sorting.
    window = lambda i: F.struct(F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("i"))
    d = d.select(
        *keep, "word_chars", "n_symbols", "n_exclamations", "_words", n.alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_words", lambda w: w.isin(*stop_words))).cast("long").alias("n_stop_words"),
        F.when(n >= 4, F.sort_array(F.transform(F.sequence(F.lit(0), F.size("_words") - 3), window))).otherwise(F.array().cast("array<struct<h: bigint, i: int>>")).alias("_keys"),
    )
    near = lambda k, i: F.coalesce(F.get("_keys", i)["h"] == k["h"], F.lit(False))
    d = d.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_exclamations", "n_lines", "n_dup_lines", "n_stop_words",
        F.filter("_keys", lambda k, i: near(k, i - 1) | near(k, i + 1))["i"].alias("_repeated"),
    )
    d = d.withColumn("_at", F.sort_array("_repeated"))
    gaps = F.aggregate(
        F.zip_with(F.slice("_at", 2, F.greatest(F.size("_at") - 1, F.lit(0))), F.slice("_at", 1, F.greatest(F.size("_at") - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(3)).cast("long")),
        F.lit(3).cast("long"), lambda s, x: s + x,
    )
    return d.withColumn("n_repeat_words", F.when(F.size("_at") > 0, gaps).otherwise(F.lit(0).cast("long"))).drop("_at", "_repeated")


def verdict(rules: tuple[Rule, ...] = RULES):
    """The table of rules as one boolean column over statistics()."""
    kept = F.lit(True)
    for r in rules:
        per = F.lit(1) if r.per == "one" else F.col(r.per)
        if r.low is not None:
            kept &= F.col(r.value) * 100 >= per * r.low
        if r.high is not None:
            kept &= F.col(r.value) * 100 <= per * r.high
    return kept


def judge(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """keep, n_words and the counts, base_failed, kept."""
    s = statistics(docs, text, keep)
    base = tuple(r for r in rules if r.name in BASE)
    return s.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~verdict(base)).alias("base_failed"), verdict(rules).alias("kept"), "n_lines", "n_stop_words", "n_exclamations")


def clean(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs that are kept, in the given columns.

    The verdict passes through a one-row generator: a filter right on it would be pushed down through the projections,
    and their expressions copied into each other until planning takes minutes.
    """
    own = [F.col(c).alias(f"_{i}") for i, c in enumerate(docs.columns)]
    judged = statistics(docs.select(*own, F.col(text).alias("_text")), "_text", tuple(f"_{i}" for i in range(len(own))))
    kept = judged.select(*[f"_{i}" for i in range(len(own))], F.explode(F.array(verdict(rules))).alias("_kept")).filter("_kept")
    return kept.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])
