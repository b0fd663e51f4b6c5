"""White space of every kind parts the tokens of a line."""

from pyspark.sql import functions as F

from textloom.llm import line_dedup


def test_masked_lines(spark):
    texts = ["a b c", "a  b   c", "a\tb c", "a \x0b\f b\rc", " a b c ", "\ta b c\r", "a 1b c@d\na b\n\n  x  y ", "", "a\n b\n\tc"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", line_dedup._masked(F.col("text")).alias("l")).collect()
    mask = lambda w: "<*>" if any(c in "0123456789@" for c in w) else w
    want = {i: [[mask(w) for w in line.split()] or [""] for line in t.split("\n")] for i, t in enumerate(texts)}
    assert {r.i: r.l for r in got} == want


def test_plain_texts_skip_the_first_pattern(spark):
    plan = spark.createDataFrame([("a b",)], "text string").select(line_dedup._masked(F.col("text")).alias("l"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().index("contains(text") < plan.index("[ \\t")
