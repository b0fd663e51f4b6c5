"""Retrieval and decision quality, threshold fits, experiment statistics, and model decisions with an offline scorer."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import text as X

GRID = tuple(round(0.05 * i, 2) for i in range(1, 20))


def retrieval(results: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """Per query: recall_at_k, reciprocal_rank; results (query, rank, item), expected (query, item)."""
    want = expected.groupBy("query").agg(F.count("*").alias("n"))
    hit = results.join(expected, ["query", "item"]).groupBy("query").agg(F.count_if(F.col("rank") <= k).alias("found"), F.min("rank").alias("best"))
    j = want.join(hit, "query", "left")
    return j.select("query", (F.coalesce("found", F.lit(0)) / F.col("n")).alias("recall_at_k"), F.coalesce(1 / F.col("best"), F.lit(0.0)).alias("reciprocal_rank"))


def false_positives(results: DataFrame, negatives: DataFrame, k: int = 5) -> DataFrame:
    """One row: the share of negative queries (query) that return anything in the first k."""
    any_ = results.filter(F.col("rank") <= k).select("query").distinct().withColumn("_hit", F.lit(1.0))
    return negatives.join(any_, "query", "left").agg(F.avg(F.coalesce("_hit", F.lit(0.0))).alias("fp_rate"))


def counts(predicted: Column, actual: Column) -> list[Column]:
    return [F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn")]


def with_prf(c: DataFrame) -> DataFrame:
    """precision, recall and f1 beside tp, fp and fn; 0 where undefined."""
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, r = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("*", p.alias("precision"), r.alias("recall"), share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def threshold_grid(scored: DataFrame, grid: tuple[float, ...] = GRID) -> DataFrame:
    """precision, recall and f1 of (score, label) at every threshold: one global aggregation, whatever the grid."""
    actual = F.col("label") == 1
    one = scored.agg(*[F.struct(*counts(F.coalesce(F.col("score") >= t, F.lit(False)), actual)).alias(f"t{i}") for i, t in enumerate(grid)])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{i}.tp").alias("tp"), F.col(f"t{i}.fp").alias("fp"), F.col(f"t{i}.fn").alias("fn")) for i, t in enumerate(grid)])).alias("r"))
    return with_prf(rows.select("r.*"))


def best_threshold(scored: DataFrame, grid: tuple[float, ...] = GRID) -> DataFrame:
    """The grid row of the best f1; ties go to the lowest threshold."""
    return threshold_grid(scored, grid).orderBy(F.desc(F.round("f1", 9)), "threshold").limit(1)


def _running(counted: DataFrame, value: str, amount: str, ranges: int = 1024) -> DataFrame:
    """counted (distinct values, their amounts) with below: the sum of the amounts of all smaller values.

    Values are dealt out by ranges: within each a window, before each the total of those below. The ranges come from the
    values' quantiles, so they hold about as many values each.
    """
    cuts = counted.agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 10_000).alias("_q"))  # one row
    place = F.size(F.filter("_q", lambda q: q < F.col(value)))
    g = counted.crossJoin(F.broadcast(cuts)).withColumn("_range", F.coalesce(place, F.lit(0))).drop("_q")
    totals = g.groupBy("_range").agg(F.sum(amount).alias("_n"))
    before = totals.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row per range
    w = W.partitionBy("_range").orderBy(value)
    return g.join(F.broadcast(before), "_range").withColumn("below", F.col("_before") + F.sum(amount).over(w) - F.col(amount)).drop("_range", "_before")


def auroc(scored: DataFrame) -> DataFrame:
    """One row: auroc of (score, label), ties counting half. Counts by distinct score come first."""
    g = scored.filter("score is not null").groupBy("score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    t = _running(g, "score", "n").agg(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return t.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / F.col("p") / F.col("n")).alias("auroc"))


def latencies(rows: DataFrame, value: str) -> DataFrame:
    """One row: the interpolated median, the nearest-rank 90th percentile at int(0.9 (n - 1)), and the mean."""
    s = rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c"))
    n = s.agg(F.sum("_c").alias("_n"), (F.sum(F.col(value) * F.col("_c")) / F.sum("_c")).alias("mean"))  # one row
    place = _running(s, value, "_c").crossJoin(F.broadcast(n))
    at = lambda k: F.min(F.when((F.col("below") <= k) & (F.col("below") + F.col("_c") > k), F.col(value)))
    last = F.col("_n") - 1
    one = place.agg(at(F.floor(last / 2)).alias("low"), at(F.ceil(last / 2)).alias("high"), at(F.floor(0.9 * last)).alias("p90"), F.min("mean").alias("mean"))
    return one.select(((F.col("low") + F.col("high")) / 2).alias("p50"), "p90", "mean")


def alternate_split(rows: DataFrame, key: str) -> DataFrame:
    """rows with fold: tune and test in turns by key, a number. Keys are counted first, so no task sorts them all."""
    order = _running(rows.groupBy(key).agg(F.count("*").alias("_c")), key, "_c").select(key, "below")
    n = F.row_number().over(W.partitionBy(key).orderBy(F.lit(1))) + F.col("below")
    return rows.join(order, key).withColumn("fold", F.when(n % 2 == 1, "tune").otherwise("test")).drop("below")


def pass_totals(runs: DataFrame) -> DataFrame:
    """passed and runs by split and variant, variants side by side."""
    return runs.groupBy("split").pivot("variant", ["baseline", "candidate"]).agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("runs"))


def paired_regressions(runs: DataFrame) -> DataFrame:
    """task, repeat of runs that the baseline passed and the candidate of the same task and repeat didn't."""
    base = runs.filter("variant = 'baseline' and passed").select("task", "repeat")
    return base.join(runs.filter("variant = 'candidate' and passed").select("task", "repeat"), ["task", "repeat"], "left_anti")


def budgets(runs: DataFrame, limits: dict[str, float]) -> DataFrame:
    """metric, baseline, candidate, ratio_limit, passed of summed metrics; a sum with a missing value is null and passes nothing."""
    total = lambda m, v: F.when(F.count_if((F.col("variant") == v) & F.col(m).isNull()) == 0, F.coalesce(F.sum(F.when(F.col("variant") == v, F.col(m))), F.lit(0)).cast("double"))
    one = runs.agg(*[F.struct(F.lit(m).alias("metric"), total(m, "baseline").alias("baseline"), total(m, "candidate").alias("candidate"), F.lit(float(x)).alias("ratio_limit")).alias(m) for m, x in limits.items()])
    r = one.select(F.explode(F.array(*limits)).alias("r")).select("r.*")
    return r.withColumn("passed", F.coalesce(F.col("candidate") <= F.col("baseline") * F.col("ratio_limit"), F.lit(False)))


def accepted(runs: DataFrame, limits: dict[str, float], better: str = "validation", no_worse: tuple[str, ...] = ("holdout",), critical: DataFrame | None = None) -> DataFrame:
    """One row: accepted. The candidate passes more of one split, no less of others, keeps within the budgets, and no run
    (of the critical tasks, if rows (task) are given) gets worse."""
    t = pass_totals(runs)
    lost = F.col("candidate_passed") < F.col("baseline_passed")
    worse = t.agg(F.count_if((F.col("split") == better) & (F.col("candidate_passed") > F.col("baseline_passed"))).alias("up"), F.count_if(F.col("split").isin(*no_worse) & lost).alias("down"))
    if critical is None:
        regressions = paired_regressions(runs)
    else:
        per = runs.join(critical.select("task").distinct(), "task", "left_semi").groupBy("task")
        regressions = per.agg(*[F.count_if((F.col("variant") == v) & F.col("passed")).alias(v) for v in ("baseline", "candidate")]).filter("candidate < baseline")
    n = regressions.agg(F.count("*").alias("lost"))
    b = budgets(runs, limits).agg(F.count_if(~F.col("passed")).alias("over")) if limits else n.select(F.lit(0).alias("over"))
    return worse.crossJoin(n).crossJoin(b).select(((F.col("up") > 0) & (F.col("down") == 0) & (F.col("lost") == 0) & (F.col("over") == 0)).alias("accepted"))  # one row each


def task_differences(runs: DataFrame) -> DataFrame:
    """task, difference: the candidate's share of passed repeats less the baseline's. Repeats aren't tasks of their own."""
    share = lambda v: F.avg(F.when(F.col("variant") == v, F.col("passed").cast("double")))
    return runs.groupBy("task").agg((share("candidate") - share("baseline")).alias("difference"))


#: Experiments of so many tasks at most have all their sign flips tried.
EXACT = 12


def intervals(differences: DataFrame, by: list[str], rounds: int = 10_000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """A row an experiment (the columns `by`) of its tasks (task, difference): tasks, accuracy_delta, the bootstrap interval of its mean (low,
    high), p_value of a two-sided sign flip test, positive_evidence. All experiments are in one plan.

    Tasks are what is drawn. In each round a task counts as often as a Poisson number says, which is what drawing with
    replacement comes to; the numbers are taken from an MD5 digest of task, round and seed, so that any engine gets the
    same. Every task makes a row a round, and these are summed by round where they are. Signs are flipped by the same digest, or, in
    experiments of up to EXACT tasks, in all ways. Experiments with a null difference are refused.
    """
    d = differences.select(*by, F.col("task").cast("string").alias("task"), F.col("difference").cast("double").alias("d"))
    own = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    d = d.withColumn("k", F.row_number().over(own.orderBy("task")) - 1).withColumn("n", F.count("*").over(own))
    d = d.withColumn("d", F.when(F.col("d").isNull(), F.raise_error(F.concat(F.lit("a task is unpaired: "), "task"))).otherwise(F.col("d")))
    all_ways = F.col("n") <= EXACT
    flips = F.when(all_ways, F.call_function("shiftleft", F.lit(1), F.col("n").cast("int"))).otherwise(rounds)
    each = d.select(*by, "task", "d", "k", "n", flips.alias("flips"), F.explode(F.sequence(F.lit(0), F.greatest(flips, F.lit(rounds)) - 1)).alias("round"))
    digest = F.md5(F.concat_ws(":", "task", F.col("round").cast("string"), F.lit(str(seed))))
    each = each.withColumn("u", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / float(1 << 32)).withColumn("half", F.conv(F.substring(digest, 9, 1), 16, 10).cast("int") % 2)
    below, term, steps = 0.0, math.exp(-1), []
    for i in range(1, 12):  # the chance of more than eleven is under 1 in 10^9
        below += term
        term /= i
        steps.append(below)
    weight = F.lit(0)
    for t in steps:
        weight = weight + F.when(F.col("u") >= t, 1).otherwise(0)
    bit = F.when(all_ways, F.expr("shiftright(round, k)").bitwiseAND(F.lit(1))).otherwise(F.col("half"))
    sums = each.groupBy(*by, "round").agg(
        F.sum(weight * F.col("d")).alias("drawn"), F.sum(weight).alias("times"), F.sum(F.when(bit == 1, -F.col("d")).otherwise(F.col("d"))).alias("flipped"), F.sum("d").alias("sum"), F.max("n").alias("n"), F.max("flips").alias("flips"),
    )
    mean = F.when((F.col("round") < rounds) & (F.col("times") > 0), F.col("drawn") / F.col("times"))
    as_far = F.count_if((F.col("round") < F.col("flips")) & (F.abs("flipped") >= F.abs("sum") - 1e-9))
    one = sums.groupBy(*by).agg(
        F.max("n").alias("tasks"), (F.max("sum") / F.max("n")).alias("accuracy_delta"), F.percentile(mean, alpha / 2).alias("low"), F.percentile(mean, 1 - alpha / 2).alias("high"),
        F.when(F.max("n") <= EXACT, as_far / F.max("flips")).otherwise((as_far + 1) / (F.max("flips") + 1)).alias("p_value"),
    )
    return one.withColumn("positive_evidence", (F.col("accuracy_delta") > 0) & (F.col("low") > 0) & (F.col("p_value") < alpha))


def paired_report(runs: DataFrame, rounds: int = 10_000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """intervals() of the differences of one experiment's tasks."""
    return intervals(task_differences(runs), [], rounds, seed, alpha)


def random_flips(spark: SparkSession, differences: list[float], rounds: int = 10_000, seed: int = 0) -> DataFrame:
    """One row: the two-sided p-value of the mean under random sign flips."""
    values = F.array(*[F.lit(float(d)) for d in differences])
    total = F.aggregate(F.transform(values, lambda v, i: F.when(F.xxhash64(F.col("id"), i, F.lit(seed)) % 2 == 0, v).otherwise(-v)), F.lit(0.0), lambda s, x: s + x)
    seen = abs(sum(differences))
    return spark.range(rounds).agg(((F.count_if(F.abs(total) >= seen - 1e-12) + 1) / (F.count("*") + 1)).alias("p_value"))


def ledger(calls: DataFrame, *by: str) -> DataFrame:
    """One row, or one for each value of the columns `by`, over calls (input_tokens, output_tokens, cost, failed): calls, tokens, cost_usd. A failed call, or one that
    doesn't say, makes the sum it belongs to null."""
    said = lambda *c: F.count_if(F.col("failed") | F.coalesce(*c).isNull()) == 0
    tokens = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    return calls.groupBy(*by).agg(
        F.count("*").alias("calls"), F.when(said("input_tokens", "output_tokens"), F.coalesce(F.sum(tokens), F.lit(0))).alias("tokens"),
        F.when(said("cost"), F.coalesce(F.sum(F.col("cost").cast("decimal(20,6)")), F.lit(0)).cast("double")).alias("cost_usd"),
    )


def experiment_history(events: DataFrame) -> DataFrame:
    """id, kind, status of experiments from their events (id, file, status, ord).

    file: run (a run's inputs), record, proposal, inputs, evaluation, transition. A run has the status of its last record,
    else incomplete; a proposal that of its transition, else of its first evaluation, else incomplete if it has inputs.
    """
    has = lambda f: F.count_if(F.col("file") == f) > 0
    pick = lambda f, by: by(F.when(F.col("file") == f, F.col("status")), F.when(F.col("file") == f, F.col("ord")))
    g = events.groupBy("id").agg(
        has("run").alias("r"), has("proposal").alias("p"), pick("record", F.max_by).alias("record"), pick("transition", F.max_by).alias("t"), pick("evaluation", F.min_by).alias("e"), has("inputs").alias("i"),
    )
    status = F.when(F.col("r"), F.coalesce("record", F.lit("incomplete"))).otherwise(F.coalesce("t", "e", F.when(F.col("i"), "incomplete").otherwise("proposed")))
    return g.filter("r or p").select("id", F.when(F.col("r"), "run").otherwise("proposal").alias("kind"), status.alias("status"))


def suite_problems(tasks: DataFrame, files: DataFrame, splits: tuple[str, ...] = ("validation", "holdout")) -> DataFrame:
    """problem, id of a task suite: tasks (id, split, question, answer_all, citations, abstain) against files (path).

    duplicate_id, repeated_question (in any case), bad_split, no_question, no_checks (answerable, without answers or citations), missing_citation,
    missing_split (id: the split).
    """
    problem = lambda df, name: df.select(F.lit(name).alias("problem"), F.col("id").cast("string").alias("id"))
    more = lambda key: tasks.groupBy(key.alias("k")).agg(F.count("*").alias("n"), F.min("id").alias("id")).filter("n > 1 and k is not null and k <> ''")
    bare = ~F.col("abstain") & ((F.coalesce(F.size("answer_all"), F.lit(0)) <= 0) | (F.coalesce(F.size("citations"), F.lit(0)) <= 0))
    cited = tasks.select("id", F.explode("citations").alias("path")).join(files.select("path").distinct(), "path", "left_anti").select("id").distinct()
    wanted = tasks.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, splits))).alias("split"))
    parts = [
        problem(more(F.col("id")), "duplicate_id"), problem(more(X.folded("question")), "repeated_question"), problem(tasks.filter(~F.coalesce(F.col("split").isin(*splits), F.lit(False))), "bad_split"),
        problem(tasks.filter(F.coalesce(X.strip("question"), F.lit("")) == ""), "no_question"), problem(tasks.filter(F.coalesce(bare, F.lit(True))), "no_checks"), problem(cited, "missing_citation"),
        problem(wanted.join(tasks.select("split").distinct(), "split", "left_anti").withColumn("id", F.col("split")), "missing_split"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def accuracy(answers: DataFrame, choice: str = "choice", truth: str = "relation") -> DataFrame:
    """One row: the share of answered rows whose choice is right; null if none is answered."""
    return answers.filter(F.col(choice).isNotNull()).agg(F.round(F.avg((F.col(choice) == F.col(truth)).cast("double")), 4).alias("accuracy"))


def gate_report(pool: DataFrame, threshold: float, k: int = 5) -> DataFrame:
    """variant (baseline, gated), fp_rate, recall, rows_read over pools (query, negative, rank, relevant, score).

    Gated keeps rows whose score reaches the threshold; of either the first k rows of a query are read.
    """
    gated = pool.filter(F.col("score") >= threshold)
    out = None
    every = pool.groupBy("query").agg(F.first("negative").alias("negative"))
    for name, rows in (("baseline", pool), ("gated", gated)):
        first = rows.withColumn("_k", F.row_number().over(W.partitionBy("query").orderBy("rank"))).filter(F.col("_k") <= k)
        got = first.groupBy("query").agg(F.count("*").alias("read"), F.max(F.col("relevant").cast("int")).alias("hit"))
        j = every.join(got, "query", "left").fillna(0, ["read", "hit"])
        rate = lambda c, when: F.avg(F.when(when, c.cast("double")))
        one = j.agg(F.lit(name).alias("variant"), rate(F.col("read") > 0, F.col("negative")).alias("fp_rate"), rate(F.col("hit") > 0, ~F.col("negative")).alias("recall"), F.sum("read").alias("rows_read"))
        out = one if out is None else out.unionByName(one)
    return out


def binary_report(items: DataFrame, grid: tuple[float, ...] = GRID) -> DataFrame:
    """part (tune, test, all, all_at_0.5), threshold, tp, fp, fn, precision, recall, f1, n over items (id, score, label).

    The threshold is fitted on every other item in order of id, and reported on the others too; items without a score are left out.
    """
    ok = alternate_split(items.filter("score is not null"), "id")
    best = best_threshold(ok.filter("fold = 'tune'"), grid).select("threshold")  # one row
    actual = F.col("label") == 1

    def part(rows: DataFrame, name: str, threshold: Column) -> DataFrame:
        c = rows.crossJoin(F.broadcast(best)).withColumn("_t", threshold).agg(F.lit(name).alias("part"), F.max("_t").alias("threshold"), *counts(F.col("score") >= F.col("_t"), actual), F.count("*").alias("n"))
        return with_prf(c)

    fit = F.col("threshold")
    parts = [part(ok.filter("fold = 'tune'"), "tune", fit), part(ok.filter("fold = 'test'"), "test", fit), part(ok, "all", fit), part(ok, "all_at_0.5", F.lit(0.5))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def sign_flip_test(spark: SparkSession, differences: list[float]) -> DataFrame:
    """One row: the exact two-sided p-value of the mean under all sign flips (at most 16 differences)."""
    if len(differences) > 16:
        raise ValueError("exact for at most 16 differences")
    flips = spark.range(1 << len(differences))
    total = F.lit(0.0)
    for i, d in enumerate(differences):
        total = total + F.when(F.call_function("shiftright", F.col("id"), F.lit(i)).bitwiseAND(F.lit(1)) == 1, F.lit(-float(d))).otherwise(F.lit(float(d)))
    seen = abs(sum(differences))
    return flips.agg((F.count_if(F.abs(total) >= seen - 1e-12) / F.count("*")).alias("p_value"))


def bootstrap(spark: SparkSession, differences: list[float], rounds: int = 10_000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """One row: low and high of the mean's bootstrap interval over tasks."""
    n = len(differences)
    values = F.array(*[F.lit(float(d)) for d in differences])
    draw = lambda i: F.get(values, F.pmod(F.xxhash64(F.col("id"), i, F.lit(seed)), F.lit(n)).cast("int"))
    mean = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(n)), draw), F.lit(0.0), lambda s, x: s + x) / n
    tail = (1 - level) / 2
    return spark.range(rounds).select(mean.alias("m")).agg(F.percentile("m", tail).alias("low"), F.percentile("m", 1 - tail).alias("high"))


# --- decisions


def overlap_score(query: Column | str, text: Column | str) -> Column:
    """The offline scorer: the share of the query's distinct tokens that the text has."""
    q = F.array_distinct(X.tokenize(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, X.tokenize(text))) / F.size(q)).otherwise(F.lit(0.0))


def gate(pool: DataFrame, score: Column, threshold: float = 0.65, n: int = 5) -> DataFrame:
    """Rows of a ranked pool whose score reaches the threshold, in rank order, at most n; a null score fails open."""
    s = pool.withColumn("probability", score)
    return s.filter(F.col("probability").isNull() | (F.col("probability") >= threshold)).orderBy("rank").limit(n)


def evidence_pairs(bodies: DataFrame, items: DataFrame, body_id: str, item_id: str) -> DataFrame:
    """item_id, body_id of all evidence (item_id, evidence) that occurs in a body (body_id, body), ignoring case and white space.

    A match's inner words are whole words of the body, so a body shares the first three of them: an equi join of ids on hashes of
    three words, after which each candidate's body is looked at once. Evidence of under five words has too few; it is looked
    for in every body, and broadcast only if it is short in all, too.
    """
    d = bodies.select(body_id, X.normalized("body").alias("_b"))
    e = items.select(item_id, X.normalized("evidence").alias("_e")).filter("_e <> ''").withColumn("_w", F.split("_e", " "))
    gram = lambda w, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    heads = e.filter(F.size("_w") >= 5).select(item_id, gram(F.col("_w"), F.lit(1)).alias("_k"))
    every = X.let(F.split("_b", " "), lambda w: F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: gram(w, i))))
    grams = d.select(body_id, F.explode(every).alias("_k"))
    pairs = grams.join(heads, "_k").select(item_id, body_id).distinct()
    found = pairs.join(e.select(item_id, "_e"), item_id).join(d, body_id).filter(F.col("_b").contains(F.col("_e"))).select(item_id, body_id)
    few = e.filter(F.size("_w") < 5).select(item_id, "_e").distinct()
    size = few.agg(F.coalesce(F.sum(F.octet_length("_e")), F.lit(0))).first()[0]
    short = d.join(F.broadcast(few) if size <= 1 << 20 else few, F.col("_b").contains(F.col("_e"))).select(item_id, body_id)
    return found.unionByName(short).distinct()


def check_evidence(rows: DataFrame, body: str, evidence: str, claim: str, threshold: float = 0.55) -> DataFrame:
    """supported, by quote or by the best sentence of the body (array column `sentences`)."""
    best = F.array_max(F.transform("sentences", lambda s: F.struct(overlap_score(claim, s).alias("p"), s.alias("sentence"))))
    r = rows.withColumn("quoted", X.contains_evidence(body, evidence)).withColumn("_b", best)
    return r.withColumn("supported", F.col("quoted") | (F.coalesce(F.col("_b.p"), F.lit(0.0)) >= threshold)).withColumn("best_sentence", F.col("_b.sentence")).drop("_b")


def contradiction_pairs(claims: DataFrame, n: int = 200) -> DataFrame:
    """Pairs of claims (entity, ord, path, text) on one entity from two pages, i before j, the first n by (entity, i, j).

    Claims without an entity, ord or path are in no pair. Other claims of the same page, or with the same ord, are no partners, however
    many they are, so an entity's first claims alone won't do. At one ord n claims of a page and 2n of all are enough. Of the ords, all but the last
    page's have partners, so that the first n + 1 with any hold the first n pairs; a partner has fewer than 2n + 1 ords with other pages
    than the claim's before it, so that each page's first 2n + 2 ords, and of what is left an entity's first 4n + 4, are enough.
    """
    first = claims.filter("entity is not null and ord is not null and path is not null")
    by = lambda *own: W.partitionBy("entity", *own)
    for k, most in (
        (F.dense_rank().over(by("path").orderBy("ord")), 2 * n + 2), (F.row_number().over(by("ord", "path").orderBy("text")), n),
        (F.row_number().over(by("ord").orderBy("path", "text")), 2 * n), (F.dense_rank().over(by().orderBy("ord")), 4 * n + 4),
    ):
        first = first.withColumn("_k", k).filter(F.col("_k") <= most)
    a = first.select("entity", F.col("ord").alias("i"), F.col("path").alias("path_a"), F.col("text").alias("a"))
    b = first.select("entity", F.col("ord").alias("j"), F.col("path").alias("path_b"), F.col("text").alias("b"))
    return a.join(b, "entity").filter("i < j and path_a <> path_b").orderBy("entity", "i", "j").limit(n)


def shortlist(candidates: DataFrame, score: Column, threshold: float = 0.5, n: int = 30) -> DataFrame:
    """The first n candidates (rank), one per page, by what a scorer says of them: probability, shortlisted, position.

    Where a score is missing all keep their search order and nothing is shortlisted (failed_open).
    """
    s = candidates.orderBy("rank").limit(n).withColumn("probability", F.round(score, 4))
    s = s.withColumn("failed_open", F.count_if(F.col("probability").isNull()).over(W.partitionBy()) > 0)  # at most n rows
    s = s.withColumn("probability", F.when(~F.col("failed_open"), F.col("probability"))).withColumn("shortlisted", F.coalesce(F.col("probability") >= threshold, F.lit(False)))
    return s.withColumn("position", F.row_number().over(W.orderBy(F.desc("probability"), "rank")))


def contradictions(pairs: DataFrame, score: Column, threshold: float = 0.5) -> DataFrame:
    """Pairs that a scorer holds to contradict each other, with contradicts and position; ties in the pairs' order."""
    s = pairs.withColumn("contradicts", score).filter(F.col("contradicts") >= threshold)
    return s.withColumn("position", F.row_number().over(W.orderBy(F.desc("contradicts"), "entity", "i", "j"))).withColumn("contradicts", F.round("contradicts", 4))


def flag_untrusted(rows: DataFrame, score: Column, threshold: float = 0.7) -> DataFrame:
    return rows.withColumn("probability", score).filter(F.col("probability") >= threshold).withColumn("kind", F.lit("untrusted_text"))


def grounded(verdicts: DataFrame, sources: DataFrame) -> DataFrame:
    """id, grounded of verdicts (id, needs_evidence, evidence: array of (source, quote)) against sources (source, body).

    Every quote must be in the text of the source it names; a verdict that needs evidence must have some.
    """
    e = verdicts.select("id", F.explode("evidence").alias("e")).select("id", "e.source", "e.quote")
    good = F.coalesce((F.col("quote") != "") & F.col("body").contains(F.col("quote")), F.lit(False))
    bad = e.join(sources.select("source", "body"), "source", "left").filter(~good).select("id").distinct().withColumn("_bad", F.lit(True))
    enough = ~F.col("needs_evidence") | (F.coalesce(F.size("evidence"), F.lit(0)) > 0)
    return verdicts.join(bad, "id", "left").select("id", (F.col("_bad").isNull() & enough).alias("grounded"))


def _values(value) -> list[tuple]:
    """All values within a JSON value, outer ones first: (value, numbers of those right in it by key or place)."""
    found = [(value, {})]
    for v, inside in found:  # grows while it is read
        for k, child in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ():
            inside[k] = len(found)
            found.append((child, {}))
    return found


def json_contains(expected, actual) -> bool:
    """Whether actual has all that expected has: the keys of objects, and for each element of a list some element.

    For every value of expected, inner ones first, the values of actual that have it are found once.
    """
    have, want = _values(actual), _values(expected)
    fits: list[set[int]] = [set()] * len(want)
    for w in range(len(want) - 1, -1, -1):
        value, parts = want[w]
        same = [(n, v, inside) for n, (v, inside) in enumerate(have) if type(v) is type(value)]
        if isinstance(value, dict):
            fits[w] = {n for n, _, inside in same if all(inside.get(k) in fits[p] for k, p in parts.items())}
        elif isinstance(value, list):
            fits[w] = {n for n, _, inside in same if not any(fits[p].isdisjoint(inside.values()) for p in parts.values())}
        else:
            fits[w] = {n for n, v, _ in same if v == value}
    return 0 in fits[0]


@F.pandas_udf(T.BooleanType())
def _json_udf(kind: pd.Series, want: pd.Series, text: pd.Series) -> pd.Series:
    """kind json: equal values; json_subset: contained; jsonl_subset: contained in the list of the lines' values."""

    def one(kind: str, want: str | None, text: str | None) -> bool:
        try:
            expected = json.loads(want)
            actual = [json.loads(x) for x in text.splitlines() if x.strip()] if kind == "jsonl_subset" else json.loads(text)
        except (ValueError, TypeError):
            return False
        return actual == expected if kind == "json" else json_contains(expected, actual)

    return pd.Series([one(*x) for x in zip(kind, want, text, strict=True)], dtype=bool)


def json_subset(expected: Column | str, actual: Column | str) -> Column:
    """Whether one JSON text contains another at every level; unreadable ones don't."""
    return _json_udf(F.lit("json_subset"), expected, actual)


def artifact_checks(checks: DataFrame, files: DataFrame) -> DataFrame:
    """checks (path, kind, equals in JSON) with passed, against files (path, content).

    Kinds: text (a string, equal), contains (a list of strings, all there), json, json_subset, jsonl_subset, absent. What can't be read, or is of another type, fails.
    """
    j = checks.join(files.select("path", F.col("content").alias("_c")), "path", "left")
    want = F.try_parse_json("equals")
    type_ = F.schema_of_variant(want)
    text = (type_ == "STRING") & (F.try_variant_get(want, "$", "string") == F.col("_c"))
    parts = type_.isin("ARRAY<STRING>", "ARRAY<VOID>") & F.forall(F.try_variant_get(want, "$", "array<string>"), lambda x: F.contains(F.col("_c"), x))
    passed = (
        F.when(F.col("kind") == "absent", F.col("_c").isNull()).when(F.col("_c").isNull(), False).when(F.col("kind") == "text", text).when(F.col("kind") == "contains", parts)
        .when(F.col("kind").isin("json", "json_subset", "jsonl_subset"), _json_udf("kind", "equals", "_c"))
    )
    return j.withColumn("passed", F.coalesce(passed, F.lit(False))).drop("_c")


def consolidate(patterns: DataFrame, updates: DataFrame, observed: DataFrame, iteration: int) -> tuple[DataFrame, DataFrame]:
    """(patterns by id after the updates; updates refused). patterns: id, claim, scope, counterexamples, evidence, iteration, sources.

    An update replaces the pattern of its id but keeps its sources. Its texts must say something, and its evidence name tasks (task) that were observed.
    """
    cited = updates.select("id", F.explode("evidence").alias("task")).join(observed.select("task").distinct(), "task", "left_anti").select("id").distinct().withColumn("_bad", F.lit(True))
    blank = lambda c: F.coalesce(X.strip(c), F.lit("")) == ""
    j = updates.join(cited, "id", "left")
    wrong = F.col("_bad").isNotNull() | blank("claim") | blank("scope") | blank("counterexamples") | (F.coalesce(F.size("evidence"), F.lit(0)) <= 0) | F.col("id").isNull()
    good = j.filter(~wrong).drop("_bad").withColumn("iteration", F.lit(iteration)).join(patterns.select("id", "sources"), "id", "left")
    good = good.withColumn("sources", F.coalesce("sources", F.array().cast("array<string>"))).select(*patterns.columns)
    return patterns.join(good.select("id"), "id", "left_anti").select(*patterns.columns).unionByName(good), j.filter(wrong).drop("_bad")


def unseen(proposals: DataFrame, before: DataFrame, columns: list[str]) -> DataFrame:
    """Proposals (ord) whose content is new: not among those before, and the first of equal ones."""
    mark = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    new = proposals.withColumn("fingerprint", mark).join(before.select(mark.alias("fingerprint")).distinct(), "fingerprint", "left_anti")
    return new.withColumn("_k", F.row_number().over(W.partitionBy("fingerprint").orderBy("ord"))).filter("_k = 1").drop("_k")


def capture(records: DataFrame, kept: DataFrame) -> DataFrame:
    """id, outcome, sha256 of experience records (id, task, verification, model, tools, scope, outcome, actions) against those kept (id, sha256).

    stored, unchanged (the same content), conflict (an id's content never changes), or invalid.
    """
    text = lambda c: F.coalesce(X.strip(c), F.lit("")) != ""
    body = F.to_json(F.struct(*sorted(records.columns)), {"ignoreNullFields": "false"})
    ok = F.col("id").rlike(r"^[a-z0-9][a-z0-9-]*\z") & F.col("outcome").isin("success", "failure") & (F.size("actions") > 0) & F.forall("actions", text)
    for c in ("task", "verification", "model", "tools", "scope"):
        ok &= text(c)
    j = records.select("id", F.coalesce(ok, F.lit(False)).alias("_ok"), F.sha2(body, 256).alias("sha256")).join(kept.select("id", F.col("sha256").alias("_s")), "id", "left")
    return j.select("id", F.when(~F.col("_ok"), "invalid").when(F.col("_s").isNull(), "stored").when(F.col("_s") == F.col("sha256"), "unchanged").otherwise("conflict").alias("outcome"), "sha256")


def task_checks(answers: DataFrame) -> DataFrame:
    """passed of answers with the columns answer, answer_all, answer_none, citations, cited, abstain, abstained."""
    a = X.folded("answer")
    every = F.forall("answer_all", lambda w: a.contains(X.folded(w)))
    none = ~F.exists("answer_none", lambda w: a.contains(X.folded(w)))
    cited = F.size(F.array_except("citations", "cited")) == 0
    same = F.col("abstain") == F.col("abstained")
    return answers.select("*", every.alias("has_all"), none.alias("has_none"), cited.alias("cites"), same.alias("abstains"), (every & none & cited & same).alias("passed"))
