"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted shallow trees are grown over the statistics of a bounded, documented sample of labelled rows; every path from
the root becomes a conjunctive rule, a lasso logistic regression weighs the rules and drops most, and what is left is
compiled into one Spark column expression. Statistics and scores are built-in expressions: one scan, no shuffle.

Defined results: null and empty texts have statistics 0 and are scored by the rules that fit those. Without examples of
both classes the score is the share of good examples (0.5 without any). Repeated rows and null
ids are scored one by one, null ids never held out; a score of 0.5 is predicted good. Very long texts are counted whole. Of
splits of equal gain the first statistic's lowest threshold is taken. An empty table gives an empty result. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm._shared import FIT_ROWS, fit_sample
from textloom.llm.quality_rules import statistics

MODULUS, HELD_OUT = 3, 1
TREES, DEPTH = 40, 3
LASSO = 0.002

#: Statistics as ratios of counts: name, numerator, denominator.
FEATURES = (
    ("words", "n_words", None),
    ("lines", "n_lines", None),
    ("word_length", "word_chars", "n_words"),
    ("symbols", "n_symbols", "n_words"),
    ("exclamations", "n_exclamations", "n_words"),
    ("stop_words", "n_stop_words", "n_words"),
    ("repeated_words", "n_repeat_words", "n_words"),
    ("repeated_lines", "n_dup_lines", "n_lines"),
    ("words_per_line", "n_words", "n_lines"),
)


@dataclass(frozen=True)
class Rule:
    """All of (feature, above, threshold): feature > threshold if above, else feature <= threshold."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, above, t in self.terms:
            out &= (x[:, f] > t) == above
        return out

    def column(self, names: list[str]) -> Column:
        out = F.lit(True)
        for f, above, t in self.terms:
            out &= (F.col(names[f]) > t) if above else (F.col(names[f]) <= t)
        return out


@dataclass(frozen=True)
class Model:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    intercept: float

    def column(self, names: list[str]) -> Column:
        z = F.lit(self.intercept)
        for rule, w in zip(self.rules, self.weights, strict=True):
            z = z + F.when(rule.column(names), F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def features(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    s = statistics(docs, keep=keep)
    ratio = lambda a, b: F.col(a).cast("double") if b is None else F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return s.select(*keep, *[ratio(a, b).alias(name) for name, a, b in FEATURES])


def _tree(x: np.ndarray, bins: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, depth: int, least: int, terms=(), rows=None):
    """Paths of a regression tree on gradients: (terms, rows, value) of the leaves, and the terms of every node."""
    rows = np.arange(len(x)) if rows is None else rows
    g, h = gradient[rows], hessian[rows]
    whole = g.sum() ** 2 / (h.sum() + 1)
    best = (1e-6, None)
    if depth and len(rows) >= 2 * least:
        for f, edges in enumerate(bins):
            if not len(edges):
                continue
            at = np.searchsorted(edges, x[rows, f], "left")
            gs, hs, ns = (np.cumsum(np.bincount(at, v, len(edges) + 1))[:-1] for v in (g, h, np.ones(len(rows))))
            gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - whole
            gain[(ns < least) | (len(rows) - ns < least)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (f, float(edges[k])))
    if best[1] is None:
        return [(terms, rows, -g.sum() / (h.sum() + 1))], []
    f, t = best[1]
    leaves, nodes = [], []
    for above in (False, True):
        own = (*terms, (f, above, t))
        nodes.append(own)
        a, b = _tree(x, bins, gradient, hessian, depth - 1, least, own, rows[(x[rows, f] > t) == above])
        leaves += a
        nodes += b
    return leaves, nodes


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 5) -> list[Rule]:
    """Distinct rules of boosted trees, each on a random half of the rows."""
    random = np.random.Generator(np.random.PCG64(seed))
    bins = [np.unique(np.quantile(x[:, f], np.linspace(0.01, 0.99, 64)))[:-1] if len(x) else np.zeros(0) for f in range(x.shape[1])]
    z, found = np.zeros(len(x)), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        gradient, hessian = weight * (p - y), weight * p * (1 - p)
        part = random.random(len(x)) < 0.5
        leaves, nodes = _tree(x, bins, gradient * part, hessian * part, depth, max(5, len(x) // 500))
        for terms, rows, value in leaves:
            z[rows] += 0.3 * value
        for terms in nodes:
            found.setdefault(Rule(tuple(sorted(terms))), None)
    return list(found)


def lasso(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = LASSO, steps: int = 400) -> tuple[np.ndarray, float]:
    """L1 logistic regression by accelerated proximal gradient steps; the intercept isn't penalized."""
    a = np.hstack([x.astype(float), np.ones((len(x), 1))])
    w = previous = np.zeros(a.shape[1])
    share = weight / weight.sum()
    v = np.ones(a.shape[1])
    for _ in range(30):  # the largest eigenvalue bounds the curvature
        v = a.T @ (share * (a @ v))
        v /= np.linalg.norm(v)
    rate = 1 / (0.25 * float(v @ (a.T @ (share * (a @ v)))) + 1e-9)
    for t in range(1, steps + 1):
        at = w + (t - 1) / (t + 2) * (w - previous)
        p = 1 / (1 + np.exp(-np.clip(a @ at, -40, 40)))
        new = at - rate * (a.T @ (share * (p - y)))
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        previous, w = w, new
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS) -> Model:
    sample, weights = fit_sample(labels, label, MODULUS, HELD_OUT, rows)
    if len(weights) < 2:
        share = {0: 1e-6, 1: 1 - 1e-6}.get(next(iter(weights), -1), 0.5)
        return Model((), (), float(np.log(share / (1 - share))))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    got = sorted(tuple(r) for r in features(own, ("doc_id", "y")).collect())
    if not got:
        return Model((), (), float(np.log(weights[1] / weights[0])))
    table = np.array(got, float)
    x, y = table[:, 2:], table[:, 1]
    weight = np.where(y > 0, weights[1], weights[0])
    rules = grow(x, y, weight)
    if not rules:
        share = (weight * y).sum() / weight.sum()
        return Model((), (), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    w, b = lasso(np.stack([r.holds(x) for r in rules], axis=1), y, weight)
    used = [i for i in range(len(rules)) if w[i]]
    return Model(tuple(rules[i] for i in used), tuple(float(w[i]) for i in used), b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    f = features(docs)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(MODULUS)) == HELD_OUT
    f = f.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), model.column([n for n, _, _ in FEATURES]).alias("score"))
    return f.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
