"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed n-grams (4, 6 and 8 characters, A-Z lower-cased) that it has: the longer ones reach over
a word's beginning into its stem, which tells words built of everyday syllables apart. Over a bounded, documented
sample of labelled rows, the log ratio of smoothed counts in toxic and other texts is taken of every bucket; the buckets
that tell most (by chi-squared, and a ratio of at least e) are kept, each is scaled by its ratio, and an L2 logistic regression is fitted on them. Counting and
feature extraction run on the executors and send fixed-size arrays; the driver sees only the kept buckets of the sample.
Scoring is one pass over whole texts, without a shuffle.

Defined results: null and empty texts have no features; their score is that of the intercept. Texts under four
characters likewise. Very long texts are scored whole, in a step of their own. Of features of equal worth that with the lower bucket is kept; a
score of 0.5 is predicted toxic. Rows with null ids are scored and never held out. Without examples of both classes the score is the share of toxic examples (0.5 without any).
Repeated rows are scored one by one. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._shared import FIT_ROWS, cut, fit_sample
from textloom.llm.hashing import mix

SIZES = (4, 6, 8)
BITS = 20
KEPT = 4096
#: Log-count ratios nearer to 0 than this are no features.
LEAST_RATIO = 1.0
#: A toxic example counts as so many others: missing one is worse than a false alarm.
TOXIC_WEIGHT = 6.0
MODULUS, HELD_OUT = 5, 0
_PARTS = 16
#: Tasks that count a sample's features at most: each sends 16 MB before compression.
_COUNTERS = 32
_STEP_CHARS = 1 << 19

_weights = np.random.Generator(np.random.PCG64(23)).integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _buckets(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of all n-grams that texts have, each once; wanted: a mask of buckets."""
    joined = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    upper = (joined >= 65) & (joined <= 90)
    joined[upper] += np.uint64(32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), lengths)
    found = []
    with np.errstate(over="ignore"):
        for n in SIZES:
            m = len(joined) - n + 1
            if m <= 0:
                continue
            h = joined[:m] * _weights[0]
            for j in range(1, n):
                h += joined[j : m + j] * _weights[j]
            bucket = (mix(h + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64)
            inside = owner[:m] == owner[n - 1 :]
            if wanted is not None:
                inside &= wanted[bucket]
            found.append((owner[:m][inside] << BITS) | bucket[inside])
    keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return keys >> BITS, keys & ((1 << BITS) - 1)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        begin = total = 0
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for i, t in enumerate(texts):
            total += len(t)
            if total >= _STEP_CHARS or i - begin >= 1023:
                yield batch.slice(begin, i + 1 - begin), texts[begin : i + 1]
                begin, total = i + 1, 0
        if begin < len(texts):
            yield batch.slice(begin), texts[begin:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BITS), np.int64)
    for batch, texts in _steps(batches):
        y = np.asarray(batch.column("y").to_pylist(), np.int64)
        owner, bucket = _buckets(texts)
        for c in (0, 1):
            counts[c] += np.bincount(bucket[y[owner] == c], minlength=1 << BITS)
    if counts.any():
        parts = np.split(counts, _PARTS, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(range(_PARTS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "counts"])


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b, np.int64) for b in table.column("counts").to_pylist())
    return pa.table([table.column("part").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["part", "counts"])


def _extract(place: np.ndarray):
    """The kept features of each example, as positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _steps(batches):
            owner, bucket = _buckets(texts, place >= 0)
            cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
            rows = [place[bucket[a:b]].astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(rows, pa.binary())], ["doc_id", "y", "features"])

    return run


def logistic(rows: np.ndarray, cols: np.ndarray, scale: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-3, steps: int = 200) -> tuple[np.ndarray, float]:
    """L2 logistic regression on 0/1 entries (rows, cols) times scale, by Adam over the whole sample."""
    w, b, n = np.zeros(len(scale)), 0.0, weight.sum()
    first, second = np.zeros(len(scale) + 1), np.zeros(len(scale) + 1)
    for t in range(1, steps + 1):
        z = np.bincount(rows, (w * scale)[cols], len(y)) + b
        error = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
        gradient = np.append(np.bincount(cols, error[rows], len(scale)) * scale + l2 * w, error.sum())
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        move = 0.1 * (0.1 if t > steps * 2 // 3 else 1.0) * first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


@dataclass(frozen=True)
class Model:
    by_bucket: np.ndarray  # scaled weights; 0 for buckets that aren't kept
    intercept: float


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS, kept: int = KEPT, alpha: float = 1.0) -> Model:
    sample, weights = fit_sample(labels, label, MODULUS, HELD_OUT, rows)
    flat = np.zeros(1 << BITS)
    if len(weights) < 2:
        share = {0: 1e-6, 1: 1 - 1e-6}.get(next(iter(weights), -1), 0.5)
        return Model(flat, float(np.log(share / (1 - share))))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    examples = cut(own.join(F.broadcast(sample), "doc_id").select("doc_id", "y", "text"))
    parts = examples.coalesce(_COUNTERS).mapInArrow(_count, "part int, counts binary").groupBy("part").applyInArrow(_add, "part int, counts binary").collect()
    counts_of = {r.y: r.n for r in examples.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not parts or len(counts_of) < 2:
        return Model(flat, float(np.log(weights[1] / weights[0])))
    counts = np.concatenate([np.frombuffer(r.counts, np.int64).reshape(2, -1) for r in sorted(parts, key=lambda r: r.part)], axis=1)
    n0, n1 = counts_of[0], counts_of[1]
    ratio = np.log((counts[1] + alpha) / (n1 + 2 * alpha)) - np.log((counts[0] + alpha) / (n0 + 2 * alpha))
    a, b = counts[1].astype(float), counts[0].astype(float)
    gain = (a * (n0 - b) - b * (n1 - a)) ** 2 / ((a + b) * (n0 + n1 - a - b) + 1)  # chi-squared, but for a constant
    gain = np.where((a + b >= 3) & (np.abs(ratio) > LEAST_RATIO), gain, 0)
    best = np.sort(np.argsort(-gain, kind="stable")[: min(kept, int((gain > 0).sum()))])
    place = np.full(1 << BITS, -1, np.int64)
    place[best] = np.arange(len(best))
    got = sorted(((r.doc_id, r.y, bytes(r.features)) for r in examples.mapInArrow(_extract(place), "doc_id long, y int, features binary").collect()), key=lambda r: r[0])
    cols = [np.frombuffer(f, np.int32) for _, _, f in got]
    y = np.array([c for _, c, _ in got], float)
    if not len(best):
        return Model(flat, float(np.log(weights[1] * n1 / (weights[0] * n0))))
    w, b = logistic(np.repeat(np.arange(len(got)), [len(c) for c in cols]), np.concatenate(cols).astype(np.int64), ratio[best], y, np.where(y > 0, TOXIC_WEIGHT * weights[1], weights[0]))
    flat[best] = w * ratio[best]
    return Model(flat, b)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket, intercept = model.value.by_bucket, model.value.intercept
        wanted = by_bucket != 0
        for batch, texts in _steps(batches):
            owner, bucket = _buckets(texts, wanted)
            z = np.bincount(owner, by_bucket[bucket], len(texts)) + intercept
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = own.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(MODULUS)) == HELD_OUT
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
