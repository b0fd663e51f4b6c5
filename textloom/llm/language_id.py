"""Language ID by mixtures: expectation-maximisation over a document's words, and a penalised choice of its languages.

Training counts the hashed character n-grams (2, 3 and 4 code points, lower-cased, words bounded by one space) of all
training documents per language, in one grouped sum with map-side combining. Each language and size gets a smoothed
distribution over `1 << BITS` buckets; a word's log-likelihood in a language is that of its n-grams, averaged over the
sizes. The model is a table of (number of languages) x 3 x 65,536 numbers, 0.75 MB a language, whatever the corpus.

A document is a mixture: each word comes from one of its languages. Expectation-maximisation estimates the proportions of
all learned languages, with a small Dirichlet prior. Sets of the 1, 2, 3 ... strongest languages are then compared by the
log-likelihood of their own mixtures less `PENALTY` * log(words + 1) for each language; a set is only tried while the
mixture of all languages, which bounds every subset's likelihood, could still pay for it. The best set is the document's;
its strongest language is predicted, and the score is that language's share in the mixture of all languages.

All of it runs on batches of words at once, in one pass without a shuffle. A very long text is scored whole: its words'
likelihoods are found in steps and kept as one row of floats a word.

Defined results: null texts and texts without a letter are `und` with score 0, and so is everything where nothing is
learned. Documents without a language, with a null id or without letters teach nothing. Of equally likely languages the
first by name is predicted; letters that no language has are equally unlikely in all. Repeated rows are judged one by one
and teach as often as they occur. An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.hashing import mix

SIZES = (2, 3, 4)
BITS = 16
ALPHA = 0.1
#: Log-likelihood that another language must gain, for each doubling of e in the number of words.
PENALTY = 2.0
PRIOR = 0.01
ROUNDS = 40
MODULUS, HELD_OUT = 3, 1
#: Code points of a step; fewer where there are many languages.
_STEP_CHARS = 1 << 17
#: Distinct (language, bucket) counts that a task holds before it hands them on.
_HELD = 4_000_000

_weights = np.random.Generator(np.random.PCG64(31)).integers(1, 1 << 63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    """A table of all code points."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def _ngrams(texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(word, bucket) of all n-grams of all texts in order of the words, for each size, and the text of each word."""
    points = np.frombuffer(" ".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[points]
    # a word's letters and one space after it; the space before the first word is put in front
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    at = np.flatnonzero(kept)
    letter = letter[at]
    ends = np.flatnonzero(~letter) + 1  # places of the spaces after words, in points
    lengths = np.diff(ends, prepend=0)
    owner = np.searchsorted(np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1), at[ends - 1], "right")
    points = np.concatenate([[32], np.where(letter, points[at], 32)]).astype(np.uint64)
    found = []
    with np.errstate(over="ignore"):
        for s, n in enumerate(SIZES):
            # an n-gram belongs to the word of its second place, and may not reach beyond the space after it
            per = np.maximum(lengths + 2 - n, 0)
            word = np.repeat(np.arange(len(ends)), per)
            first = np.arange(len(word)) + np.repeat(ends - lengths - (np.cumsum(per) - per), per)
            h = points[first] * _weights[0]
            for j in range(1, n):
                h += points[first + j] * _weights[j]
            found.append((word, (mix(h + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64) + (s << BITS)))
    return found, owner


def _steps(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        begin = total = 0
        texts = [(t or "").lower() for t in batch.column("text").to_pylist()]
        for i, t in enumerate(texts):
            total += len(t)
            if total >= size:
                yield batch.slice(begin, i + 1 - begin), texts[begin : i + 1]
                begin, total = i + 1, 0
        if begin < len(texts):
            yield batch.slice(begin), texts[begin:]


def _slices(text: str, size: int) -> Iterator[str]:
    """A long text in slices that end between words, so long as words are shorter than a slice."""
    letter, begin = str.isalpha, 0
    while begin < len(text):
        end = min(begin + size, len(text))
        back = end
        while end < len(text) and back > begin and letter(text[back - 1]) and letter(text[back]):
            back -= 1
        end = back if back > begin else end
        yield text[begin:end]
        begin = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            for lo in range(0, len(at), 50_000):
                own = at[lo : lo + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own, pa.int32()), pa.array(counts[own])], ["lang", "bucket", "n"])
        held.clear()

    for batch, texts in _steps(batches, _STEP_CHARS):
        by_lang: dict[str, list[str]] = {}
        for lang, t in zip(batch.column("lang").to_pylist(), texts, strict=True):
            by_lang.setdefault(lang, []).extend(_slices(t, _STEP_CHARS))
        for lang, own in by_lang.items():
            if lang not in held:
                if (len(held) + 1) * (len(SIZES) << BITS) > _HELD:
                    yield from flush()
                held[lang] = np.zeros(len(SIZES) << BITS, np.int64)
            for lo in range(0, len(own), 64):
                held[lang] += sum(np.bincount(b, minlength=len(SIZES) << BITS) for _, b in _ngrams(own[lo : lo + 64])[0])
    yield from flush()


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]  # sorted
    table: np.ndarray  # log-likelihoods by language and bucket, already divided by the number of sizes


def fit(docs: DataFrame, modulus: int = MODULUS, held_out: int | None = HELD_OUT) -> Model:
    """Learns from all rows with a lang outside the held-out fold (None: from all rows)."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    d = d.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    if held_out is not None:
        d = d.filter(_fold(F.col("doc_id"), modulus) != held_out)
    counts = d.select("text", "lang").mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.toArrow()
    names = got.column("lang").unify_dictionaries().combine_chunks().dictionary_encode() if got.num_rows else pa.array([], pa.string()).dictionary_encode()
    langs = tuple(sorted(names.dictionary.to_pylist()))
    if not langs:
        return Model((), np.zeros((0, len(SIZES) << BITS), np.float32))
    place = np.array([langs.index(x) for x in names.dictionary.to_pylist()])[names.indices.to_numpy(zero_copy_only=False)]
    table = np.zeros((len(SIZES) << BITS, len(langs)))
    table[got.column("bucket").to_numpy(), place] = got.column("n").to_numpy()
    sizes = table.reshape(len(SIZES), 1 << BITS, len(langs))
    sizes = np.log(sizes + ALPHA) - np.log(sizes.sum(1, keepdims=True) + ALPHA * (1 << BITS))
    return Model(langs, np.ascontiguousarray((sizes / len(SIZES)).reshape(-1, len(langs)).T, np.float32))


def _fold(doc_id: Column, modulus: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(modulus))


def word_likelihoods(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihoods (language, word) of all words in order, and the text of each."""
    found, owner = _ngrams(texts)
    likely = np.zeros((len(model.langs), len(owner)), np.float32)
    for word, bucket in found:
        if len(word):
            begins = np.flatnonzero(np.diff(word, prepend=-1))
            own = word[begins]
            for row, own_row in zip(likely, model.table, strict=True):
                row[own] += np.add.reduceat(own_row[bucket], begins)
    return likely, owner


def _mixture(likely: np.ndarray, begins: np.ndarray, among: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihoods of texts whose words begin at `begins`, over the languages that `among` allows each."""
    counts = np.diff(np.append(begins, likely.shape[1]))
    top = np.where(np.repeat(among, counts, axis=1), likely, -np.inf).max(0)
    odds = np.exp(likely - top)
    share = among / among.sum(0)
    for _ in range(ROUNDS):
        part = odds * np.repeat(share.astype(np.float32), counts, axis=1)
        part /= part.sum(0)
        new = np.add.reduceat(part, begins, axis=1, dtype=np.float64) + prior * among
        new /= new.sum(0)
        moved, share = float(np.abs(new - share).max()), new
        if moved < 1e-3:
            break
    total = np.add.reduceat(np.log((odds * np.repeat(share, counts, axis=1)).sum(0)) + top, begins)
    return share, total


def mixtures(likely: np.ndarray, begins: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """(proportions of all languages, proportions of the chosen set), by language and text."""
    n_langs, n_texts = likely.shape[0], len(begins)
    counts = np.diff(np.append(begins, likely.shape[1]))
    full, bound = _mixture(likely, begins, np.ones((n_langs, n_texts), bool), PRIOR)
    rank = np.argsort(np.argsort(-full, axis=0, kind="stable"), axis=0, kind="stable")
    each = penalty * np.log(counts + 1.0)
    chosen = (rank == 0).astype(np.float64)
    lead = np.repeat(rank.argmin(0), counts)
    best = np.add.reduceat(likely[lead, np.arange(len(lead))].astype(np.float64), begins) - each
    for k in range(2, n_langs + 1):
        # no set's likelihood is above that of the mixture of all, which must still pay for k languages
        open_ = np.flatnonzero(bound - k * each > best)
        if not len(open_):
            break
        rows = np.zeros(n_texts, bool)
        rows[open_] = True
        share, total = _mixture(likely[:, np.repeat(rows, counts)], np.cumsum(counts[open_]) - counts[open_], rank[:, open_] < k, 0.0)
        total -= k * each[open_]
        better = total > best[open_]
        best[open_[better]] = total[better]
        chosen[:, open_[better]] = share[:, better]
    return full, chosen


_OUT = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
_SCHEMA = "doc_id long, lang_pred string, score double, languages array<struct<lang: string, share: double>>"


def _predict(broadcast, penalty: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = broadcast.value
        size = max(1 << 12, _STEP_CHARS * 4 // max(4, len(model.langs)))
        for batch, texts in _steps(batches, size):
            pred, score, languages = ["und"] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
            parts = [(i, s) for i, t in enumerate(texts) for s in _slices(t, size)] if model.langs else []
            likely, owner = [], []
            group: list[tuple[int, str]] = []
            total = 0
            for j, p in enumerate(parts):
                group.append(p)
                total += len(p[1])
                if total >= size or j == len(parts) - 1:
                    got, of = word_likelihoods(model, [s for _, s in group])
                    likely.append(got)
                    owner.append(np.array([i for i, _ in group], np.int64)[of])
                    group, total = [], 0
            own = np.concatenate(owner) if owner else np.zeros(0, np.int64)
            if len(own):
                which, begins = np.unique(own, return_index=True)
                full, chosen = mixtures(np.concatenate(likely, axis=1), begins, penalty)
                order = np.argsort(-chosen, axis=0, kind="stable")
                for r, i in enumerate(which.tolist()):
                    lead = order[0, r]
                    pred[i], score[i] = model.langs[lead], min(1.0, full[lead, r])
                    languages[i] = [{"lang": model.langs[c], "share": float(chosen[c, r])} for c in order[:, r].tolist() if chosen[c, r] > 0]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred), pa.array(score), pa.array(languages, _OUT)], ["doc_id", "lang_pred", "score", "languages"])

    return run


def predict(docs: DataFrame, model: Model, penalty: float = PENALTY, modulus: int = MODULUS, held_out: int | None = HELD_OUT) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages (the chosen set with its shares, the largest first)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = own.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model), penalty), _SCHEMA)
    held = F.lit(False) if held_out is None else F.coalesce(_fold(F.col("doc_id"), modulus) == held_out, F.lit(False))
    return got.select("doc_id", held.alias("held_out"), "lang_pred", "score", "languages")
