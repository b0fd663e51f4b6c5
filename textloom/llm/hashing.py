"""Vectorized word and shingle hashes over batches of texts.

A word's hash is a polynomial over a random table of its bytes, taken from one running sum over the whole batch, so no
Python object is made per word. Shingles are weighted sums of word hashes. All hashes have 64 bits and depend only on
the bytes, on every machine alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
#: Bytes of text per step; bounds the working memory at about 60 times this.
STEP_BYTES = 1 << 20

_table = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_weights = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
#: White space and ASCII punctuation, for comparing wording alone.
SPACES_AND_PUNCTUATION = SPACES.copy()
SPACES_AND_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True

_powers = np.zeros(0, np.uint64)
_inverse = np.zeros(0, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        m = max(n, 2 * len(_powers), 1 << 16)
        back = pow(_MULTIPLIER, -1, 1 << 64)
        with np.errstate(over="ignore"):
            for factor, name in ((_MULTIPLIER, "_powers"), (back, "_inverse")):
                steps = np.full(m, factor & ((1 << 64) - 1), np.uint64)
                steps[0] = 1
                globals()[name] = np.multiply.accumulate(steps)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes], breaks: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, A-Z lower-cased, and where each text's words begin (one more at the end)."""
    joined = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    joined = LOWER[joined]
    gap = breaks[joined]
    n = len(joined)
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if n and not gap[0]:
        edge = np.concatenate([[0], edge])
    if n and not gap[-1]:
        edge = np.concatenate([edge, [n]])
    first, last = edge[0::2], edge[1::2]
    _grow(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_table[joined] * _powers[:n], out=sums[1:])
        words = mix((sums[last] - sums[first]) * _inverse[first])
    ends = np.cumsum(lengths)
    starts = np.searchsorted(first, np.concatenate([[0], ends]))
    return words, starts


def shingle_hashes(words: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, by text; a text of 1 to k - 1 words has one shingle of all of them."""
    counts = np.diff(starts)
    per = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    begin = np.concatenate([[0], np.cumsum(per)])
    at = np.arange(begin[-1]) + np.repeat(starts[:-1] - begin[:-1], per)
    with np.errstate(over="ignore"):
        if len(words) >= k:
            rolled = words[: len(words) - k + 1] * _weights[0]
            for j in range(1, k):
                rolled += words[j : len(words) - k + 1 + j] * _weights[j]
        else:
            rolled = np.zeros(0, np.uint64)
        out = np.zeros(begin[-1], np.uint64)
        whole = np.repeat(counts >= k, per)
        out[whole] = mix(rolled[at[whole]] + np.uint64(k))
        for i in np.flatnonzero((counts < k) & (counts > 0)).tolist():
            own = words[starts[i] : starts[i + 1]]
            out[begin[i]] = mix((own * _weights[: len(own)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own)))[0]
    return out, begin


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of n words, from one running sum."""
    _grow(len(words) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * _powers[: len(words)], out=sums[1:])
        return (sums[n:] - sums[: len(sums) - n]) * _inverse[: max(len(sums) - n, 0)]


def text_steps(batches: Iterator[pa.RecordBatch], size: int = STEP_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, texts in UTF-8) of bounded size from batches of (id, text); a null text is empty."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).cast(pa.large_binary() if pa.types.is_large_string(batch.column(1).type) else pa.binary())
        for lo in range(0, batch.num_rows, 512):
            own_ids, own = ids.slice(lo, 512).to_pylist(), [t or b"" for t in texts.slice(lo, 512).to_pylist()]
            begin = total = 0
            for i, t in enumerate(own):
                total += len(t)
                if total >= size:
                    yield own_ids[begin : i + 1], own[begin : i + 1]
                    begin, total = i + 1, 0
            if begin < len(own):
                yield own_ids[begin:], own[begin:]
