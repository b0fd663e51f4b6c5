"""Fill-in-middle: documents cut in three by a sparse index of checkpoints, and put together with the middle last.

While a text's units are counted, its byte and code-point offsets are recorded at every STEP-th unit. A cut after so many
units is found by binary search among the checkpoints and a scan of the few units from there on, so an index takes a
thousandth of its text and no text is decoded or made a list of units. Units are code points, words (with the white space
before them; white space at the end is one more) or lines; all of them are told by single bytes of UTF-8, so counting goes by fixed chunks of bytes.

Which form a document gets and where it is cut depends on its id alone: h1 to h4 are the first four groups of 8
hexadecimal digits of the SHA-256 of `<salt>:<doc_id>`. The prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1)
units, the middle after the larger. A text stays plain where h3 % 100 is `rate` or more; of the others those with
h4 % 100 under `suffix_first` become spm (suffix, prefix, middle), the rest psm (prefix, suffix, middle).

Everything is one pass over the rows without a shuffle; a task holds one step of texts and their outputs.

Defined results: a null text counts as empty; empty texts, texts that hold a marker and rows with a null doc_id stay
plain. A plain row's prefix_chars and middle_chars are null. Where both cuts are equal the middle is empty. Repeated rows
are treated one by one, alike. Very long texts are cut whole. An empty table gives an empty result. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units from one checkpoint to the next.
STEP = 1024
RATE, SUFFIX_FIRST = 90, 20
_CHUNK = 1 << 16
#: Bytes of text whose outputs are handed on together.
_STEP_BYTES = 1 << 22
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _heads(part: np.ndarray) -> np.ndarray:
    """Where code points begin."""
    return (part & 0xC0) != 0x80


def _begins(data: np.ndarray, low: int, high: int, unit: str) -> np.ndarray:
    """Where units begin in data[low:high]."""
    part, before = data[low:high], data[max(low - 1, 0) : high - 1]
    if unit == "char":
        return _heads(part)
    before = (np.concatenate([[10], before]) if low == 0 else before)[: len(part)]
    begins = _SPACE[part] & ~_SPACE[before] if unit == "word" else before == 10
    if low == 0:
        begins[:1] = True
    return begins


class Index:
    """Checkpoints of one text: the byte and code-point offsets of the units 0, step, 2 * step and so on."""

    def __init__(self, text: bytes, unit: str = "char", step: int = STEP):
        if unit not in ("char", "word", "line"):
            raise ValueError(f"unknown unit {unit}")
        self.data, self.unit = np.frombuffer(text, np.uint8), unit
        self.n = self.chars = 0
        marks, chars = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for low in range(0, len(self.data), _CHUNK):
            at, heads = np.flatnonzero(_begins(self.data, low, low + _CHUNK, unit)), _heads(self.data[low : low + _CHUNK])
            own = at[-self.n % step :: step]
            if len(own):
                marks.append(own + low)
                chars.append(self.chars + np.cumsum(heads)[own] - 1)
            self.n += len(at)
            self.chars += int(np.count_nonzero(heads))
        self.bytes_at, self.chars_at = np.concatenate(marks), np.concatenate(chars)
        self.units_at = np.arange(len(self.bytes_at)) * step

    def locate(self, units: int) -> tuple[int, int]:
        """(bytes, code points) before the cut after so many units."""
        if units >= self.n:
            return len(self.data), self.chars
        c = int(np.searchsorted(self.units_at, units, "right")) - 1
        low, chars, left = int(self.bytes_at[c]), int(self.chars_at[c]), units - int(self.units_at[c])
        while True:  # in chunks, since units may be long
            high = min(low + _CHUNK, len(self.data))
            at = np.flatnonzero(_begins(self.data, low, high, self.unit))
            end = low + int(at[left]) if left < len(at) else high
            chars += int(np.count_nonzero(_heads(self.data[low:end])))
            if left < len(at):
                return end, chars
            left, low = left - len(at), high


def _transform(unit: str, step: int, markers: tuple[str, str, str]):
    before, after, between = (m.encode() for m in markers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            size = 0
            for doc, text, form, h1, h2 in zip(*(c.to_pylist() for c in batch.select(["doc_id", "text", "form", "h1", "h2"]).columns), strict=True):
                index = Index(text, unit, step)
                if form == "plain":
                    held.append((doc, index.n, form, None, None, text))
                else:
                    (a, chars_a), (b, chars_b) = map(index.locate, sorted((h1 % (index.n + 1), h2 % (index.n + 1))))
                    prefix, middle, suffix = text[:a], text[a:b], text[b:]
                    parts = (before, prefix, after, suffix, between, middle) if form == "psm" else (after, suffix, before, prefix, between, middle)
                    held.append((doc, index.n, form, chars_a, chars_b - chars_a, b"".join(parts)))
                size += len(text)
                if size >= _STEP_BYTES:
                    yield _batch(held)
                    held, size = [], 0
            if held:
                yield _batch(held)

    return run


_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _batch(held: list[tuple]) -> pa.RecordBatch:
    doc, n, form, prefix, middle, output = zip(*held, strict=True)
    cols = [pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def transform(
    docs: DataFrame, unit: str = "char", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, salt: str = "1", markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), step: int = STEP
) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("doc_id").cast("long").cast("string")), 256)
    h = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    plain = F.col("doc_id").isNull() | (text == "") | (h[2] % 100 >= rate)
    for m in markers:
        plain = plain | F.contains(text, F.lit(m))
    form = F.when(plain, "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"), form.alias("form"), h[0].alias("h1"), h[1].alias("h2"))
    return own.mapInArrow(_transform(unit, step, markers), _SCHEMA)


def restore(output: Column, form: Column, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that an output was made of. Markers don't occur in a cut text, so an output has each once."""
    any_marker = "|".join("".join(c if c.isalnum() else f"\\{c}" for c in m) for m in markers)
    part = F.split(output, any_marker, -1)
    psm = F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2)))
    spm = F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
