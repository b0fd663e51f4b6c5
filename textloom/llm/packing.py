"""Hierarchical residual packing of token sequences.

Each partition tokenizes its documents, cuts the longer ones into pieces and packs the pieces best-fit; bins that are
full up to a small slack are final. The underfull bins, as (bin, fill) items, go through a tree of merges: groups of
ever more partitions pack them best-fit again, until one group is left. Only these items move between tasks; their
pieces are placed by one join on the bin at the end.

Tokens are found by white-space separated chunk, with a bounded cache per worker: the tokenizer drops white space and
never looks across it, so a text's ids are its chunks' ids in order (tests compare whole texts).

Defined results: a null text counts as empty, and an empty text is one piece holding the end id only. Repeated rows are
separate documents; a null doc_id stays null. Pieces of equal length go in the order of their rows, and of equally tight
bins the one last filled is taken. Very long texts are tokenized whole, chunk by chunk, and cut into many pieces. An empty
table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._shared import cut
from textloom.llm.hashing import text_steps

CAPACITY = 2048
SLACK = 8
#: Items in one merge task at most; beyond that the last level keeps more than one group.
MERGE_ROWS = 1_000_000
#: Partitions (then groups) whose underfull bins meet in one group of the next level.
FAN_IN = 8
#: Of about 200 bytes each, per Python worker; up to twice as many while older ones are dropped.
_CACHE_ENTRIES = 700_000
_TRAILING = b".,;:!?|#*$%&"

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill int"


class _Chunks(dict):
    """Ids by chunk. When it is full, the chunks since then replace the older ones; those in use move over."""

    def __init__(self, tokenizer, entries: int):
        super().__init__({b"": b""})
        self.tokenizer, self.entries, self.older = tokenizer, entries, {}

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= self.entries:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(chunk)
        if ids is None:
            word = chunk.rstrip(_TRAILING)
            # after a letter or digit, a run of punctuation is a token sequence of its own
            if len(word) < len(chunk) and _stays(word):
                ids = self[word] + self[chunk[len(word) :]]
            else:
                ids = np.asarray(self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        self[chunk] = ids
        return ids


def _stays(word: bytes) -> bool:
    """Whether a word ends in a letter or digit of ASCII or Latin script that is one after lower-casing and normalizing, too.

    A dotted capital I isn't: it becomes an i and a combining dot.
    """
    if word[-1:].isalnum():
        return True
    last = word[-4:].decode(errors="ignore")[-1:] if word[-1:] > b"\x7f" else ""
    return "\x80" <= last < "\u0250" and last.isalnum() and len(last.lower()) == 1


class ChunkEncoder:
    """Ids of a text as little-endian unsigned 32-bit bytes.

    A-Z is lower-cased first, as the tokenizer does itself after it has looked for special tokens; texts that may hold
    one go to the tokenizer whole.
    """

    def __init__(self, path: str, entries: int = _CACHE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.chunks = _Chunks(self.tokenizer, entries)

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        for text in texts:
            if b"<|" in text:
                yield np.asarray(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()
            else:
                yield b"".join(map(self.chunks.__getitem__, text.lower().replace(b"\n", b" ").split(b" ")))


#: The encoder that a worker keeps.
_encoders: dict[tuple[str, int], ChunkEncoder] = {}


def _encoder(path: str, entries: int) -> ChunkEncoder:
    if (path, entries) not in _encoders:
        _encoders.clear()
        _encoders[path, entries] = ChunkEncoder(path, entries)
    return _encoders[path, entries]


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best-fit decreasing: each item's bin and offset there, and the bins' fills.

    A bit set of the free rooms that occur finds the tightest bin in constant time.
    """
    order = np.argsort(-sizes, kind="stable")
    into, at = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    fills: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in order.tolist():
        size = int(sizes[i])
        above = rooms >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        into[i], at[i] = b, fills[b]
        fills[b] += size
        if left := room - size:
            by_room[left].append(b)
            rooms |= 1 << left
    return into, at, fills


def _local(path: str, capacity: int, end_id: int, rows: int, entries: int):
    """Tokenize and pack one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what a worker's earlier stages have left
        encoder, end = _encoder(path, entries), np.asarray([end_id], "<u4").tobytes()
        first = TaskContext.get().partitionId() << 36
        held: list[tuple[int, int, int, int, int]] = []

        def flush() -> pa.RecordBatch:
            nonlocal first
            docs, *rest = zip(*held, strict=True)
            cols = [None, *(np.asarray(c, np.int64) for c in rest)]
            into, at, fills = best_fit(cols[3], capacity)
            out = pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(cols[1].astype(np.int32)), *map(pa.array, cols[2:]), pa.array(into + first), pa.array(at), pa.array(np.asarray(fills, np.int32)[into])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill"],
            )
            first += len(fills)
            held.clear()
            return out

        for docs, texts in text_steps(batches):
            for doc, ids in zip(docs, encoder.encode(texts), strict=True):
                ids = memoryview(ids + end)
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[start : start + 4 * capacity]
                    held.append((doc, piece, start // 4, len(own) // 4, zlib.crc32(own)))
            if len(held) >= rows:
                yield flush()
        if held:
            yield flush()

    return run


def _merge(capacity: int):
    def run(pdf):
        into, at, fills = best_fit(pdf["fill"].to_numpy(), capacity)
        low = np.full(len(fills), np.iinfo(np.int64).max)
        np.minimum.at(low, into, pdf["bin"].to_numpy())  # a merged bin is called after the least of its parts
        return pdf.assign(into=low[into], base=at, into_fill=np.asarray(fills, np.int64)[into])[["bin", "into", "base", "into_fill"]]

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, slack: int = SLACK, rows: int = 500_000, merge_rows: int = MERGE_ROWS, entries: int = _CACHE_ENTRIES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    entries: chunks in a worker's cache of ids. Fewer take less memory and more time, with the same rows.
    """
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    groups = source.rdd.getNumPartitions()
    pieces = cut(source.mapInArrow(_local(tokenizer, capacity, end_id, rows, entries), _PIECES))
    items = cut(pieces.filter(F.col("fill") < capacity - slack).groupBy("bin").agg(F.first("fill").cast("long").alias("fill")))
    where = items.select("bin", F.col("bin").alias("into"), F.lit(0).cast("long").alias("base"))
    n = items.count()
    while n > 1:
        groups = max(-(-groups // FAN_IN), -(-n // merge_rows))
        level = cut(
            items.withColumn("g", F.pmod(F.xxhash64("bin"), F.lit(groups)))
            .groupBy("g").applyInPandas(_merge(capacity), "bin long, into long, base long, into_fill long")
        )
        moved = level.select(F.col("bin").alias("_b"), F.col("into").alias("_into"), F.col("base").alias("_base"))
        where = where.join(moved, where["into"] == moved["_b"], "left").select(
            "bin", F.coalesce("_into", "into").alias("into"), (F.col("base") + F.coalesce("_base", F.lit(0))).alias("base")
        )
        items = level.filter(F.col("into_fill") < capacity - slack).groupBy(F.col("into").alias("bin")).agg(F.first("into_fill").alias("fill"))
        n = items.count()
        if groups == max(1, -(-n // merge_rows)):
            break
    return pieces.join(where, "bin", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("into", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset")
    )
