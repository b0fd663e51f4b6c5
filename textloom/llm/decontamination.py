"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are sequences of words (white space and ASCII punctuation separate them, A-Z lower-cased).
Seeds are runs of `min_match` words, hashed by rolling sums (running Karp-Rabin); the seeds of a document are joined to
the sorted seeds of the benchmark. Seeds on one diagonal join to maximal matches, and tiling marks the longest match of
unmarked words again and again, on both sides, so passages in another order count in full and no word counts twice. A
document is contaminated by an item if the tiles cover at least `coverage` of the item's words; pairs whose seeds could not
cover so many are left out before tiling.

Where a text repeats seeds that an item repeats too, the places of its matches are as many as the product of both. Over
`MOST_PLACES` they aren't listed: the longest common run of unmarked words is found by binary search over its length, with
Karp-Rabin hashes of all runs of that length on either side, which takes memory in proportion to the two texts and gives
the same tiles.

The benchmark's index is broadcast in chunks of at most `chunk_words` words (24 bytes each), a bound that is checked;
a larger benchmark takes several passes. A pass adds its matches to the rows as they are, so rows are the same whatever
the number of chunks; after every few passes they are written to the checkpoint folder. An item with fewer words than
min_match is one seed of all its words.

Defined results: null and empty texts, and items without words or id, match nothing. Rows are judged one by one, repeated
rows and null ids included; repeated items too, and item_ids names an id once. Among equally long matches that which begins
first in the item, then in the document, is marked first; items of equal coverage come by id. Very long texts are compared
whole, in one step of their own size. Empty tables give no matches. Extra columns are ignored by matches() and kept by clean().
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._shared import cut
from textloom.llm.hashing import SPACES_AND_PUNCTUATION, run_hashes, shingle_hashes, text_steps, word_hashes

MIN_MATCH = 5
COVERAGE = 0.5
CHUNK_WORDS = 2_000_000
#: Places of matches of one text that are listed at once.
MOST_PLACES = 1_000_000
#: Passes that run in one stage, each with a chunk in its worker's memory.
_PASSES = 4


def tile(matches: list[tuple[int, int, int]], min_match: int) -> int:
    """Words of the item covered by greedy tiling of maximal matches (start in item, start in document, length)."""
    heap = [(-n, i, d) for i, d, n in matches]
    heapq.heapify(heap)
    item: set[int] = set()
    doc: set[int] = set()
    while heap:
        n, i, d = heapq.heappop(heap)
        run = 0
        parts = []
        for j in range(-n + 1):
            if j < -n and i + j not in item and d + j not in doc:
                run += 1
            else:
                if run >= min_match:
                    parts.append((i + j - run, d + j - run, run))
                run = 0
        if parts == [(i, d, -n)]:
            item.update(range(i, i - n))
            doc.update(range(d, d - n))
        else:
            for a, b, m in parts:
                heapq.heappush(heap, (-m, a, b))
    return len(item)


def _common(item: np.ndarray, doc: np.ndarray, free_item: np.ndarray, free_doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places in item with a free run of n words that doc has too, their hashes; hashes of doc's free runs, sorted, and their places)."""
    i, d = np.flatnonzero(_window_sums(free_item, n) == n), np.flatnonzero(_window_sums(free_doc, n) == n)
    hi, hd = run_hashes(item, n)[i], run_hashes(doc, n)[d]
    order = np.argsort(hd, kind="stable")
    hd, d = hd[order], d[order]
    at = np.searchsorted(hd, hi)
    there = (at < len(hd)) & (hd[np.minimum(at, max(len(hd) - 1, 0))] == hi) if len(hd) else np.zeros(len(hi), bool)
    return i[there], hi[there], hd, d


def _window_sums(x: np.ndarray, n: int) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    return sums[n:] - sums[:-n]


def tile_words(item: np.ndarray, doc: np.ndarray, free: np.ndarray, min_match: int) -> int:
    """What tile() gives for all matches of two sequences of word hashes; free: the words of doc that take part."""
    free_item, free_doc = np.ones(len(item), np.int64), free.astype(np.int64)
    most = min(len(item), len(doc))
    while most >= min_match:
        low, high = min_match - 1, most
        while low < high:  # the longest run that both have, of unmarked words; a shorter one is part of it
            n = (low + high + 1) // 2
            low, high = (n, high) if len(_common(item, doc, free_item, free_doc, n)[0]) else (low, n - 1)
        if low < min_match:
            break
        places, hashes, sorted_hashes, of_doc = _common(item, doc, free_item, free_doc, low)
        at = dict(zip(hashes.tolist(), np.searchsorted(sorted_hashes, hashes).tolist(), strict=True))
        last = len(of_doc)
        for i, h in zip(places.tolist(), hashes.tolist(), strict=True):
            # tiles of this round have one length, so an overlap shows at an end
            if not (free_item[i] and free_item[i + low - 1]):
                continue
            p = at[h]
            while p < last and sorted_hashes[p] == h and not (free_doc[of_doc[p]] and free_doc[of_doc[p] + low - 1]):
                p += 1
            at[h] = p
            if p < last and sorted_hashes[p] == h:
                free_item[i : i + low] = 0
                free_doc[of_doc[p] : of_doc[p] + low] = 0
        most = low - 1
    return int(len(item) - free_item.sum())


class SeedIndex:
    """Seeds of one chunk of the benchmark by length, sorted by hash: length -> (hashes, items, positions)."""

    def __init__(self, ids: list[int], texts: list[bytes], min_match: int, most_places: int = MOST_PLACES):
        self.words, self.starts = word_hashes(texts, SPACES_AND_PUNCTUATION)
        self.ids, self.lengths, self.min_match, self.most_places = np.asarray(ids, np.int64), np.diff(self.starts), min_match, most_places
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in sorted({min(min_match, int(n)) for n in self.lengths if n}):
            mine = np.flatnonzero(self.lengths >= min_match if k == min_match else self.lengths == k)
            own = np.concatenate([self.words[self.starts[i] : self.starts[i + 1]] for i in mine])
            begins = np.concatenate([[0], np.cumsum(self.lengths[mine])])
            hashes, at = shingle_hashes(own, begins, k)
            item = np.repeat(mine, np.diff(at))
            place = np.arange(len(hashes)) - np.repeat(at[:-1], np.diff(at))
            order = np.argsort(hashes, kind="stable")
            self.by_length[k] = hashes[order], item[order].astype(np.int32), place[order].astype(np.int32)

    def covered(self, texts: list[bytes], coverage: float) -> Iterator[tuple[int, int, int]]:
        """(text, item, covered words) of all pairs whose tiles cover at least so much of the item."""
        words, starts = word_hashes(texts, SPACES_AND_PUNCTUATION)
        for k, (seeds, _, _) in self.by_length.items():
            hashes, at = shingle_hashes(words, starts, k)
            low, high = np.searchsorted(seeds, hashes, "left"), np.searchsorted(seeds, hashes, "right")
            hit = np.flatnonzero(high > low)
            text_of = np.searchsorted(at, hit, "right") - 1
            long_enough = np.diff(starts)[text_of] >= k
            hit, text_of = hit[long_enough], text_of[long_enough]
            cuts = np.flatnonzero(np.concatenate([[True], text_of[1:] != text_of[:-1], [True]])) if len(hit) else np.zeros(1, np.int64)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                t, own = int(text_of[a]), hit[a:b]
                each = high[own] - low[own]
                if each.sum() <= self.most_places:
                    found = self._listed(k, own - at[t], low[own], each, coverage)
                else:
                    found = self._unlisted(k, words[starts[t] : starts[t + 1]], own - at[t], low[own], high[own], coverage)
                for item, n in found:
                    if n >= coverage * int(self.lengths[item]):
                        yield t, item, n

    def _listed(self, k: int, d: np.ndarray, low: np.ndarray, each: np.ndarray, coverage: float) -> Iterator[tuple[int, int]]:
        _, items, places = self.by_length[k]
        row = np.repeat(low, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        d = np.repeat(d, each)
        i, item = places[row].astype(np.int64), items[row].astype(np.int64)
        order = np.lexsort((d, d - i, item))
        d, i, item = d[order], i[order], item[order]
        # seeds that follow each other on one diagonal are one maximal match
        new = np.concatenate([[True], (item[1:] != item[:-1]) | (d[1:] != d[:-1] + 1) | (i[1:] != i[:-1] + 1)])
        first = np.flatnonzero(new)
        size = np.diff(np.concatenate([first, [len(d)]])) + k - 1
        cut_at = np.flatnonzero(np.concatenate([[True], item[first][1:] != item[first][:-1], [True]]))
        for a, b in zip(cut_at[:-1].tolist(), cut_at[1:].tolist(), strict=True):
            one = first[a:b]
            if size[a:b].sum() >= coverage * self.lengths[item[one[0]]]:
                yield int(item[one[0]]), tile(list(zip(i[one].tolist(), d[one].tolist(), size[a:b].tolist(), strict=True)), k)

    def _unlisted(self, k: int, words: np.ndarray, d: np.ndarray, low: np.ndarray, high: np.ndarray, coverage: float) -> Iterator[tuple[int, int]]:
        """The same of a text whose seeds have very many places: item by item, never listing pairs of places."""
        _, items, places = self.by_length[k]
        order = np.argsort(low, kind="stable")
        d, low, high = d[order], low[order], high[order]
        seed = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))  # distinct seeds: ranges of the index
        ends = np.concatenate([seed[1:], [len(low)]])
        row = np.concatenate([np.arange(low[s], high[s]) for s in seed])  # at most the index itself
        of = np.repeat(np.arange(len(seed)), high[seed] - low[seed])
        by_item = np.argsort(items[row], kind="stable")
        row, of = row[by_item], of[by_item]
        cuts = np.flatnonzero(np.concatenate([[True], items[row][1:] != items[row][:-1], [True]]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            item = int(items[row[a]])
            i = np.sort(places[row[a:b]])
            if len(i) + (k - 1) * (1 + np.count_nonzero(np.diff(i) > 1)) < coverage * self.lengths[item]:
                continue
            free = np.zeros(len(words) + 1, np.int64)
            for s in np.unique(of[a:b]).tolist():
                np.add.at(free, d[seed[s] : ends[s]], 1)
                np.add.at(free, d[seed[s] : ends[s]] + k, -1)
            free = np.cumsum(free)[:-1] > 0
            # words outside the item's seeds match nothing: runs of them shrink to one
            kept = free | np.concatenate([[False], free[:-1]])
            yield item, tile_words(self.words[self.starts[item] : self.starts[item + 1]], words[kept], free[kept], k)


def _search(index, coverage: float, keep_text: bool):
    """Adds one chunk's matches to rows (doc_id, text, matches), whatever their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds: SeedIndex = index.value
        for batch in batches:
            found = batch.column(2).to_pylist()
            place = pa.array(range(batch.num_rows), pa.int64())
            for at, texts in text_steps(iter([pa.RecordBatch.from_arrays([place, batch.column(1)], ["at", "text"])])):
                for t, item, n in seeds.covered(texts, coverage):
                    found[at[t]].append({"item_id": int(seeds.ids[item]), "covered": n, "words": int(seeds.lengths[item])})
            for own in found:
                own.sort(key=lambda m: (-m["covered"] / m["words"], m["item_id"]))
            columns = [batch.column(0), batch.column(1), pa.array(found, _MATCHES)]
            names = ["doc_id", "text", "matches"]
            yield pa.RecordBatch.from_arrays(columns, names) if keep_text else pa.RecordBatch.from_arrays(columns[::2], names[::2])

    return run


_MATCHES = pa.list_(pa.struct([("item_id", pa.int64()), ("covered", pa.int64()), ("words", pa.int64())]))
_LIST = "array<struct<item_id: long, covered: long, words: long>>"


def _chunks(benchmark: DataFrame, chunk_words: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """The benchmark by bounded chunks, never held as a whole."""
    ids: list[int] = []
    texts: list[bytes] = []
    words = 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("i"), F.encode(F.col("text").cast("string"), "UTF-8").alias("t"))
    for r in rows.filter("i is not null and t is not null").toLocalIterator():
        t = bytes(r.t or b"")
        ids.append(r.i)
        texts.append(t)
        words += len(t) // 2 + 1
        if words >= chunk_words:
            yield ids, texts
            ids, texts, words = [], [], 0
    if ids:
        yield ids, texts


def matches(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Per document: doc_id, contaminated, item_ids (by coverage, then id), and the best item's covered and total words."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.expr(f"cast(array() as {_LIST})").alias("matches"))
    sc = docs.sparkSession.sparkContext
    chunks = _chunks(benchmark, chunk_words)
    chunk, n = next(chunks, None), 0
    while chunk is not None:
        after = next(chunks, None)
        index, n = sc.broadcast(SeedIndex(*chunk, min_match)), n + 1
        found = found.mapInArrow(_search(index, coverage, after is not None), f"doc_id long, {'text string, ' if after is not None else ''}matches {_LIST}")
        if after is not None and n % _PASSES == 0:
            found = cut(found)
        chunk = after
    best = F.get("matches", 0)
    return found.select(
        "doc_id", (F.size("matches") > 0).alias("contaminated"), F.array_distinct("matches.item_id").alias("item_ids"),
        best["covered"].alias("covered_words"), best["words"].alias("item_words"),
    )


def _drop(index, coverage: float, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds: SeedIndex = index.value
        for batch in batches:
            bad: set[int] = set()
            place = pa.array(range(batch.num_rows), pa.int64())
            for at, texts in text_steps(iter([pa.RecordBatch.from_arrays([place, batch.column(column)], ["at", "text"])])):
                bad.update(at[t] for t, _, _ in seeds.covered(texts, coverage))
            yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_())) if bad else batch

    return run


def clean(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """docs without the contaminated ones, in the given columns. Rows are dropped where they are read: nothing is shuffled."""
    sc = docs.sparkSession.sparkContext
    for i, (ids, texts) in enumerate(_chunks(benchmark, chunk_words)):
        docs = cut(docs) if i and i % _PASSES == 0 else docs
        docs = docs.mapInArrow(_drop(sc.broadcast(SeedIndex(ids, texts, min_match)), coverage, docs.columns.index("text")), docs.schema)
    return docs
