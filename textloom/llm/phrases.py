r"""Phrase collocation mining: sketch bounds give candidates, automata count them, exact thresholds decide.

Texts have A-Z lower-cased, are split at `[.,;:!?\x0A-\x0D]` into pieces and those into words `[^\x20\x09]+`; phrases are
runs of 2 to `LONGEST` words of a piece, and everything is counted apart for each lang. Steps:

1. Words are counted exactly. Only runs of words with `least` occurrences can be phrases with as many; which words these
   are travels as a filter of fixed size (2^24 bits).
2. Each task counts the runs in a sketch of two rows of hashed counters, first those of two words and then, of the longer ones,
   only those whose pairs can all have `least` occurrences, so that rare runs don't fill it. Counters are cut off at `least` and added up in a
   tree; what remains is one bit a counter: whether its sum, an upper bound of the counts of all runs that fall on it,
   reaches `least`. A run is a candidate if the bits of all runs within it, its own included, are set: no phrase with
   `least` occurrences can be missing.
3. The distinct candidates are compiled into Aho-Corasick automata, for each lang in shards of bounded size. Patterns begin
   and end with a blank and pieces are parted by a comma, which no word has, so that only whole words match. Tasks scan
   their texts with each shard's automaton and count all matches, overlapping ones too; the counts are summed.
4. `least` is applied to the exact counts; a candidate's counts and those of its parts give its score.

Bounds: filter and sketch have fixed sizes. Up to PHRASES * SCANS candidates are broadcast; every scan
reads all texts, so their number is fixed; if more are left, their runs' counts are shuffled instead of scanned for, with the same result.
Joins with parts of phrases salt the parts that many candidates share; the best of each lang are found in salted groups
first. No step gathers a lang's candidates.

Scores are exact: floor(1000 * a * n / (l * r)) is taken in 38 decimal digits.

Defined results: a null text is empty, a null lang `und`. Texts without words give nothing; an empty table gives an empty
result. Repeated rows and null ids count like any others. Equal scores and counts go by the phrase in byte order, equal
cuts to the shorter first part. Very long texts are counted whole, in steps that end between pieces. Candidates of one step
are told apart by 64 bits of hash. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm._shared import cut, skew_join
from textloom.llm.hashing import mix, word_hashes

LONGEST = 5
LEAST = 100
#: A candidate goes if a longer one that holds its words has at least so many hundredths of its occurrences.
COVERED = 100
TOP = 2000
#: Bits of the word filter, counters of each of the sketch's two rows, and the number of parts they travel in.
FILTER_BITS, ROW, PARTS = 24, 1 << 24, 64
#: Counters have 16 bits: after so many runs they are cut off at `least` again.
_RUNS = 1 << 15
#: Sketches are added up in groups of so many.
FAN_IN = 64
#: Candidates of a shard, and shards of a lang that texts are scanned for at most; beyond that counts are shuffled.
PHRASES, SCANS = 60_000, 4
_SALTS = 64
_STEP_BYTES = 1 << 18
#: Counts that a scan's tasks hand on in one row.
_BLOCK = 4096
#: Entries of a task's tables of words and phrases before they are handed on.
_HELD = 100_000
#: Hashes of candidates that a task has handed on and remembers, about 70 bytes each.
_SEEN = 500_000

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_NORMAL = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + _BREAKS, b"abcdefghijklmnopqrstuvwxyz " + b"," * len(_BREAKS))
_IS_BREAK, _IS_GAP = np.zeros(256, bool), np.zeros(256, bool)
_IS_BREAK[44] = True
_IS_GAP[[32, 44]] = True


def _source(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), F.col("text").cast("string").cast("binary").alias("text")).filter("text is not null")


def _few(source: DataFrame) -> DataFrame:
    """No more tasks than keep the cluster busy, for what a task sends however much it reads: sketches, distinct candidates."""
    return source.coalesce(max(8, 2 * source.sparkSession.sparkContext.defaultParallelism))


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list[bytes]]]:
    """Normalized texts by lang: words are parted by blanks, pieces by commas. Long texts are cut at commas or else stay whole."""
    own: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py().translate(_NORMAL)
            begin = 0
            while begin < len(text):
                end = len(text)
                if end - begin > _STEP_BYTES:
                    end = text.find(b",", begin + _STEP_BYTES) + 1 or end
                own.setdefault(lang, []).append(text[begin:end])
                size += end - begin
                begin = end
                if size >= _STEP_BYTES:
                    yield own
                    own, size = {}, 0
    if own:
        yield own


#: The automata that a worker has built, by scan.
_built: dict[str, dict] = {}


# --- words


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _built.clear()  # a worker may still have another query's automata
    held: dict[str, Counter] = {}
    for own in _steps(batches):
        for lang, texts in own.items():
            held.setdefault(lang, Counter()).update(b" ".join(texts).replace(b",", b" ").split())
        if sum(map(len, held.values())) > _HELD:
            yield from _counted(held)
    yield from _counted(held)
    pa.default_memory_pool().release_unused()


def _counted(held: dict[str, dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
    for lang, counts in held.items():
        phrases, n = list(counts), list(counts.values())
        for lo in range(0, len(n), 50_000):
            own = phrases[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own, pa.binary()).cast(pa.string()), pa.array(n[lo : lo + 50_000], pa.int64())], ["lang", "phrase", "n"])
    held.clear()


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, phrase (one word), n of all words."""
    return _source(docs).mapInArrow(_count_words, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


# --- runs of frequent words


def _seed(lang: str) -> np.uint64:
    return word_hashes([lang.encode().hex().encode()])[0].sum(dtype=np.uint64)


def _word_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by_lang: dict[str, list[str]] = {}
        for lang, word in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(word)
        for lang, words in by_lang.items():
            h, _ = word_hashes([" ".join(words).encode()], _IS_GAP)
            bit = (mix(h ^ _seed(lang)) >> np.uint64(64 - FILTER_BITS)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bit >> FILTER_BITS - 6), pa.array(bit)], ["part", "bit"])


def _pack_bits(table: pa.Table) -> pa.Table:
    size = 1 << FILTER_BITS - 6
    bits = np.zeros(size, bool)
    bits[table.column("bit").to_numpy() % size] = True
    return pa.table([table.column("part").slice(0, 1), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["part", "bits"])


def _gathered(parts: list, n: int, size: int) -> np.ndarray:
    """Packed bits of all parts; those that are missing are zero."""
    out = np.zeros((n, size // 8), np.uint8)
    for r in parts:
        out[r.part] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def _is_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


class _Runs:
    """Words of the texts of one lang, and the counters of the runs of k frequent words that begin at each."""

    def __init__(self, lang: str, texts: list[bytes], frequent: np.ndarray, pairs: np.ndarray | None = None):
        self.joined = b",".join(texts)
        raw = np.frombuffer(self.joined, np.uint8)
        gap = np.concatenate([[True], _IS_GAP[raw], [True]])
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        self.first, self.last = edge[0::2], edge[1::2]
        piece = np.cumsum(_IS_BREAK[raw])[self.first] if len(raw) else np.zeros(0, np.int64)
        self.words = mix(word_hashes([self.joined], _IS_GAP)[0] ^ _seed(lang))
        known = _is_set(frequent, (self.words >> np.uint64(64 - FILTER_BITS)).astype(np.int64))
        # next[i]: words i and i + 1 are frequent words of one piece, and their pair has its bits set
        self.next = known[1:] & known[:-1] & (piece[1:] == piece[:-1])
        if pairs is not None:
            at = np.flatnonzero(self.next)
            self.next[at] = np.logical_and(*(_is_set(pairs, c) for c in _counters(self.hashes(2, at))))

    def hashes(self, k: int, begins: np.ndarray) -> np.ndarray:
        """Hashes of the runs of k words from `begins` on."""
        h = np.full(len(begins), k, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k):
                h = (h ^ self.words[begins + j]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
        return mix(h)

    def begins(self, longest: int) -> Iterator[tuple[int, np.ndarray]]:
        """(k, places where runs of k words begin), shorter ones first."""
        whole = self.next
        for k in range(2, longest + 1):
            at = np.flatnonzero(whole)
            if not len(at):
                return
            yield k, at
            whole = whole[:-1] & self.next[k - 1 :]

    def candidates(self, longest: int, bits: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, places, hashes) of the runs whose every part of two words or more has its bits set (those of pairs were seen to)."""
        before = None
        for k, at in self.begins(longest):
            if before is not None:
                at = at[before[at] & before[at + 1]]
            h = self.hashes(k, at)
            passed = np.logical_and(*(_is_set(bits, c) for c in _counters(h))) if k > 2 else np.ones(len(at), bool)
            before = np.zeros(len(self.words), bool)
            before[at[passed]] = True
            yield k, at[passed], h[passed]


def _counters(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The counters of hashed runs in both rows."""
    mask = np.uint64(ROW - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64) + ROW


def _sketch(frequent, least: int, longest: int, pairs):
    kind = np.uint8 if least < 256 else np.uint16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * ROW, np.uint16)
        for own in _steps(batches):
            for lang, texts in own.items():
                runs = _Runs(lang, texts, frequent.value, pairs and pairs.value)
                for k, at in runs.begins(longest):
                    if pairs and k == 2:
                        continue
                    for counters in _counters(runs.hashes(k, at)):
                        for lo in range(0, len(counters), _RUNS):
                            part = counters[lo : lo + _RUNS]
                            np.add.at(counts, part, np.uint16(1))
                            counts[part] = np.minimum(counts[part], np.uint16(least))
        if counts.any():
            task = TaskContext.get().partitionId()
            for i, part in enumerate(np.split(counts, PARTS)):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([task], pa.int32()), pa.array([part.astype(kind).tobytes()], pa.binary())], ["part", "task", "counts"])

    return run


def _add(least: int):
    kind = np.uint8 if least < 256 else np.uint16

    def run(table: pa.Table) -> pa.Table:
        total = np.zeros(2 * ROW // PARTS, np.uint32)
        for c in table.column("counts"):
            total = np.minimum(total + np.frombuffer(c.as_py(), kind), np.uint32(least))
        return pa.table([table.column("part").slice(0, 1), table.column("task").slice(0, 1), pa.array([total.astype(kind).tobytes()], pa.binary())], names=["part", "task", "counts"])

    return run


def _reached(least: int):
    kind = np.uint8 if least < 256 else np.uint16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [np.packbits(np.frombuffer(c, kind) >= least).tobytes() for c in b.column("counts").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("part"), pa.array(bits, pa.binary())], ["part", "bits"])

    return run


def sketch(docs: DataFrame, frequent, least: int = LEAST, longest: int = LONGEST, pairs=None) -> np.ndarray:
    """The packed bits of both rows: whether a counter reaches `least`. With the bits of pairs, only longer runs are counted."""
    source = _few(_source(docs))
    tasks = source.rdd.getNumPartitions()
    schema = "part int, task int, counts binary"
    sums = source.mapInArrow(_sketch(frequent, least, longest, pairs), schema)
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        sums = sums.withColumn("group", F.pmod("task", F.lit(tasks))).groupBy("part", "group").applyInArrow(_add(least), schema)
    bits = sums.groupBy("part").applyInArrow(_add(least), schema).mapInArrow(_reached(least), "part int, bits binary").collect()
    return _gathered(bits, PARTS, 2 * ROW // PARTS)


def _find(frequent, pairs, bits, longest: int, counted: bool):
    """The candidates of a task: once each, or with their counts. What a task holds is bounded; beyond that some come again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, set[int]] = {}
        held: dict[str, Counter] = {}
        for own in _steps(batches):
            for lang, texts in own.items():
                runs, known, counts = _Runs(lang, texts, frequent.value, pairs.value), seen.setdefault(lang, set()), held.setdefault(lang, Counter())
                for k, at, hashes in runs.candidates(longest, bits.value):
                    each, one, n = np.unique(hashes, return_index=True, return_counts=True)
                    for h, p, c in zip(each.tolist(), at[one].tolist(), n.tolist(), strict=True):
                        if counted or h not in known:
                            known.add(h)
                            counts[b" ".join(runs.joined[runs.first[p] : runs.last[p + k - 1]].split())] += c
            if not counted or sum(map(len, held.values())) > _HELD:
                yield from _counted(held)
            if counted or sum(map(len, seen.values())) > _SEEN:
                seen.clear()
        yield from _counted(held)
        pa.default_memory_pool().release_unused()

    return run


# --- automata

def _automata(token: str, shard: dict[str, tuple[int, list[str]]]) -> dict:
    """The automaton of each lang, and its phrases' first place and number; a worker keeps those of one shard."""
    if token not in _built:
        import ahocorasick

        _built.clear()
        made = {}
        for lang, (first, phrases) in shard.items():
            a = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for i, p in enumerate(phrases):
                a.add_word(f" {p} ", i)
            a.make_automaton()
            made[lang] = a, first, len(phrases)
        _built[token] = made
    return _built[token]


def _scan(token: str, shard):
    """A task's counts of all phrases of a shard, in blocks: its output is as large however much it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = _automata(token, shard.value)
        counts = {lang: np.zeros(n, np.int64) for lang, (_, _, n) in automata.items()}
        for own in _steps(batches):
            for lang, texts in own.items():
                if lang in automata:
                    words = b" ".join(b",".join(texts).replace(b",", b" , ").split())
                    found = np.fromiter(map(itemgetter(1), automata[lang][0].iter(f" {words.decode()} ")), np.int64)
                    counts[lang] += np.bincount(found, minlength=len(counts[lang]))
        for lang, (_, first, n) in automata.items():
            for lo in range(0, n, _BLOCK):
                part = counts[lang][lo : lo + _BLOCK]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([first + lo], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["place", "counts"])

    return run


def _add_scans(ids):
    """id, n of the phrases of a block that occur."""

    def run(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c.as_py(), np.int64) for c in table.column("counts"))
        at = np.flatnonzero(total)
        return pa.table([pa.array(ids.value[table.column("place")[0].as_py() + at]), pa.array(total[at])], names=["id", "n"])

    return run


def scan(docs: DataFrame, candidates: DataFrame, phrases: int = PHRASES) -> DataFrame:
    """lang, phrase, a: all occurrences of the candidates (id, lang, phrase), of which the driver and every task can hold all and `phrases`."""
    spark = docs.sparkSession
    got = candidates.orderBy("lang", "phrase").select("id", "lang", "phrase").toArrow()
    ids, langs, texts = got.column("id").to_numpy(), got.column("lang").to_pylist(), got.column("phrase").to_pylist()
    counts = None
    for lo in range(0, len(ids), phrases):
        shard: dict[str, tuple[int, list[str]]] = {}
        own = langs[lo : lo + phrases]
        for lang in dict.fromkeys(own):
            a = lo + own.index(lang)
            shard[lang] = a, texts[a : a + own.count(lang)]
        source = _few(_source(docs).filter(F.col("lang").isin(list(shard))))
        part = source.mapInArrow(_scan(uuid.uuid4().hex, spark.sparkContext.broadcast(shard)), "place long, counts binary")
        counts = part if counts is None else counts.unionByName(part)
    if counts is None:
        return candidates.select("lang", "phrase", F.lit(0).cast("long").alias("a")).limit(0)
    summed = counts.groupBy("place").applyInArrow(_add_scans(spark.sparkContext.broadcast(ids)), "id long, n long")
    return summed.join(candidates, "id").select("lang", "phrase", F.col("n").alias("a"))


# --- scores


def frequencies(docs: DataFrame, words: DataFrame, least: int = LEAST, longest: int = LONGEST, phrases: int = PHRASES, scans: int = SCANS) -> DataFrame:
    """lang, phrase, a of all phrases of 2 to `longest` words with `least` occurrences; words: those of word_counts()."""
    if not 0 < least < 1 << 15:
        raise ValueError("least must fit a counter")
    spark = docs.sparkSession
    parts = words.filter(F.col("n") >= least).select("lang", "phrase").mapInArrow(_word_bits, "part int, bit int").distinct().groupBy("part").applyInArrow(_pack_bits, "part int, bits binary").collect()
    frequent = spark.sparkContext.broadcast(_gathered(parts, 64, 1 << FILTER_BITS - 6))
    pairs = spark.sparkContext.broadcast(sketch(docs, frequent, least, 2))
    bits = spark.sparkContext.broadcast(sketch(docs, frequent, least, longest, pairs))
    found = lambda counted: _few(_source(docs)).mapInArrow(_find(frequent, pairs, bits, longest, counted), "lang string, phrase string, n long")
    candidates = cut(found(False).select("lang", "phrase").distinct().withColumn("id", F.monotonically_increasing_id()))
    if candidates.count() <= phrases * scans:
        counted = scan(docs, candidates, phrases)
    else:
        counted = found(True).groupBy("lang", "phrase").agg(F.sum("n").alias("a"))
    return counted.filter(F.col("a") >= least)


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, covered: int = COVERED, top: int = TOP, phrases: int = PHRASES, scans: int = SCANS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's `top` phrases."""
    words = cut(word_counts(docs))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    f = cut(frequencies(docs, words, least, longest, phrases, scans))
    counts = f.unionByName(words.filter(F.col("n") >= least).select("lang", "phrase", F.col("n").alias("a"))).select(_key("lang", "phrase").alias("key"), F.col("a").alias("part_a"))
    w = F.split("phrase", " ", -1)
    k = F.sequence(F.lit(1), F.size(w) - 1)
    sides = F.flatten(F.transform(k, lambda i: F.array(
        F.struct(i.alias("k"), F.lit(0).alias("side"), F.array_join(F.slice(w, F.lit(1), i), " ").alias("part")),
        F.struct(i.alias("k"), F.lit(1).alias("side"), F.array_join(F.slice(w, i + 1, F.size(w)), " ").alias("part")),
    )))
    parts = f.select("lang", "phrase", "a", F.inline(sides)).select("lang", "phrase", "a", "k", "side", _key("lang", "part").alias("key"))
    uses = parts.groupBy("key").agg(F.count("*").alias("uses"))
    total = f.agg(F.coalesce(F.sum(2 * (F.size(w) - 1)), F.lit(0))).first()[0]
    joined = skew_join(parts, cut(uses.join(counts, "key")), "key", "uses", total, F.struct("lang", "phrase", "k", "side"))
    each = joined.groupBy("lang", "phrase", "a").agg(F.collect_list(F.struct("side", "k", F.col("part_a").alias("c"))).alias("s"))  # 2 * (longest - 1) at most
    each = each.select("lang", "phrase", "a", F.array_sort(F.filter("s", lambda x: x["side"] == 0)).alias("left"), F.array_sort(F.filter("s", lambda x: x["side"] == 1)).alias("right"))
    lang_count = totals.count()
    each = each.join(F.broadcast(totals) if lang_count <= 100_000 else totals, "lang")
    big = lambda c: c.cast("decimal(38,0)")
    cuts = F.zip_with("left", "right", lambda x, y: F.struct(F.call_function("div", F.lit(1000).cast("decimal(38,0)") * big(F.col("a")) * big(F.col("n")), big(x["c"]) * big(y["c"])).alias("score"), x["k"].alias("k"), x["c"].alias("l"), y["c"].alias("r")))
    scored = each.select("lang", "phrase", "a", "n", F.array_min(cuts).alias("c")).select("lang", "phrase", "a", "n", "c.l", "c.r", F.col("c.score").cast("long").alias("score"))
    # a longer phrase has no more occurrences than those within it, so that one more word is enough to look at
    inner = f.filter(F.size(w) > 2).select("lang", F.col("a").alias("longer"), F.explode(F.array(F.array_join(F.slice(w, F.lit(1), F.size(w) - 1), " "), F.array_join(F.slice(w, F.lit(2), F.size(w) - 1), " "))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _key(*cols: str):
    return F.concat_ws("\n", *cols)
