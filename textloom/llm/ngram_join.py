"""N-gram Jaccard join: documents whose sets of word 5-grams are similar, found by a prefix-tree join without sampling.

1. Every text becomes its set of shingle hashes; equal sets are one class with a 64-bit id.
2. All shingles of all classes are counted by hash range: tasks send packed runs of 40-bit codes, after dropping copies
   they see themselves; a range drops the copies that come from different tasks. The number of ranges follows from the
   counted shingles, about `range_codes` a range, so a task's memory is bounded whatever the corpus. Shingles that occur
   in one class only can't be shared, so just the others return to their classes, with their frequency. A class with
   fewer shared shingles than its similarity needs is done; this needs no frequency cap.
3. What is left is ordered by rarity. Two linked classes share a shingle among their rarest (prefix filter), so
   stars over the prefix's postings tie all linked classes into families.
4. A family is joined with a trie of its sets in global order, the most frequent shingles first: one traversal shares
   partial overlaps along common paths, subtrees are cut when the remaining lengths can't reach the overlap needed,
   and, where only components are wanted, subtrees that lie wholly in the set's own component are skipped. A family over
   `block_tokens` is cut by length band and hash into blocks, and every pair of blocks of the same or neighbouring bands
   is one task: sets two bands apart differ too much in length to be linked.
5. Links (a spanning forest of each task's links) and classes give components. To count links, every link is visited and
   added to both classes' counts within the task, weighted by the copies of the other; pairs leave no task.

No step gathers a class, a posting list, a hash range or a family in one task without a bound, and no pairs of copies are made.

Shingles are compared by 40 bits beside the number of their hash range (about 46 bits in all with 64 ranges, more with
more data), so a pair of 20,000-word texts has a chance of about 1 in 100,000 to count one shared shingle too many; class
ids are 64 bits of a set's fingerprint. But for such collisions results are exact.

Defined results: null, empty and white-space texts have the empty set, n_shingles 0, and are linked with nothing.
n_links is the number of other doc_ids that are similar enough, equal sets included. Repeated rows have equal sets and
one class, and count once. Rows with one doc_id but different texts are each judged by their own text. Rows with a null
doc_id are linked with nothing: their n_links is 0 and their component_id null. Ties don't arise: a component is named
after its smallest doc_id. Very long texts are hashed in one step of their own size and are one set. An empty table
gives an empty result. Extra columns are ignored by join() and kept by keep_one().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._shared import components, cut, own_key, shuffle_partitions, skew_join
from textloom.llm.hashing import mix, shingle_hashes, text_steps, word_hashes

N = 5
#: Similarity at least PART / WHOLE.
PART, WHOLE = 75, 100
#: Shared shingles in one task of step 4.
BLOCK_TOKENS = 1_000_000
#: Shingles in one hash range of step 2, on average.
RANGE_CODES = 4_000_000
#: Sets whose sizes are two bands apart have a size ratio over this, which is over WHOLE / PART.
_BAND = 1.34
_BATCH_TOKENS = 1_000_000
_CODE_BITS = 40


def _sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    words, starts = word_hashes(texts)
    hashes, at = shingle_hashes(words, starts, n)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        own = np.sort(hashes[a:b])
        out.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own)
    return out


def _print(own: np.ndarray, doc: int) -> bytes:
    """A set's fingerprint in 16 bytes; an empty set has its document's id in 8."""
    if not len(own):
        return int(doc).to_bytes(8, "little", signed=True)
    with np.errstate(over="ignore"):
        return np.array([mix(own).sum(dtype=np.uint64), mix(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)]).tobytes()


def _class_id(fingerprint: bytes) -> int:
    return int.from_bytes(fingerprint[:8], "little", signed=True)


def _describe(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_steps(batches):
            sets = _sets(texts, n)
            prints = [None if d is None else _print(s, d) for s, d in zip(sets, ids, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array([_class_id(p) if len(s) and p else None for s, p in zip(sets, prints, strict=True)], pa.int64())],
                ["doc_id", "n_shingles", "fp", "class"],
            )

    return run


def _scatter(n: int, ranges: int):
    """Packed shingle codes by hash range: per range the classes, their set sizes and counts there, and the codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, np.ndarray] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            docs = np.array([_class_id(p) for p in held], np.int64)
            sizes = np.array([len(s) for s in held.values()], np.uint32)
            tokens = np.concatenate(list(held.values()))
            owner = np.repeat(np.arange(len(docs)), sizes)
            held.clear()
            size = 0
            part = (tokens % np.uint64(ranges)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            tokens, owner, part = tokens[order] >> np.uint64(64 - _CODE_BITS), owner[order], part[order]
            low, high = tokens.astype(np.uint32), (tokens >> np.uint64(32)).astype(np.uint8)
            cuts = np.searchsorted(part, np.arange(ranges + 1))
            rows: list[list] = [[], [], [], [], [], []]
            for r in np.flatnonzero(np.diff(cuts)).tolist():
                a, b = cuts[r], cuts[r + 1]
                own, counts = np.unique(owner[a:b], return_counts=True)
                for column, value in zip(rows, (r, docs[own].tobytes(), sizes[own].tobytes(), counts.astype(np.uint32).tobytes(), low[a:b].tobytes(), high[a:b].tobytes()), strict=True):
                    column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(c, pa.binary()) for c in rows[1:])], ["part", "docs", "sizes", "counts", "low", "high"])

        for ids, texts in text_steps(batches):
            for doc, own in zip(ids, _sets(texts, n), strict=True):
                if len(own):
                    key = _print(own, doc)
                    if key not in held:
                        held[key] = own
                        size += len(own)
            if size >= _BATCH_TOKENS:
                yield flush()
        if held:
            yield flush()

    return run


def _joined(table: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


def _count(groups: int, ranges: int):
    """Of one hash range: the codes in two classes or more, by group of classes, with their frequency."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        docs, sizes, counts = _joined(table, "docs", np.int64), _joined(table, "sizes", np.uint32), _joined(table, "counts", np.uint32)
        codes = _joined(table, "low", np.uint32).astype(np.uint64) | (_joined(table, "high", np.uint8).astype(np.uint64) << np.uint64(32))
        # tasks that saw the same text sent the same codes: one class counts once
        first = np.zeros(len(docs), bool)
        first[np.unique(docs, return_index=True)[1]] = True
        codes, docs, sizes, counts = codes[np.repeat(first, counts)], docs[first], sizes[first], counts[first]
        order = np.argsort(codes)
        ordered = codes[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        frequency = np.diff(np.concatenate([np.flatnonzero(new), [len(codes)]]))
        df = np.empty(len(codes), np.uint32)
        df[order] = np.repeat(frequency, frequency)
        shared = df > 1
        owner = np.repeat(np.arange(len(docs)), counts)[shared]
        codes, df = codes[shared] * np.uint64(ranges) + np.uint64(part), df[shared]
        group = (docs % np.int64(groups))[owner].astype(np.int32)
        order = np.argsort(group, kind="stable")
        owner, codes, df, group = owner[order], codes[order], df[order], group[order]
        cuts = np.searchsorted(group, np.arange(groups + 1))
        rows: list[list] = [[], [], [], [], [], []]
        for g in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = cuts[g], cuts[g + 1]
            own, n = np.unique(owner[a:b], return_counts=True)
            for column, value in zip(rows, (g, docs[own].tobytes(), sizes[own].tobytes(), n.astype(np.uint32).tobytes(), codes[a:b].tobytes(), df[a:b].tobytes()), strict=True):
                column.append(value)
        return pa.table([pa.array(rows[0], pa.int32()), *(pa.array(c, pa.binary()) for c in rows[1:])], names=["g", "docs", "sizes", "counts", "codes", "dfs"])

    return run


def needed(a, b):
    """The least overlap of sets of sizes a and b that are similar enough."""
    return -(-PART * (a + b) // (WHOLE + PART))


def _candidates(blobs: pa.Table, reps: pa.Table) -> pa.Table:
    """Classes with enough shared shingles: their shared codes, the rarest first, how many are in the prefix, and their documents."""
    docs, sizes, counts = _joined(blobs, "docs", np.int64), _joined(blobs, "sizes", np.uint32), _joined(blobs, "counts", np.uint32)
    codes, dfs = _joined(blobs, "codes", np.uint64), _joined(blobs, "dfs", np.uint32)
    rows: list[list] = [[], [], [], [], []]
    if len(docs) and reps.num_rows:
        copies_of = dict(zip(reps.column("class").to_pylist(), reps.column("docs").to_pylist(), strict=True))
        keep = np.isin(docs, reps.column("class").to_numpy())
        each = np.repeat(keep, counts)
        owner, codes, dfs = np.repeat(docs, counts)[each], codes[each], dfs[each]
        order = np.lexsort((codes, dfs, owner))
        owner, codes = owner[order], codes[order]
        size_of = dict(zip(docs.tolist(), sizes.tolist(), strict=True))
        own, begin, n = np.unique(owner, return_index=True, return_counts=True)
        for doc, a, m in zip(own.tolist(), begin.tolist(), n.tolist(), strict=True):
            size = size_of[doc]
            least = -(-PART * size // WHOLE)
            if m >= least:
                for column, value in zip(rows, (doc, size, codes[a : a + m].astype(np.int64), m - least + 1, copies_of[doc]), strict=True):
                    column.append(value)
    return pa.table([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.list_(pa.int64())), pa.array(rows[3], pa.int32()), pa.array(rows[4], pa.int64())], names=["doc", "size", "codes", "prefix", "copies"])


class _Node:
    __slots__ = ("children", "least", "mixed", "rep", "rest", "segment", "leaf")

    def __init__(self, segment: list[int], rest: int, least: int):
        self.segment, self.rest, self.least = segment, rest, least  # rest: most codes from here on; least: smallest set below
        self.children: dict[int, _Node] = {}
        self.rep = -1
        self.mixed = False
        self.leaf: list[int] = []


class TrieJoin:
    """Links among sets that arrive one by one. add() returns the links that join two components, or with `every` all links."""

    def __init__(self, step: int = 24, every: bool = False):
        self.root, self.parent, self.sizes, self.step, self.every = _Node([], 0, 1 << 62), {}, {}, step, every
        self.joined: list[tuple[int, int]] = []  # the last add's links that join two components

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def add(self, doc: int, size: int, codes: list[int], search: bool = True, insert: bool = True) -> list[tuple[int, int]]:
        """codes: in global order."""
        self.parent.setdefault(doc, doc)
        self.sizes[doc] = size
        self.joined = []
        found = self._search(doc, size, codes) if search else []
        if insert:
            self._insert(doc, size, codes)
        return found

    def _search(self, doc: int, size: int, codes: list[int]) -> list[tuple[int, int]]:
        own, find, step, total, every = set(codes), self.find, self.step, len(codes), self.every
        links: list[tuple[int, int]] = []
        stack = [(c, 0) for c in self.root.children.values()]
        while stack:
            node, overlap = stack.pop()
            if not every and not node.mixed and find(node.rep) == find(doc):
                continue
            goal = needed(size, node.least)
            rest, segment = node.rest, node.segment
            if min(overlap + rest, total) < goal:
                continue
            for a in range(0, len(segment), step):
                part = segment[a : a + step]
                overlap += len(own.intersection(part))
                rest -= len(part)
                if overlap + rest < goal:
                    break
            else:
                for other in node.leaf:
                    if overlap >= needed(size, self.sizes[other]):
                        a, b = find(doc), find(other)
                        if a != b:
                            self.parent[b] = a
                            self.joined.append((doc, other))
                        if every:
                            links.append((doc, other))
                stack.extend((c, overlap) for c in node.children.values())
        return links if every else self.joined

    def _insert(self, doc: int, size: int, codes: list[int]) -> None:
        node, at, n = self.root, 0, len(codes)
        while at < n:
            child = node.children.get(codes[at])
            if child is None:
                child = node.children[codes[at]] = _Node(codes[at:], n - at, size)
                child.rep = doc
                child.leaf.append(doc)
                return
            segment = child.segment
            same, most = 1, min(len(segment), n - at)
            while same < most and segment[same] == codes[at + same]:
                same += 1
            if same < len(segment):
                upper = _Node(segment[:same], child.rest, child.least)
                upper.rep, upper.mixed = child.rep, child.mixed
                upper.children[segment[same]] = child
                child.segment, child.rest = segment[same:], child.rest - same
                node.children[codes[at]] = upper
                child = upper
            child.rest, child.least = max(child.rest, n - at), min(child.least, size)
            if not child.mixed and self.find(child.rep) != self.find(doc):
                child.mixed = True
            node, at = child, at + same
        node.leaf.append(doc)


def _link(every: bool):
    def run(table: pa.Table) -> pa.Table:
        """Links within the families of one table. side 0 and 1: two blocks of one family, 1 looks for links to 0; 2: all with all.

        Rows (a, b, n): links that join components, n null; with `every` also the number n of documents linked with a, b null.
        """
        rows: list[list] = [[], [], []]
        cols = [table.column(c) for c in ("task", "side", "doc", "size", "copies")]
        task, side, doc, size, copies = (np.asarray(c.to_numpy(zero_copy_only=False)) for c in cols)
        codes = table.column("codes").combine_chunks()
        offsets, values = codes.offsets.to_numpy(), codes.values.to_numpy()
        copies_of = dict(zip(doc.tolist(), copies.tolist(), strict=True))
        counts: dict[int, int] = {}
        order = np.lexsort((doc, size, side, task))
        last, join = None, TrieJoin(every=every)
        for i in order.tolist():
            if task[i] != last:
                last, join = task[i], TrieJoin(every=every)
            own = values[offsets[i] : offsets[i + 1]][::-1].tolist()
            me = int(doc[i])
            found = join.add(me, int(size[i]), own, search=side[i] != 0, insert=side[i] != 1)
            if every:
                for _, b in found:
                    counts[b] = counts.get(b, 0) + copies_of[me]
                if found:
                    counts[me] = counts.get(me, 0) + sum(copies_of[b] for _, b in found)
            for a, b in join.joined:
                rows[0].append(a)
                rows[1].append(b)
                rows[2].append(None)
        for d, n in counts.items():
            rows[0].append(d)
            rows[1].append(None)
            rows[2].append(n)
        return pa.table([pa.array(r, pa.int64()) for r in rows], names=["a", "b", "n"])

    return run


def _spread(df: DataFrame, key: str, groups: int, of: int) -> DataFrame:
    """df dealt by key; where there are many groups, to more partitions than the session's number."""
    return df.repartition(-(-groups // of), key) if groups > of * shuffle_partitions(df.sparkSession) else df


def links(docs: DataFrame, n: int = N, block_tokens: int = BLOCK_TOKENS, every: bool = False, range_codes: int = RANGE_CODES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with n_shingles and fingerprint, classes with their smallest document, links between classes).

    The links (a, b) are those that tie the components. With `every`, rows (a, null, n) beside them count the documents
    that a is linked with in a task.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    described = cut(source.mapInArrow(_describe(n), "doc_id long, n_shingles long, fp binary, class long"))
    classes = described.filter("fp is not null").groupBy("fp").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.count_distinct("doc_id").alias("docs"), F.first("n_shingles").alias("size"), F.first("class").alias("class")
    )
    classes = cut(classes)
    codes = classes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    ranges = max(4, shuffle_partitions(spark), -(-codes // range_codes))
    packed = source.filter("doc_id is not null").mapInArrow(_scatter(n, ranges), "part int, docs binary, sizes binary, counts binary, low binary, high binary")
    shared = _spread(packed, "part", ranges, 4).groupBy("part").applyInArrow(_count(ranges, ranges), "g int, docs binary, sizes binary, counts binary, codes binary, dfs binary")
    own = classes.filter("size > 0").select("class", "docs", F.pmod("class", F.lit(ranges).cast("long")).cast("int").alias("g"))
    found = cut(
        _spread(shared, "g", ranges, 4).groupBy("g").cogroup(_spread(own, "g", ranges, 4).groupBy("g"))
        .applyInArrow(_candidates, "doc long, size long, codes array<bigint>, prefix int, copies long")
    )

    postings = found.select("doc", F.explode(F.slice("codes", F.lit(1), F.col("prefix"))).alias("code"))
    stars = cut(postings.groupBy("code").agg(F.min("doc").alias("hub"), F.count("*").alias("n")).filter("n > 1"))
    total = stars.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tied = skew_join(postings, stars, "code", "n", total, F.struct("doc", "code")).filter("hub <> doc").select(F.col("hub").alias("a"), F.col("doc").alias("b"))
    family = components(tied).select(F.col("node").alias("doc"), F.col("component").alias("family"))
    member = found.join(family, "doc").select("doc", "size", "codes", "copies", "family", F.floor(F.log(_BAND, F.col("size"))).cast("int").alias("band"))
    band = cut(member.groupBy("family", "band").agg(F.count("*").alias("n"), F.sum(F.size("codes")).alias("tokens")))
    # per family the blocks of each length band (at most about 100 bands); one block of all bands where they fit
    entry = F.struct("band", F.ceil(F.col("tokens") / block_tokens).cast("int").alias("blocks"))
    weight = band.groupBy("family").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"), F.map_from_entries(F.collect_list(entry)).alias("blocks"))
    weight = cut(weight.select("family", "n", "tokens", F.when(F.col("tokens") > block_tokens, F.col("blocks")).alias("blocks")))
    docs_in, tokens_in = weight.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    buckets = max(ranges, -(-tokens_in // block_tokens))
    task = skew_join(member, weight.select("family", "n", "blocks"), "family", "n", docs_in, F.col("doc"))
    mine = F.struct("band", F.pmod(F.xxhash64("doc"), F.col("blocks")[F.col("band")]).cast("int").alias("block"))
    others = F.flatten(F.transform(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1), lambda b: F.when(
        F.col("blocks")[b].isNull(), F.array().cast("array<struct<band: int, block: int>>")
    ).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks")[b] - 1), lambda j: F.struct(b.alias("band"), j.alias("block"))))))
    whole = F.col("blocks").isNull()
    task = task.select("*", F.when(~whole, mine).alias("own"), F.explode(F.when(whole, F.array(F.lit(None).cast("struct<band: int, block: int>"))).otherwise(others)).alias("with"))
    name = lambda x: F.concat_ws(".", x["band"], x["block"])
    task = task.select(
        F.when(whole, F.pmod(F.xxhash64("family"), F.lit(buckets)).cast("string"))
        .otherwise(F.concat_ws(":", "family", name(F.least("own", "with")), name(F.greatest("own", "with")))).alias("bucket"),
        F.col("family").alias("task"),
        F.when(whole | (F.col("own") == F.col("with")), 2).when(F.col("own") < F.col("with"), 0).otherwise(1).alias("side"), "doc", "size", "codes", "copies",
    )
    linked = task.groupBy("bucket").applyInArrow(_link(every), "a long, b long, n long")
    return described, classes, linked


def _components(docs: DataFrame, n: int, every: bool, **bounds: int) -> DataFrame:
    described, classes, linked = links(docs, n, every=every, **bounds)
    linked = cut(linked) if every else linked
    comp = components(linked.filter("b is not null").select("a", "b")).select(F.col("node").alias("class"), "component")
    tied = cut(classes.select("class", "rep").join(comp, "class"))
    least = cut(tied.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("n")))
    named = skew_join(tied, least, "component", "n", tied.count(), F.col("class")).select("class", F.col("component_id").alias("least"))
    classes = classes.join(named, "class", "left").withColumn("component_id", F.coalesce("least", "rep"))
    columns = ["component_id"]
    if every:
        counts = linked.filter("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("others"))
        alike = F.when(F.col("size") > 0, F.col("docs") - 1 + F.coalesce("others", F.lit(0))).otherwise(0)
        classes = classes.join(counts, "class", "left").withColumn("n_links", alike)
        columns.append("n_links")
    total = described.count()
    found = skew_join(described, cut(classes.select("fp", "copies", *columns)), "fp", "copies", total, F.col("doc_id"))
    return found.select("doc_id", "n_shingles", *[F.coalesce(c, F.lit(0)).alias(c) if c == "n_links" else c for c in columns])


def join(docs: DataFrame, n: int = N, block_tokens: int = BLOCK_TOKENS, range_codes: int = RANGE_CODES) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, n_links (other documents that are similar enough)."""
    return _components(docs, n, True, block_tokens=block_tokens, range_codes=range_codes)


def keep_one(docs: DataFrame, n: int = N, block_tokens: int = BLOCK_TOKENS, range_codes: int = RANGE_CODES) -> DataFrame:
    """docs without those whose component holds a smaller id; rows with a null doc_id stay."""
    gone = _components(docs, n, False, block_tokens=block_tokens, range_codes=range_codes).filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    keyed = own_key(docs, "__ngram_join_key")
    return keyed.join(gone, (keyed["__ngram_join_key"] == gone["_gone"]) & keyed["doc_id"].isNotNull(), "left_anti").select(*docs.columns)
