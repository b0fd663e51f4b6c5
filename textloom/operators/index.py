"""An inverted index that follows edits: delta postings and tombstones by bucket, merged when they are many.

Postings (term, key, tf, dl, version) lie in folders by bucket of the term, sorted by term; a forward table (key, dl, terms, version)
lies in folders by bucket of the key. An update looks up the terms that changed and deleted rows had before, in their keys' buckets
only, and writes one delta: the new postings, and a tombstone (tf 0) for every term that a row has lost. Rows whose text is as it was
write nothing. Each task sorts what it made and writes its own file to a bucket, so postings aren't
shuffled; texts are where a key is there several times, and changed ones meet their former rows in a join. Document frequencies (term, d), the number of rows and the sum of their lengths are kept as additive
rows, so that statistics never need a scan. A query reads the folders of its own terms' buckets; where a bucket has one folder its rows are
live as they are, else the newest version of each (term, key) counts.

When the deltas of a bucket hold more than `share` of its rows, the update after them writes the bucket anew, without what is dead. For
postings that is its first folder without the keys that changed since, and what these have now by the forward table. Which
folders make up each bucket is said by a manifest, one row a generation of snapshots.Snapshots: readers keep the
generation they began with, and an update that breaks off leaves no trace in the next.

An update reads its input twice: keys first, to see whether one is there several times.

Defined results: null texts and keys aren't indexed (a null text deletes its key); of several rows with one key in an update the one with the
largest text counts; a key that is both changed and deleted is deleted.
"""

from __future__ import annotations

import functools
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import search as S
from textloom.operators.snapshots import Snapshots
from textloom.runtime import Scratch, cut

BUCKETS, SHARE = 64, 0.3
#: Keys of changed rows are broadcast up to so many; beyond that the rows they are looked up in are shuffled.
MOST_KEYS = 1_000_000
_MANIFEST = "manifest string"
_TERMS, _POSTS = "array<struct<term:string,tf:int>>", "array<struct<term:string,tf:int,d:int>>"
#: Rows are handed on in batches of so many terms.
_OUT_TERMS = 200_000


class _Lists:
    """A column of lists of (term, numbers ...) that is built row by row, where None is null."""

    def __init__(self, *names: str):
        self.names, self.columns, self.ends, self.null = names, [[] for _ in names], [0], []

    def add(self, columns: list[list] | None) -> None:
        for have, more in zip(self.columns, columns or [[] for _ in self.names], strict=True):
            have.extend(more)
        self.ends.append(len(self.columns[0]))
        self.null.append(columns is None)

    def array(self) -> pa.Array:
        values = pa.StructArray.from_arrays([pa.array(c, pa.string() if i == 0 else pa.int32()) for i, c in enumerate(self.columns)], names=list(self.names))
        return pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), values, mask=pa.array(self.null, pa.bool_()))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, t) to (key, dl, terms), with (key, t, had, had_dl) to (key, dl, terms, had_dl, posts) of rows that have changed: what
    is written for a term, and by how much its document frequency changes."""
    words = re.compile(X.TOKEN).findall
    for batch in batches:
        had = batch.column("had") if "had" in batch.schema.names else None
        texts = batch.column("t").cast(pa.binary())
        start = 0
        while start < len(batch):
            at, dls, terms, posts, i = [], [], _Lists("term", "tf"), _Lists("term", "tf", "d"), start
            while i < len(batch) and max(terms.ends[-1], posts.ends[-1]) < _OUT_TERMS:
                t = texts[i].as_py()
                count = None if t is None else Counter(words(str(t, "utf-8", "replace").lower()))
                now = None if count is None else sorted(count.items())  # in order, so that equal texts have equal lists
                dl = None if count is None else count.total()
                if had is None:
                    new = now is not None
                else:
                    was = had[i].values if had[i].is_valid else None
                    was = None if was is None else list(zip(was.field("term").to_pylist(), was.field("tf").to_pylist(), strict=True))
                    if new := was != now:
                        # a row whose length has changed writes all of its postings, since each has the length
                        same, old = dl == batch.column("had_dl")[i].as_py(), dict(was or ())
                        put = [(w, n, int(w not in old)) for w, n in now or () if not (same and old.get(w) == n)]
                        put += [(w, 0, -1) for w in old if w not in (count or ())]
                        posts.add([[x[k] for x in put] for k in range(3)])
                if new:
                    at.append(i)
                    dls.append(dl)
                    terms.add(None if now is None else [[w for w, _ in now], [n for _, n in now]])
                i += 1
            start = i
            key = batch.column(0).take(pa.array(at, pa.int64()))
            out = [key, pa.array(dls, pa.int32()), terms.array()]
            if had is not None:
                out += [batch.column("had_dl").take(pa.array(at, pa.int64())), posts.array()]
            yield pa.RecordBatch.from_arrays(out, names=[batch.schema.names[0], "dl", "terms", "had_dl", "posts"][: len(out)])


class Index:
    def __init__(self, spark: SparkSession, folder: str, key: str, buckets: int = BUCKETS, share: float = SHARE):
        """key: the column that tells rows apart."""
        self.spark, self.folder, self.key, self.buckets, self.share = spark, folder.rstrip("/"), key, buckets, share
        self.store = Snapshots(spark, f"{self.folder}/generations")

    def manifest(self, pin: str | None = None) -> dict:
        """What makes up a generation: folders and rows by kind and bucket, the number of rows and of their tokens."""
        row = self.store.table("manifest", _MANIFEST, pin).first()
        return {"version": 0, "n": 0, "dl": 0, "postings": {}, "rows": {}} if row is None else json.loads(row.manifest)

    def _bucket(self, column: Column | str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def _read(self, kind: str, m: dict, buckets: Iterable[int] | None = None) -> tuple[DataFrame | None, bool]:
        """(rows of some buckets or all, whether each bucket is one folder)."""
        own = m[kind] if buckets is None else {str(b): m[kind][str(b)] for b in buckets if str(b) in m[kind]}
        paths = [f"{self.folder}/{kind}/{batch}/bucket={b}" for b, batches in own.items() for batch in batches]
        return (self.spark.read.parquet(*paths) if paths else None), all(len(x) == 1 for x in own.values())

    def _live(self, kind: str, m: dict, by: list[str], values: list[str], buckets: Iterable[int] | None = None, where: Column | None = None, keys: DataFrame | None = None) -> DataFrame | None:
        rows, single = self._read(kind, m, buckets)
        if rows is None:
            return None
        rows = rows if where is None else rows.filter(where)
        rows = rows if keys is None else rows.join(F.broadcast(keys), self.key, "left_semi")
        if not single:
            rows = rows.groupBy(*by).agg(F.max_by(F.struct(*values), "version").alias("v"), F.max("version").alias("version")).select(*by, "v.*", "version")
        return rows.filter(f"{values[0]} is not null and {values[0]} > 0") if values[0] == "tf" else rows.filter("dl is not null")

    def rows(self, pin: str | None = None) -> DataFrame:
        """key, dl, terms (with tf) of all rows that are indexed."""
        live = self._live("rows", self.manifest(pin), [self.key], ["dl", "terms"])
        return live.select(self.key, "dl", "terms") if live is not None else self.spark.createDataFrame([], f"{self.key} string, dl int, terms array<struct<term:string,tf:int>>")

    def update(self, changed: DataFrame | None = None, text: str = "text", deleted: DataFrame | None = None) -> str:
        """Indexes rows (key, text), and forgets those of deleted (key). Returns the generation's name."""
        m = self.manifest()
        version, name = m["version"] + 1, f"v{m['version'] + 1:08d}"
        key = F.col(self.key)
        parts = []
        if changed is not None:
            parts.append(changed.select(key, F.col(text).alias("t"), F.lit(False).alias("gone")))
        if deleted is not None:
            parts.append(deleted.select(key, F.lit(None).cast("string").alias("t"), F.lit(True).alias("gone")))
        both = (parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])).filter(key.isNotNull())
        keys = cut(both.groupBy(self.key).count())
        of_keys = keys.agg(F.count("*").alias("n"), F.max("count").alias("most"), F.collect_set(self._bucket(self.key)).alias("buckets")).first()  # at most `buckets`
        if of_keys.most and of_keys.most > 1:
            both = both.groupBy(self.key).agg(F.max("t").alias("t"), F.max("gone").alias("gone"))
        new = both.select(key, F.when(~F.col("gone"), F.col("t")).alias("t"))
        few = keys.select(self.key) if of_keys.n <= MOST_KEYS else None
        old = self._live("rows", m, [self.key], ["dl", "terms"], of_keys.buckets, keys=few) if m["rows"] else None
        counted = f"`{self.key}` {both.schema[self.key].dataType.simpleString()}, dl int, terms {_TERMS}"
        row = [self.key, "dl", "terms", F.lit(version).alias("version"), self._bucket(self.key).alias("bucket")]
        with Scratch(self.spark) as scratch:
            if old is None:  # there is nothing to compare with: rows' own counts are what is written
                self._write("rows", name, new.filter("t is not null").mapInArrow(_counted, counted).select(*row), self.key)
                step = self.spark.read.schema(counted).parquet(f"{self.folder}/rows/{name}").select("*", F.lit(None).cast("int").alias("had_dl"))
                posts = step.select(key, "dl", F.inline_outer("terms")).withColumn("d", F.lit(1))
            else:
                had = old.select(key, F.col("terms").alias("had"), F.col("dl").alias("had_dl"))
                step = scratch.keep(new.join(had, self.key, "left").mapInArrow(_counted, f"{counted}, had_dl int, posts {_POSTS}"))
                self._write("rows", name, step.select(*row), self.key)
                posts = step.select(key, "dl", F.inline_outer("posts"))
            posts = posts.filter("term is not null")
            self._write("postings", name, posts.select("term", self.key, "tf", F.coalesce("dl", F.lit(0)).alias("dl"), F.lit(version).alias("version"), self._bucket("term").alias("bucket")), "term")
            self._write("frequencies", name, self._frequencies(posts), "term")
            sums = step.agg(F.count("dl").alias("a"), F.count("had_dl").alias("b"), F.coalesce(F.sum("dl"), F.lit(0)).alias("x"), F.coalesce(F.sum("had_dl"), F.lit(0)).alias("y"))
            one = (sums if old is None else cut(sums)).first()
        m = {**m, "version": version, "n": m["n"] + one.a - one.b, "dl": m["dl"] + one.x - one.y}
        for kind in ("postings", "frequencies", "rows"):
            counts = self._counts(kind, name)
            held = {b: dict(x) for b, x in m.get(kind, {}).items()}
            for b, n in counts.items():
                held.setdefault(b, {})[name] = n
            m[kind] = held
        m = self._merged(m, name)
        self.store.publish(name, {"manifest": self.spark.createDataFrame([(json.dumps(m),)], _MANIFEST).coalesce(1)})
        return name

    def _frequencies(self, rows: DataFrame) -> DataFrame:
        """term, d, bucket: the changes d of document frequencies by term."""
        return rows.groupBy("term").agg(F.sum("d").cast("long").alias("d")).filter("d <> 0").withColumn("bucket", self._bucket("term"))

    def _write(self, kind: str, name: str, rows: DataFrame, by: str) -> None:
        """Folders by bucket, in each a file of every task that has rows of it."""
        rows.sortWithinPartitions("bucket", by).write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.folder}/{kind}/{name}")

    def _counts(self, kind: str, name: str) -> dict[str, int]:
        """Rows by bucket of what was just written: at most `buckets` numbers, from the files' footers."""
        path = f"{self.folder}/{kind}/{name}"
        try:
            return {str(r["bucket"]): r["count"] for r in self.spark.read.parquet(path).groupBy("bucket").count().collect()}
        except Exception as e:  # nothing was written: a folder without files has no schema
            if "UNABLE_TO_INFER_SCHEMA" in str(e):
                return {}
            raise

    def _merged(self, m: dict, name: str) -> dict:
        """The manifest after buckets with too many deltas were written anew."""
        for kind in ("postings", "rows", "frequencies"):
            due = [int(b) for b, x in m[kind].items() if len(x) > 1 and sum(list(x.values())[1:]) > self.share * sum(x.values())]
            if not due:
                continue
            if kind == "frequencies":
                rows = self._frequencies(self._read(kind, m, due)[0])
            elif kind == "postings":
                rows = self._merged_postings(m, due)
            else:
                rows = self._live(kind, m, [self.key], ["dl", "terms"], due).withColumn("bucket", self._bucket(self.key))
            merged = f"{name}-merged"
            self._write(kind, merged, rows, "term" if kind != "rows" else self.key)
            counts = self._counts(kind, merged)
            m = {**m, kind: {b: ({merged: counts[b]} if b in counts else {}) if int(b) in due else x for b, x in m[kind].items()}}
            m[kind] = {b: x for b, x in m[kind].items() if x}
        return m

    def _merged_postings(self, m: dict, due: list[int]) -> DataFrame:
        """The live postings of some buckets: those of keys that are as they were in a bucket's first folder, and of the others' rows."""
        made = lambda batch: int(batch[1:9])  # noqa: E731: the version of a folder
        firsts: dict[str, list[int]] = {}
        for b in due:
            firsts.setdefault(min(m["postings"][str(b)], key=lambda x: (made(x), x)), []).append(b)
        parts = []
        columns = ["term", self.key, "tf", "dl", "version", "bucket"]
        for first, buckets in firsts.items():
            # rows that were merged since have lost which keys were deleted
            known = not any(x.endswith("-merged") and made(x) > made(first) for own in m["rows"].values() for x in own)
            later = {b: {x: n for x, n in own.items() if made(x) > made(first)} for b, own in m["rows"].items()}
            later = {b: own for b, own in later.items() if own}
            changed = self._read("rows", {"rows": later})[0] if known else None
            changed = None if changed is None else changed.filter(F.col("version") > made(first))
            if changed is None or (keys := changed.select(self.key).distinct()).count() > MOST_KEYS:
                own = self._live("postings", m, ["term", self.key], ["tf", "dl"], buckets).withColumn("bucket", self._bucket("term"))
            else:
                paths = [f"{self.folder}/postings/{first}/bucket={b}" for b in buckets]
                same = self.spark.read.parquet(*paths).filter("tf > 0").join(F.broadcast(keys), self.key, "left_anti")
                rows = self._live("rows", {"rows": later}, [self.key], ["dl", "terms"])
                now = rows.select(self.key, "dl", "version", F.inline_outer("terms")).filter("term is not null").withColumn("bucket", self._bucket("term"))
                own = same.withColumn("bucket", self._bucket("term")).select(*columns).unionByName(now.filter(F.col("bucket").isin(buckets)).select(*columns))
            parts.append(own.select(*columns))
        return functools.reduce(DataFrame.unionByName, parts)

    def search(self, query: str, allowed: DataFrame | None = None, pin: str | None = None, k1: float = S.K1, b: float = S.B) -> DataFrame:
        """key, score by BM25, from the buckets of the query's terms. allowed: the keys that may be found; statistics are of all rows."""
        m, terms = self.manifest(pin), S.tokens_of(query)
        unique = list(dict.fromkeys(terms))
        nothing = self.spark.createDataFrame([], f"{self.key} string, score double")
        if not unique or not m["n"]:
            return nothing
        asked = self.spark.range(1).select(F.explode(F.array(*map(F.lit, unique))).alias("term"))
        own = sorted({r[0] for r in asked.select(self._bucket("term")).collect()})
        hits = self._live("postings", m, ["term", self.key], ["tf", "dl"], own, F.col("term").isin(unique))
        counts, _ = self._read("frequencies", m, own)
        if hits is None or counts is None:
            return nothing
        df = counts.filter(F.col("term").isin(unique)).groupBy("term").agg(F.sum("d").alias("df"))  # a row for each term of the query
        hits = hits if allowed is None else hits.join(allowed.select(self.key), self.key, "left_semi")
        times = F.element_at(F.create_map(*[F.lit(x) for t in unique for x in (t, terms.count(t))]), F.col("term"))
        average = m["dl"] / m["n"]
        idf = F.log(1 + (F.lit(m["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        length = 1 - b + b * (F.col("dl") / F.lit(average) if average > 0 else F.lit(1.0))
        part = times * idf * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * length)
        return hits.join(F.broadcast(df), "term").groupBy(self.key).agg(F.sum(part).alias("score")).filter("score > 0")

    def folders(self, query: str) -> list[str]:
        """The folders of postings that a query reads."""
        unique = list(dict.fromkeys(S.tokens_of(query)))
        if not unique:
            return []
        own = {str(r[0]) for r in self.spark.range(1).select(F.explode(F.array(*map(F.lit, unique))).alias("t")).select(self._bucket("t")).collect()}
        return sorted(f"{batch}/bucket={b}" for b, x in self.manifest()["postings"].items() if b in own for batch in x)
