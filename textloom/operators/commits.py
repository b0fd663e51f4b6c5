"""Many commits in one job.

Commits that share no path, not even by way of others, can't see each other. So the paths that the requests touch are
tied into connected components (a move ties two, and so does any commit of several paths), and each component is folded in
order of the commits on an executor, against the newest versions of its own paths only. Every commit is all or nothing, as
in store.commit(); one that is refused is a row that says why, and later ones go on from where it left things.

Bounds: a component's requests go by in order of seq, a batch at a time, so their number isn't limited. What its task holds are
the newest texts of the component's paths, and of older versions those that a request yet to come is based on. So a component whose
operations and stored texts are over `max_bytes` is refused before anything is applied, and so is one of more than `most` commits
where that is given. (Log lines tie all commits that write one.) Versions are whole texts: appending n lines to one page writes n
texts of up to n lines, which go on as they are made. A job that only asks what was written, with which size and digest, says so:
then no texts are made of pages that only grow, and a commit's work goes by what it says.

Defined results: requests are taken in order of seq, and of equal ones in order of their text. Operations that can't be read,
null ones and ones against the rules make the commit `invalid`; `unchanged` commits write nothing.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators import store
from textloom.operators.components import components
from textloom.runtime import cut

MAX_BYTES = 256 << 20

_VERSION = "path:string,rev:long,content:string,sha256:string,deleted:boolean,bytes:long"
RESULT = f"seq long, status string, path string, reason string, op_index int, details string, versions array<struct<{_VERSION}>>"
_TOUCHES = "array<struct<path:string,`from`:string,`to`:string,base_rev:string>>"
_MADE = pa.struct([("path", pa.string()), ("rev", pa.int64()), ("content", pa.string()), ("sha256", pa.string()), ("deleted", pa.bool_()), ("bytes", pa.int64())])
_ARROW = pa.schema([("seq", pa.int64()), ("status", pa.string()), ("path", pa.string()), ("reason", pa.string()), ("op_index", pa.int32()), ("details", pa.string()), ("versions", pa.list_(_MADE))])
#: What a component's task reads, in this order: its newest texts, older ones that requests are based on, which bases until which seq, the requests.
_NEWEST, _OLD, _BASE, _REQUEST = range(4)
#: Results are handed on in batches of so many bytes of text, and rows.
_OUT_BYTES, _OUT_ROWS = 8 << 20, 10_000


class _Component:
    """The working copy of one component's paths."""

    def __init__(self, texts: bool = True):
        self.texts = texts
        self.state = store._State({}, {})
        self.until: dict[tuple[str, int], int | None] = {}
        self.ends: list[tuple[int, tuple[str, int]]] | None = None

    def take(self, r: dict) -> tuple | None:
        """Takes in a row; the result of a request."""
        at = r["path"], r["rev"]
        if r["kind"] == _NEWEST:
            self.state.files[r["path"]] = r["rev"], r["content"]
        elif r["kind"] == _OLD:
            self.state.versions[at] = r["content"]
        elif r["kind"] == _BASE:
            self.until[at] = r["seq"]
        else:
            self._forget(r["seq"])
            return self._apply(r)

    def _forget(self, seq: int | None) -> None:
        """Versions that only requests before this one are based on."""
        if self.ends is None:
            self.ends = sorted(((last, at) for at, last in self.until.items() if last is not None), reverse=True)
        while self.ends and (seq is None or self.ends[-1][0] < seq):
            _, at = self.ends.pop()
            self.until.pop(at, None)
            self.state.versions.pop(at, None)

    def _apply(self, r: dict) -> tuple:
        seq = r["seq"]
        try:
            ops = json.loads(r["ops"])
            if not isinstance(ops, list) or not all(isinstance(op, dict) for op in ops):
                raise ValueError("operations are a list of objects")
            store.validate(ops, r["message"] or "", r["log"])
            made = store.written(self.state, store.with_log(ops, r["log"], r["author"], r["today"]))
        except store.Conflict as e:
            rest = {k: v for k, v in e.details.items() if k != "op_index"}
            return seq, "conflict", e.path, e.reason, e.details.get("op_index"), json.dumps(rest, ensure_ascii=False, sort_keys=True), []
        except (ValueError, TypeError, AttributeError) as e:
            return seq, "invalid", None, str(e), None, None, []
        self.state.versions.update({(p, rev): store.plain(content) for p, rev, content, _, _ in made if (p, rev) in self.until})
        done = [{"path": p, "rev": rev, "content": store.plain(content) if self.texts else None, "sha256": sha, "deleted": gone, "bytes": store.size_of(content)} for p, rev, content, sha, gone in made]
        return seq, "applied" if made else "unchanged", None, None, None, None, done


def _fold(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    """Rows come by component, and in order within each."""
    key, own = None, _Component(texts)
    out, size = [], 0
    for batch in batches:
        for r in batch.to_pylist():
            if r["component"] != key:
                key, own = r["component"], _Component(texts)
            done = own.take(r)
            if done is None:
                continue
            out.append(done)
            size += len(done[5] or "") + sum(len(v["content"] or "") for v in done[6])
            if size >= _OUT_BYTES or len(out) >= _OUT_ROWS:
                yield _results(out)
                out, size = [], 0
    if out:
        yield _results(out)


def _results(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


def apply_all(versions: DataFrame, requests: DataFrame, most: int | None = None, max_bytes: int = MAX_BYTES, texts: bool = True) -> DataFrame:
    """One row a request (seq, ops in JSON; message, log, author and today if there are such columns): seq, status (applied,
    unchanged, conflict, invalid), path, reason, op_index and details of a refusal, and the versions it writes. texts: whether these
    have their content; sha256 and bytes are those of the whole text either way."""
    text = lambda c: (F.col(c) if c in requests.columns else F.lit(None)).cast("string").alias(c)
    r = requests.select(F.col("seq").cast("long").alias("seq"), *[text(c) for c in ("ops", "message", "log", "author", "today")])
    r = r.withColumn("id", F.xxhash64("seq", "ops")).withColumn("touches", F.from_json("ops", _TOUCHES))
    logged = F.when(F.trim("log") != "", F.array(F.lit(store.LOG))).otherwise(F.array().cast("array<string>"))
    paths = F.flatten(F.transform("touches", lambda x: F.array(x["path"], x["from"], x["to"])))
    r = cut(r.withColumn("paths", F.array_distinct(F.array_compact(F.concat(F.coalesce(paths, F.array().cast("array<string>")), logged)))))
    tied = r.filter(F.size("paths") > 1).select(F.col("paths")[0].alias("a"), F.explode(F.slice("paths", F.lit(2), F.size("paths"))).alias("b"))
    of_path = components(tied)
    r = r.withColumn("node", F.get("paths", F.lit(0))).join(of_path, "node", "left")
    r = cut(r.withColumn("component", F.coalesce("component", "node", F.concat(F.lit("\n"), F.col("id").cast("string")))))
    touched = r.select(F.explode("paths").alias("path")).distinct().join(of_path.withColumnRenamed("node", "path"), "path", "left")
    touched = touched.select("path", F.coalesce("component", "path").alias("component"))
    own = versions.join(touched, "path")
    newest = own.groupBy("path", "component").agg(F.max_by(F.struct("rev", F.when(~F.col("deleted"), F.col("content")).alias("content")), F.struct("seq", "rev")).alias("v"))
    bases = r.select("component", "seq", F.explode("touches").alias("t")).select("component", F.coalesce("t.path", "t.from").alias("path"), F.expr("try_cast(t.base_rev as bigint)").alias("rev"), "seq").filter("path is not null and rev is not null")
    # a null seq comes last of all
    bases = bases.groupBy("component", "path", "rev").agg(F.when(F.count("*") == F.count("seq"), F.max("seq")).alias("seq"))
    old = own.join(bases.select("path", "rev").distinct(), ["path", "rev"]).select(F.lit(_OLD).alias("kind"), "component", "path", "rev", "content")
    state = cut(newest.select(F.lit(_NEWEST).alias("kind"), "component", "path", "v.rev", "v.content").unionByName(old))
    size = lambda df, c: df.groupBy("component").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length(c), F.lit(0))).alias("bytes"))
    sizes = size(r, "ops").withColumn("commits", F.col("n")).unionByName(size(state, "content").withColumn("commits", F.lit(0).cast("long")))
    sizes = sizes.groupBy("component").agg(F.sum("commits").alias("commits"), F.sum("bytes").alias("bytes"))
    over = sizes.filter((F.col("bytes") > max_bytes) | (F.lit(False) if most is None else F.col("commits") > most)).first()
    if over is not None:
        raise ValueError(f"the commits around {over.component!r} are too many to fold in one task: {over.commits} commits, {over.bytes} bytes")
    rows = state.unionByName(bases.withColumn("kind", F.lit(_BASE)), allowMissingColumns=True)
    rows = rows.unionByName(r.select(F.lit(_REQUEST).alias("kind"), "component", "seq", "ops", "message", "log", "author", "today"), allowMissingColumns=True)
    # by number, so that small but long-running components aren't put together
    parts = int(versions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "component").sortWithinPartitions("component", "kind", F.asc_nulls_last("seq"), F.asc_nulls_last("ops"))
    return rows.mapInArrow(functools.partial(_fold, texts=texts), RESULT)


def versions_of(results: DataFrame) -> DataFrame:
    """The rows to append to the log."""
    return results.select("seq", F.inline("versions")).select("seq", "path", "rev", "content", "sha256", "deleted")
