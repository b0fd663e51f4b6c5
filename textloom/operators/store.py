"""Versioned store: commits with seven kinds of operations, history, change feed, diff, revert, mirror merges.

The log is append-only: versions(seq, path, rev, content, sha256, deleted). Everything that reads it is a grouped or
windowed query; applying commits is sequential by nature, and touches only the paths that the commit names.
"""

from __future__ import annotations

import datetime
import difflib
import functools
import hashlib
import itertools
import operator
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.sources import parse

VERSIONS = "seq long, path string, rev long, content string, sha256 string, deleted boolean"
COMMITS = "seq long, author string, message string"
# Limits of a commit, its operations, and why one is refused.
MAX_OPS, MAX_FILE, MAX_COMMIT, MAX_MESSAGE, EXCERPT = 200, 1_500_000, 4_000_000, 10_000, 2000
OPS = ("create", "put", "upsert", "edit", "append", "delete", "move")
REASONS = ("exists", "missing", "stale_base_rev", "edit_no_match", "edit_multiple_matches", "sha_mismatch")
LOG = "log.md"


class Conflict(Exception):
    """Why a commit is refused: path, reason, and in details what is there instead."""

    def __init__(self, path: str, reason: str, **details):
        super().__init__(f"{reason}: {path}")
        self.path, self.reason, self.details = path, reason, {k: v for k, v in details.items() if v is not None}


def _sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def _size(s: str) -> int:
    return len(s.encode("utf-8", "surrogatepass"))


class Grown:
    """A text that lines were appended to, whose size and digest are carried on. Texts that grew from one another share their bytes."""

    def __init__(self, buffer: bytearray, size: int, digest):
        self.buffer, self.size, self.digest = buffer, size, digest

    @staticmethod
    def of(content: str) -> Grown:
        data = content.encode()
        return Grown(bytearray(data), len(data), hashlib.sha256(data))

    def plus(self, text: str) -> Grown | None:
        """This with a text at its end; None where append_text() would change what is there, or it gets too large."""
        if not self.size or self.buffer[self.size - 1] != 10 or self.size > 1 and self.buffer[self.size - 2] == 10:
            return None
        more = (text if text.endswith("\n") else text + "\n").encode()
        if self.size + len(more) > MAX_FILE:
            return None
        buffer = self.buffer if len(self.buffer) == self.size else self.buffer[: self.size]  # another text went on from here
        buffer += more
        digest = self.digest.copy()
        digest.update(more)
        return Grown(buffer, self.size + len(more), digest)

    def __str__(self) -> str:
        return self.buffer[: self.size].decode()


def plain(content: str | Grown | None) -> str | None:
    return str(content) if isinstance(content, Grown) else content


def size_of(content: str | Grown | None) -> int | None:
    """Bytes of a text."""
    return None if content is None else content.size if isinstance(content, Grown) else _size(content)


def _differ(a: str | Grown | None, b: str | Grown | None) -> bool:
    if isinstance(a, Grown) and isinstance(b, Grown) and a.size != b.size:
        return True
    return plain(a) != plain(b)


def _paths(op: dict) -> list[str]:
    return [op.get("from") or op.get("path"), op.get("to")] if op.get("op") == "move" else [op.get("path")]


def _path_problem(path) -> str | None:
    """X.path_error for one path on the driver."""
    parts = path.split("/") if isinstance(path, str) else [""]
    if path in (None, "") or "" in parts or "\\" in path or any(ord(c) < 32 or ord(c) == 127 for c in path) or _size(path) > 512:
        return "not a path"
    hidden = any(p.startswith(".") for p in parts) and not re.fullmatch(r"\.[a-z0-9-]+-template\.(md|json)", path)
    return "not a path of pages" if hidden else None


#: Texts that an operation must have, and which operations must say what they are based on.
_TEXTS = {"create": ("content",), "put": ("content",), "upsert": ("content",), "append": ("text",)}
_BASED = ("put", "delete", "move")


def validate(ops: list[dict], message: str = "", log: str | None = None) -> None:
    """Shape and size checks before anything is read. Raises ValueError."""
    if not 0 < len(ops) <= MAX_OPS:
        raise ValueError(f"a commit has 1 to {MAX_OPS} operations")
    if _size(message) > MAX_MESSAGE:
        raise ValueError("the message is too large")
    total = _size(message) + _size(log or "")
    for i, op in enumerate(ops):
        kind = op.get("op")
        if kind not in OPS:
            raise ValueError(f"operation {i} is none: {kind!r}")
        for path in _paths(op):
            if problem := _path_problem(path):
                raise ValueError(f"operation {i}: {problem}: {path!r}")
        base, digest = op.get("base_rev"), op.get("expected_sha256")
        if (kind in _BASED or base is not None) and (type(base) is not int or base < 0):
            raise ValueError(f"operation {i} needs base_rev, a whole number")
        if digest is not None and not re.fullmatch("[0-9a-f]{64}", digest):
            raise ValueError(f"operation {i}: expected_sha256 is null or 64 hexadecimal digits")
        texts = [op.get(name) for name in _TEXTS.get(kind, ())]
        if kind == "edit":
            pairs = op.get("edits")
            if not pairs or not all(isinstance(p.get("old"), str) and p["old"] for p in pairs):
                raise ValueError(f"operation {i} needs edits, each with an old text")
            texts = [t for p in pairs for t in (p["old"], p.get("new"))]
        for t in texts:
            if not isinstance(t, str) or any(0xD800 <= ord(c) < 0xE000 for c in t):
                raise ValueError(f"operation {i}: a text is missing or not valid")
            if _size(t) > MAX_FILE:
                raise ValueError(f"operation {i} is too large")
            total += _size(t)
    if total > MAX_COMMIT:
        raise ValueError("the commit is too large")


def _headings(lines: list[str]) -> list[tuple[int, int, str]]:
    """(row, level, title in lower case) of the headings outside fences."""
    fences = [x.strip()[:3] in ("```", "~~~") for x in lines]
    inside = itertools.accumulate(fences, operator.xor)
    found = [None if f or shut else re.match(r"(#{1,6})\s+(.+?)\s*#*\s*\Z", x) for x, f, shut in zip(lines, fences, inside, strict=True)]
    return [(row, len(m[1]), m[2].strip().lower()) for row, m in enumerate(found) if m]


def append_text(content: str, text: str, after_heading: str | None = None) -> str:
    """content with text at its end, or at the end of the section with a heading (any case) if there is one."""
    lines = content.split("\n")
    heads = _headings(lines) if after_heading else []
    own = [h for h in heads if h[2] == after_heading.lstrip("#").strip().lower()][:1]
    if own:
        row, level, _ = own[0]
        end = min((r for r, n, _ in heads if r > row and n <= level), default=len(lines))
        kept = max(i for i in range(row, end) if i == row or lines[i].strip()) + 1  # new lines come before the section's empty ones
        return "\n".join(lines[:kept] + text.rstrip("\n").split("\n") + lines[kept:])
    return (content.rstrip("\n") + "\n" if content else "") + (text if text.endswith("\n") else text + "\n")


@dataclass
class _State:
    """Working copy of the paths that a commit names: path -> (rev, content or None if absent)."""

    files: dict[str, tuple[int, str | Grown | None]]
    versions: dict[tuple[str, int], str | None] = field(default_factory=dict)
    changed: dict[str, tuple[int, str | Grown | None]] = field(default_factory=dict)  # what was there before

    def get(self, path: str) -> tuple[int, str | None]:
        rev, content = self.held(path)
        return rev, plain(content)

    def held(self, path: str) -> tuple[int, str | Grown | None]:
        return self.files.get(path, (0, None))

    def append(self, path: str, text: str) -> None:
        """A text at the end of a page: work goes by the text, not by the page, from the second one on."""
        old = self.held(path)[1]
        grown = old.plus(text) if isinstance(old, Grown) else None
        self.put(path, Grown.of(append_text(plain(old) or "", text)) if grown is None else grown)

    def put(self, path: str, content: str | Grown | None) -> None:
        if content is not None and size_of(content) > MAX_FILE:
            raise ValueError(f"{path} would be larger than {MAX_FILE} bytes")
        was = self.held(path)
        self.files[path] = (was[0] + (path not in self.changed), content)
        self.changed.setdefault(path, was)

    def since(self, path: str, rev: int) -> str | None:
        """What happened to a path since one of its revisions, as a diff."""
        base = self.versions.get((path, rev))
        return None if base is None else unified_diff(base, self.get(path)[1], names=(f"a/{path}@{rev}", f"b/{path}@{self.get(path)[0]}"))


def _edited(state: _State, path: str, op: dict) -> str:
    rev, text = state.get(path)
    base = op.get("base_rev")
    for pair in op["edits"]:
        n = text.count(pair["old"])
        if n == 0 or n > 1 and not pair.get("replace_all"):
            at = text.find(pair["old"])
            seen = text[:EXCERPT] if at < 0 else _around(text, at)
            diff = state.since(path, base) if base not in (None, rev) else None
            raise Conflict(path, REASONS[3] if n == 0 else REASONS[4], current_rev=rev, base_rev=base, diff=diff, current_excerpt=seen)
        if _size(text) + n * (_size(pair["new"]) - _size(pair["old"])) > MAX_FILE:  # before the text is built
            raise ValueError(f"{path} would be larger than {MAX_FILE} bytes")
        text = text.replace(pair["old"], pair["new"])
    return text


def _around(text: str, at: int) -> str:
    """The lines around a place, up to the headings before and after it."""
    heads = [m.start() for m in re.finditer(r"(?m)^#{1,6}\s+\S", text)]
    low, high = max([h for h in heads if h <= at], default=0), min([h - 1 for h in heads if h > at], default=len(text))
    return text[low:high][:EXCERPT]


def _apply(state: _State, op: dict) -> None:
    kind, path = op["op"], _paths(op)[0]
    rev, old = state.held(path)
    if kind == "append" and not op.get("after_heading") and (old is not None or op.get("create")):
        state.append(path, op["text"])
        return
    old = plain(old)
    there = {"current_rev": rev, "current_excerpt": old[:EXCERPT]} if old is not None else {}
    if kind == "create" and old is not None:
        raise Conflict(path, "exists", **there)
    if kind in ("put", "edit", "delete", "move") and old is None or kind == "append" and old is None and not op.get("create"):
        raise Conflict(path, "missing", base_rev=op.get("base_rev"))
    if kind in _BASED and op["base_rev"] != rev:
        raise Conflict(path, "stale_base_rev", base_rev=op["base_rev"], diff=state.since(path, op["base_rev"]), **there)
    if kind == "upsert" and "expected_sha256" in op:
        want = op["expected_sha256"]
        if want is None and old is not None:
            raise Conflict(path, "exists", current_sha256=_sha(old), **there)
        if want is not None and (old is None or want != _sha(old)):
            raise Conflict(path, "sha_mismatch", current_sha256=old and _sha(old), **there)
    if kind in ("create", "put", "upsert"):
        state.put(path, op["content"])
    elif kind == "edit":
        state.put(path, _edited(state, path, op))
    elif kind == "append":
        state.put(path, append_text(old or "", op["text"], op.get("after_heading")))
    elif kind == "delete":
        state.put(path, None)
    elif kind == "move":
        to_rev, to = state.get(op["to"])
        if to is not None:
            raise Conflict(op["to"], "exists", current_rev=to_rev, current_excerpt=to[:EXCERPT])
        state.put(op["to"], old)
        state.put(path, None)


def latest(versions: DataFrame) -> DataFrame:
    """The newest version of every path, tombstones included: one grouped maximum, combined map-side."""
    rest = [c for c in versions.columns if c not in ("path", "seq", "rev")]
    m = versions.groupBy("path").agg(F.max_by(F.struct("seq", "rev", *rest), F.struct("seq", "rev")).alias("_v"))
    return m.select("path", "_v.*")


def live(versions: DataFrame) -> DataFrame:
    return latest(versions).filter("not deleted")


def manifest(versions: DataFrame) -> DataFrame:
    return live(versions).select("path", "sha256")


def commit(spark: SparkSession, versions: DataFrame, ops: list[dict], seq: int, message: str = "", log: str | None = None, author: str = "", today: str | None = None) -> DataFrame:
    """The new versions of one commit, all or nothing; no rows if nothing changes. Raises Conflict or ValueError.

    log: a line for the log page, written in the same commit. A path's rev within the commit is the one it will get.
    """
    validate(ops, message, log)
    ops = with_log(ops, log, author, today)
    paths = sorted({p for op in ops for p in _paths(op)})
    based = sorted({(p, op["base_rev"]) for op in ops if op.get("base_rev") is not None for p in _paths(op)[:1]})
    own = versions.filter(F.col("path").isin(*paths))
    rows = latest(own).collect()  # at most two paths per operation, and one revision
    wanted = [(F.col("path") == p) & (F.col("rev") == r) for p, r in based]
    bases = own.filter(functools.reduce(operator.or_, wanted)).select("path", "rev", "content").collect() if wanted else []
    state = _State({r.path: (r.rev, None if r.deleted else r.content) for r in rows}, {(r.path, r.rev): r.content for r in bases})
    return spark.createDataFrame([(seq, p, rev, plain(content), *rest) for p, rev, content, *rest in written(state, ops)], VERSIONS)


def written(state: _State, ops: list[dict]) -> list[tuple]:
    """The versions (path, rev, content, sha256, deleted) that operations make of a state, which moves on. All or nothing: on a
    Conflict, which names the operation, or another error the state stays. The content of a page that was appended to may be Grown."""
    state.changed = {}
    try:
        for i, op in enumerate(ops):
            try:
                _apply(state, op)
            except Conflict as e:
                e.details["op_index"] = i
                raise
    except Exception:
        state.files.update(state.changed)
        raise
    out = []
    for p, (rev, old) in state.changed.items():
        new = state.held(p)[1]
        differ = _differ(new, old)
        state.files[p] = (rev + differ, new)
        if differ:
            out.append((p, rev + 1, new, None if new is None else new.digest.hexdigest() if isinstance(new, Grown) else _sha(new), new is None))
    return out


def with_log(ops: list[dict], log: str | None, author: str | None, today: str | None) -> list[dict]:
    """ops, and the line for the log page, if there is one."""
    if not log or not log.strip():
        return ops
    line = f"- {today or datetime.date.today().isoformat()} {author or ''}: {re.sub(r'\s*[\r\n]+\s*', ' ', log).strip()}"
    return [*ops, {"op": "append", "path": LOG, "text": line, "create": True}]


def read(versions: DataFrame, paths: DataFrame, heading: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """path, found, content of wanted paths (column path): the whole page, one section, or lines of either."""
    have = live(versions).select("path", F.col("content").alias("_c"))
    j = paths.select("path").join(have, "path", "left")
    if heading:
        j = j.withColumn("_s", parse.split_sections("_c")).withColumn("_c", F.when(F.col("_c").isNotNull(), parse.heading_section("_s", heading)))
    lines = F.split("_c", "\n", -1)
    first = max(1, start or 1)
    if start is not None or end is not None:
        j = j.withColumn("_c", F.array_join(F.slice(lines, F.lit(first), F.greatest(F.least(F.lit(end if end is not None else 1 << 30), F.size(lines)) - first + 1, F.lit(0))), "\n"))
    return j.select("path", F.col("_c").isNotNull().alias("found"), F.col("_c").alias("content"))


def listing(versions: DataFrame, prefix: str = "") -> DataFrame:
    """path, rev, sha256, bytes of live pages under a prefix."""
    v = live(versions.filter(F.col("path").startswith(prefix)) if prefix else versions)
    return v.select("path", "rev", "sha256", F.octet_length("content").cast("long").alias("bytes"))


def export_page(versions: DataFrame, after: str | None = None, n: int = 100) -> DataFrame:
    """The next n (at most 500) live pages in path order after a cursor, with more: whether others follow."""
    most = max(1, min(500, n))
    v = live(versions if after is None else versions.filter(F.col("path") > after))
    page = v.orderBy("path").limit(most + 1).withColumn("_k", F.row_number().over(W.orderBy("path")))
    return page.withColumn("more", F.max("_k").over(W.partitionBy()) > most).filter(F.col("_k") <= most).drop("_k")


def overview(versions: DataFrame, sections: DataFrame, flags: DataFrame) -> DataFrame:
    """One row: seq, pages, bytes, sections, vector_lag (sections whose vec_state isn't confirmed), open_review_flags."""
    v = latest(versions).agg(
        F.max("seq").alias("seq"), F.count_if(~F.col("deleted")).alias("pages"), F.coalesce(F.sum(F.when(~F.col("deleted"), F.octet_length("content"))), F.lit(0)).cast("long").alias("bytes")
    )
    s = sections.agg(F.count("*").alias("sections"), F.count_if(F.col("vec_state") < 2).alias("vector_lag"))
    f = review_queue(flags).agg(F.count_if(F.col("status") == "open").alias("open_review_flags"))
    return v.crossJoin(F.broadcast(s)).crossJoin(F.broadcast(f))  # one row each


def resolve_flags(events: DataFrame, ids: DataFrame, at: int, status: str = "resolved") -> DataFrame:
    """The events that close open flags (column id): rows to append to the queue."""
    open_ = review_queue(events, "open").join(ids.select("id").distinct(), "id", "left_semi")
    return open_.withColumn("at", F.lit(at).cast(events.schema["at"].dataType)).withColumn("status", F.lit(status)).select(*events.columns)


def register(known: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, outcome of wanted names (id): created, kept (known before) or invalid."""
    ok = F.col("id").rlike(r"^[a-z0-9][a-z0-9-]{0,62}\z")
    j = wanted.select("id").distinct().join(known.select("id", F.lit(True).alias("_k")).distinct(), "id", "left")
    return j.select("id", F.when(~F.coalesce(ok, F.lit(False)), "invalid").when(F.col("_k"), "kept").otherwise("created").alias("outcome"))


def anything(*parts: DataFrame) -> bool:
    """Whether any of the inputs has a row; each is looked at until its first."""
    firsts = [p.select(F.lit(1).alias("x")).limit(1) for p in parts]
    return not functools.reduce(DataFrame.unionAll, firsts).isEmpty()


def as_of(versions: DataFrame, seq: int) -> DataFrame:
    """The live files after commit seq."""
    return live(versions.filter(F.col("seq") <= seq))


def revision(versions: DataFrame, path: str, rev: int) -> DataFrame:
    return versions.filter((F.col("path") == path) & (F.col("rev") == rev))


def history(versions: DataFrame, commits: DataFrame, path: str | None = None, before: int | None = None, n: int = 50) -> DataFrame:
    """Commits, the newest first, with the paths they changed; before: only older ones (keyset paging)."""
    v = versions if path is None else versions.join(versions.filter(F.col("path") == path).select("seq").distinct(), "seq", "left_semi")
    c = commits if before is None else commits.filter(F.col("seq") < before)
    if path is not None:
        c = c.join(v.select("seq").distinct(), "seq", "left_semi")
    page = c.orderBy(F.desc("seq")).limit(n)
    return page.join(v.groupBy("seq").agg(F.sort_array(F.collect_list("path")).alias("paths")), "seq", "left").orderBy(F.desc("seq"))


def changes(versions: DataFrame, since: int, n: int | None = None) -> DataFrame:
    """The newest state of every path changed after since, by (seq, path). A page of about n rows never splits a commit."""
    rows = latest(versions.filter(F.col("seq") > since))
    if n is None:
        return rows
    cut = rows.orderBy("seq", "path").limit(n).agg(F.max("seq").alias("_last"))  # one row
    return rows.join(F.broadcast(cut), F.col("seq") <= F.col("_last")).drop("_last")


#: Changed lines beyond which a diff shows one replaced block.
MAX_EDITS = 500


def unified_diff(old: str | None, new: str | None, context: int = 3, names: tuple[str, str] = ("before", "after")) -> str:
    """A unified diff by lines. Over MAX_EDITS changed lines what differs between the common beginning and end is one block."""
    a, b = (old or "").split("\n"), (new or "").split("\n")
    low = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    high = next((i for i, (x, y) in enumerate(zip(reversed(a[low:]), reversed(b[low:]), strict=False)) if x != y), min(len(a), len(b)) - low)
    x, y = a[low : len(a) - high], b[low : len(b) - high]
    if abs(len(x) - len(y)) <= MAX_EDITS:
        out = list(difflib.unified_diff(a, b, *names, n=context, lineterm=""))
        if sum(line[:1] in "+-" for line in out[2:]) <= MAX_EDITS:
            return "\n".join(out)
    lead, tail = a[max(0, low - context) : low], a[len(a) - high : len(a) - high + context]
    head = f"@@ -{low - len(lead) + 1},{len(lead) + len(x) + len(tail)} +{low - len(lead) + 1},{len(lead) + len(y) + len(tail)} @@"
    return "\n".join([f"--- {names[0]}", f"+++ {names[1]}", head, *(" " + t for t in lead), *("-" + t for t in x), *("+" + t for t in y), *(" " + t for t in tail)])


@F.pandas_udf(T.StringType())
def diff_text(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([unified_diff(x, y) for x, y in zip(a, b, strict=True)])


def diff(versions: DataFrame, path: str, rev_a: int, rev_b: int) -> DataFrame:
    pick = lambda r, name: revision(versions, path, r).select("path", F.col("content").alias(name))
    return pick(rev_a, "a").join(pick(rev_b, "b"), "path", "full_outer").select("path", diff_text("a", "b").alias("diff"))


def diff_snapshots(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per path of two snapshots (path, content): status, and the unified diff of what changed."""
    j = a.select("path", F.col("content").alias("a")).join(b.select("path", F.col("content").alias("b")), "path", "full_outer")
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return j.select("path", status.alias("status"), "a", "b").filter("status <> 'same'").select("path", "status", diff_text("a", "b").alias("diff"))


def revert(versions: DataFrame, seq: int) -> tuple[DataFrame, DataFrame]:
    """(paths that changed since, which forbid it; the versions that a revert of seq would write, before numbering)."""
    own = versions.filter(F.col("seq") == seq).select("path", "rev")
    newest = latest(versions).select("path", F.col("seq").alias("_seq"), F.col("rev").alias("_rev"))
    guard = own.join(newest.filter(F.col("_seq") != seq), "path").select("path", F.col("_seq").alias("changed_at"))
    old = versions.select("path", F.col("rev").alias("_r"), "content", "sha256", "deleted")
    back = own.join(old.withColumn("rev", F.col("_r") + 1), ["path", "rev"], "left")
    return guard, back.select("path", (F.col("rev") + 1).alias("rev"), "content", "sha256", F.coalesce("deleted", F.lit(True)).alias("deleted"))


def classify(local: DataFrame, remote: DataFrame) -> DataFrame:
    """path, state of two manifests (path, sha256): identical, new (local only), remote_only, divergent."""
    j = local.select("path", F.col("sha256").alias("a")).join(remote.select("path", F.col("sha256").alias("b")), "path", "full_outer")
    return j.select("path", F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "remote_only").when(F.col("a") == F.col("b"), "identical").otherwise("divergent").alias("state"))


def batches(rows: DataFrame, path: str, size: str, most: int = MAX_OPS, max_bytes: int = MAX_COMMIT) -> DataFrame:
    """rows with batch: greedy batches in path order within each partition range, bounded in number and bytes.

    Ranges are packed independently, so no task holds more than its range.
    """
    schema = rows.schema.add("batch", "string")

    def pack(parts):
        from pyspark import TaskContext

        task, batch, n, total = TaskContext.get().partitionId(), 0, 0, 0
        for pdf in parts:
            at = []
            for s in pdf[size]:
                if n and (n >= most or total + s > max_bytes):
                    batch, n, total = batch + 1, 0, 0
                n, total = n + 1, total + s
                at.append(f"{task}-{batch}")
            yield pdf.assign(batch=at)

    return rows.repartitionByRange(path).sortWithinPartitions(path).mapInPandas(pack, schema)


def mirror(local: DataFrame, base: DataFrame, feed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A change feed applied to a mirror: (the new files; local edits that were kept aside).

    local: path, content, sha256 now; base: path, sha256 as last synchronized; feed: path, content, sha256, deleted.
    A local file that differs from its base is an edit: its content goes to the second result before the feed's replaces it.
    """
    f = feed.select("path", F.col("content").alias("_c"), F.col("sha256").alias("_s"), "deleted")
    j = local.join(f, "path", "full_outer").join(base.select("path", F.col("sha256").alias("_b")), "path", "left")
    touched = F.col("deleted").isNotNull()
    edited = touched & F.col("sha256").isNotNull() & ~F.col("sha256").eqNullSafe(F.col("_b")) & ~F.col("sha256").eqNullSafe(F.col("_s"))
    kept = j.filter(edited).select("path", "content", "sha256")
    files = j.filter(~touched | ~F.col("deleted")).select("path", F.when(touched, F.col("_c")).otherwise(F.col("content")).alias("content"), F.when(touched, F.col("_s")).otherwise(F.col("sha256")).alias("sha256"))
    return files, kept


def apply_feed(local: DataFrame, base: DataFrame, feed: DataFrame, blocked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """mirror() but for paths that can't be written now (blocked: path): (files; edits kept aside; the feed's rows still to be applied)."""
    wait = feed.join(blocked.select("path").distinct(), "path", "left_semi")
    files, kept = mirror(local, base, feed.join(blocked.select("path").distinct(), "path", "left_anti"))
    return files, kept, wait


def import_plan(local: DataFrame, remote: DataFrame, done: DataFrame, overwrite: bool = False) -> tuple[DataFrame, DataFrame]:
    """(what is still to be written, in batches; paths that differ and are left alone) of an import.

    local: path, content, sha256; remote: path, sha256 as it is; done: path, sha256 that an earlier, broken-off run has written: what
    it wrote as it is now isn't written again.
    """
    state = classify(local.select("path", "sha256"), remote)
    wanted = state.filter(F.col("state").isin("new", "divergent") if overwrite else F.col("state") == "new").select("path")
    todo = local.join(wanted, "path", "left_semi").join(done.select("path", "sha256"), ["path", "sha256"], "left_anti").withColumn("_size", F.octet_length("content").cast("long"))
    return batches(todo, "path", "_size").drop("_size"), state.filter("state = 'divergent'").select("path") if not overwrite else state.filter("false").select("path")


def verify_import(local: DataFrame, remote: DataFrame) -> DataFrame:
    """path, state of local files that the store doesn't have as they are: missing or different."""
    j = local.select("path", F.col("sha256").alias("_a")).join(remote.select("path", F.col("sha256").alias("_b")), "path", "left")
    return j.filter("not (_a <=> _b)").select("path", F.when(F.col("_b").isNull(), "missing").otherwise("different").alias("state"))


def put_raw(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Immutable blobs: path, outcome (stored, unchanged, conflict) of incoming (path, sha256)."""
    j = incoming.join(existing.select("path", F.col("sha256").alias("_s")), "path", "left")
    return j.select("path", F.when(F.col("_s").isNull(), "stored").when(F.col("_s") == F.col("sha256"), "unchanged").otherwise("conflict").alias("outcome"))


def review_queue(events: DataFrame, status: str | None = None) -> DataFrame:
    """The newest state of every flag (id, at, status, ...)."""
    rest = [c for c in events.columns if c not in ("id", "at")]
    q = events.groupBy("id").agg(F.max_by(F.struct("at", *rest), "at").alias("_v")).select("id", "_v.*")
    return q if status is None else q.filter(F.col("status") == status)


def stale_rows(current: DataFrame, indexed: DataFrame, key: list[str], digest: str) -> DataFrame:
    """key, state of two tables of derived rows: kept, changed, new, stale (to delete)."""
    j = current.select(*key, F.col(digest).alias("_a")).join(indexed.select(*key, F.col(digest).alias("_b")), key, "full_outer")
    return j.select(*key, F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "stale").when(F.col("_a") == F.col("_b"), "kept").otherwise("changed").alias("state"))


def numbered(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """rows with rev, counted from 1 within by."""
    return rows.withColumn("rev", F.row_number().over(W.partitionBy(by).orderBy(*order)).cast("long"))
