"""The change feed as a streaming source: commits in order of seq, each whole, each once.

    spark.dataSource.register(ChangeFeed)
    spark.readStream.format("textloom_changes").option("path", log).load()

The log is a folder of Parquet files of store.VERSIONS, to which writers add files. An offset is a seq, so a micro-batch ends
between commits wherever it ends, and a query that starts again from its checkpoint goes on behind the last commit it has
finished. What is new is found in the files' footers; a batch is planned in ranges of seq, about `ranges` of equal numbers of
rows by the files' row groups, and each task reads only the row groups and columns of its range, a few thousand rows at a time. Rows come in no order within
a batch. `until` stops at a seq: drain_pages() uses it to take a long backlog in batches of bounded size.

Writers add commits in order: a seq not above the highest that a reader has seen is not read by it any more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from textloom.operators.store import VERSIONS
from textloom.streaming import feed

_COLUMNS = ["seq", "path", "rev", "content", "sha256", "deleted"]
_ARROW = pa.schema([("seq", pa.int64()), ("path", pa.string()), ("rev", pa.int64()), ("content", pa.string()), ("sha256", pa.string()), ("deleted", pa.bool_())])
#: Rows of a batch that is read, and bytes of a column chunk that are read at once.
_ROWS, _BUFFER = 4096, 1 << 20


class Span(InputPartition):
    def __init__(self, after: int, upto: int):
        self.after, self.upto = after, upto


def _log(path: str) -> ds.Dataset:
    fs, root = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return ds.dataset(root, filesystem=fs, format="parquet", schema=_ARROW, exclude_invalid_files=False)


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.since, self.ranges = options["path"], int(options.get("since", -1)), int(options.get("ranges", 8))
        self.until = int(options["until"]) if "until" in options else None
        self._footers: dict[str, list[tuple[int, int, int]]] = {}  # a file never changes, so its footer is read once

    def _groups(self) -> list[tuple[int, int, int]]:
        """(least seq, greatest seq, rows) of every row group."""
        out = []
        for f in _log(self.path).get_fragments():
            if f.path not in self._footers:
                own = [(g.statistics["seq"], g.num_rows) for g in f.row_groups if g.num_rows]
                self._footers[f.path] = [(s["min"], s["max"], n) for s, n in own]
            out += self._footers[f.path]
        return out

    def initialOffset(self) -> dict:
        return {"seq": self.since}

    def latestOffset(self) -> dict:
        last = max((b for _, b, _ in self._groups()), default=self.since)
        return {"seq": max(self.since, last if self.until is None else min(last, self.until))}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        after, upto = start["seq"], end["seq"]
        own = sorted((max(a, after + 1), min(b, upto), n) for a, b, n in self._groups() if b > after and a <= upto)
        total, cuts, rows = sum(n for *_, n in own), [], 0
        for _, b, n in own:  # a range ends where a row group does, so that few of them are read twice
            rows += n
            if rows * self.ranges >= total * (len(cuts) + 1) and (not cuts or b > cuts[-1]) and b < upto:
                cuts.append(b)
        edges = [after, *cuts, upto]
        return [Span(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if a < b] if own else []

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        where = (ds.field("seq") > partition.after) & (ds.field("seq") <= partition.upto)
        # pages of a column chunk are read as they are needed, and few rows ahead: a task's memory doesn't grow with its range
        reading = ds.ParquetFragmentScanOptions(use_buffered_stream=True, buffer_size=_BUFFER, pre_buffer=False)
        ahead = {"batch_size": _ROWS, "batch_readahead": 1, "fragment_readahead": 1, "use_threads": False, "cache_metadata": False}
        for fragment in _log(self.path).get_fragments(filter=where):
            for batch in fragment.to_batches(schema=_ARROW, columns=_COLUMNS, filter=where, fragment_scan_options=reading, **ahead):
                if batch.num_rows:
                    yield batch
        pa.default_memory_pool().release_unused()


class ChangeFeed(DataSource):
    """Format textloom_changes; options path, since (exclusive, -1), until (inclusive) and ranges (8)."""

    @classmethod
    def name(cls) -> str:
        return "textloom_changes"

    def schema(self) -> str:
        return VERSIONS

    def streamReader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def changes(spark: SparkSession, path: str, **options) -> DataFrame:
    """The stream of all versions that are added to the log at path."""
    spark.dataSource.register(ChangeFeed)
    return spark.readStream.format("textloom_changes").options(path=path, **options).load()


def drain_pages(spark: SparkSession, path: str, each: Callable[[DataFrame, int], None], checkpoint: str, commits: int, **options) -> None:
    """Takes what the log has in micro-batches of about so many seqs; a later call goes on where this one ended."""
    last = _Reader({"path": path}).latestOffset()["seq"]
    at = _finished(spark, checkpoint, int(options.get("since", -1)))
    while at < last:
        at = min(last, at + commits)
        feed.drain(changes(spark, path, until=at, **options), each, checkpoint)


def _finished(spark: SparkSession, checkpoint: str, since: int) -> int:
    """The last seq that a query with this checkpoint has planned."""
    import json

    from textloom.runtime import _filesystem

    fs, root = _filesystem(spark, f"{checkpoint}/offsets")
    names = [int(s.getPath().getName()) for s in fs.listStatus(root) if s.getPath().getName().isdigit()] if fs.exists(root) else []
    if not names:
        return since
    text = spark.read.text(f"{checkpoint}/offsets/{max(names)}", wholetext=True).first()[0]
    return int(json.loads(text.strip().splitlines()[-1])["seq"])
