"""Exports of a store: newline-delimited JSON with a closing row, and archives of all pages."""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators import store as St

_FIELDS = ("path", "rev", "sha256", "bytes", "content")


def ndjson(versions: DataFrame) -> DataFrame:
    """ord, value: a line per live page in order of path, then one with done and the seq to go on from; sort by ord."""
    page = St.live(versions).withColumn("bytes", F.octet_length("content").cast("long"))
    rows = page.select(F.concat(F.lit("0"), "path").alias("ord"), F.to_json(F.struct(*_FIELDS)).alias("value"))
    done = versions.agg(F.lit("1").alias("ord"), F.to_json(F.struct(F.lit(True).alias("done"), F.coalesce(F.max("seq"), F.lit(0).cast("long")).alias("seq"))).alias("value"))
    return rows.unionByName(done)


def write_ndjson(versions: DataFrame, path: str) -> None:
    ndjson(versions).orderBy("ord").select("value").write.text(path)


def lines(exported: DataFrame) -> Iterator[str]:
    """The lines one by one; the driver holds a partition at a time."""
    for r in exported.orderBy("ord").toLocalIterator():
        yield r.value


def write_tar(stream: Iterable[str], target: str) -> int:
    """Writes the pages of an export and a manifest into a tar.gz file; returns the seq. Raises ValueError if the stream has no closing row."""
    files: dict[str, str] = {}
    seq = None
    with tarfile.open(target, "w:gz") as tar:

        def add(name: str, data: bytes) -> None:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))

        for line in stream:
            row = json.loads(line)
            if row.get("done"):
                seq = row["seq"]
                break
            add(row["path"], row["content"].encode())
            files[row["path"]] = row["sha256"]
        if seq is not None:
            add("manifest.json", json.dumps({"seq": seq, "files": files}, sort_keys=True, ensure_ascii=False).encode())
    if seq is None:
        raise ValueError("the export ended before its closing row")
    return seq


def read_tar(source: str) -> tuple[dict, dict[str, str]]:
    """(manifest, contents by path) of such an archive."""
    with tarfile.open(source, "r:gz") as tar:
        found = {m.name: tar.extractfile(m).read().decode() for m in tar}
    return json.loads(found.pop("manifest.json")), found
