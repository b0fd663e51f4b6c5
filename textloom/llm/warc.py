"""WARC archives with revisit resolution.

Payload digests and sizes are headers: they are shuffled by digest (grouped with map-side combining), the smallest
page_id of each digest with more than one page becomes the original response, and the others revisit it. The join back
broadcasts only the fewer than 2,000 digests that hold more than 1/2,000 of all pages and salts their rows. Archives
are then written with fresh headers by Spark's text writer, a record per value, ended by an empty line as the format
asks; payloads of revisits aren't written. read() parses archives record by record by Content-Length, streaming within a
file, and resolve() joins revisits to their originals by record id.

Spark's writer ends a file after a number of records, so payloads are written by size class (powers of two), each with
as many records a file as make up `file_bytes`: a reader's memory is bounded by that and the longest page. A file is
one gzip member, since the writer compresses files; records are found by reading a file from its start.

Defined results: a null payload is empty; payloads under `min_bytes` are always responses. Equal payloads with the same
page_id (repeated rows) are each a response or revisit of that page_id as the smallest id says; a null page_id never
stands first, and has neither id nor reference in the archive. A null URL has no target header; control characters in
URLs are percent-encoded. Very long payloads are written and read whole. Empty tables give empty archives and results.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm._shared import cut, skew_join

MIN_BYTES = 100
#: Payload bytes of a file; a larger payload is a file of its own.
FILE_BYTES = 64 << 20
#: Payloads up to 2 to this power share files; beyond, each power has files of its own.
_SMALL = 15
# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"


def plan(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """pages with payload (string), payload_bytes, payload_digest and refers_to (null for responses)."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    p = p.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2(F.col("payload").cast("binary"), 256).alias("payload_digest"))
    # pages below the limit have no partner and no key, so that the join deals them out at random
    p = p.withColumn("key", F.when(F.col("payload_bytes") >= min_bytes, F.col("payload_digest")))
    originals = cut(p.filter("key is not null").select("page_id", "key").groupBy("key").agg(F.min("page_id").alias("original"), F.count("*").alias("n")).filter("n > 1"))
    total = originals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    joined = skew_join(p, originals, "key", "n", total, F.monotonically_increasing_id())
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(F.col("original") != F.col("page_id"), F.col("original")).alias("refers_to"))


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(":", page_id.cast("string"), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def records(planned: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One column value: a record without its closing empty line."""
    revisit = F.col("refers_to").isNotNull()
    uri = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), r"[\x00-\x20\x7F]", "%20")
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END + END))
    block = F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    headers = [
        F.lit(VERSION),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("payload_digest"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", uri),
        line("WARC-Page-ID", F.col("page_id").cast("string")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, line("WARC-Refers-To", _record_id(F.col("refers_to"), F.col("payload_digest")))),
        F.when(revisit, F.lit(f"WARC-Refers-To-Date: {date}")),
        F.lit("Content-Type: application/http;msgtype=response"),
        line("Content-Length", F.octet_length(block).cast("string")),
    ]
    return planned.select(F.concat(F.concat_ws(END, *headers), F.lit(END + END), block).alias("value"))


def write(planned: DataFrame, path: str, file_bytes: int = FILE_BYTES, compression: str = "gzip") -> None:
    """Archives under path, a new folder."""
    power = F.greatest(F.lit(_SMALL), F.ceil(F.log2(F.greatest("payload_bytes", F.lit(1).cast("long")))).cast("int"))
    # at most about 16 classes; each job reads the pages' lengths, and hashes and joins those of its class
    classes = sorted(r[0] for r in planned.select(power.alias("p")).distinct().collect()) or [_SMALL]
    for p in classes:
        own = planned.filter(power == p) if len(classes) > 1 else planned
        out = records(own).write.mode("append").option("lineSep", END + END).option("compression", compression)
        out.option("maxRecordsPerFile", max(1, file_bytes >> p)).text(path)


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("a record is cut off")
        yield headers, block


_ROWS = "page_id long, record_id string, record_type string, url string, refers_to_id string, payload_bytes long, payload_digest string"


def _read(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _ROWS.split(", ")] + ["payload"] * payloads
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()] + [pa.binary()] * payloads
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                raw = content.as_buffer()
                stream = io.BytesIO(raw) if not path.as_py().endswith(".gz") else io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(raw)))
                rows: list[tuple] = []
                size = 0
                for h, block in parse(stream):
                    payload = block.partition(b"\r\n\r\n")[2]
                    revisit = h["warc-type"] == "revisit"
                    digest = h.get("warc-payload-digest", "").removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest()
                    row = (int(h["warc-page-id"]) if "warc-page-id" in h else None, h["warc-record-id"], h["warc-type"], h.get("warc-target-uri"), h.get("warc-refers-to"), None if revisit else len(payload), digest)
                    rows.append(row + (payload,) * payloads)
                    size += len(payload)
                    if size > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of all archives under path: headers, size and digest of the payload (null size for revisits)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_read(payloads), _ROWS + ", payload binary" * payloads)


def resolve(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """page_id, keep, payload_bytes, payload_digest, record_type, refers_to: revisits joined to their originals by record id."""
    rows = rows.withColumn("key", F.coalesce("refers_to_id", "record_id"))
    named = rows.filter(F.col("record_type") == "revisit").groupBy("key").agg(F.count("*").alias("n"))
    first = rows.filter(F.col("record_type") == "response").groupBy(F.col("record_id").alias("key")).agg(F.min(F.struct("page_id", "payload_bytes", "payload_digest")).alias("o"))
    originals = cut(named.join(first, "key").select("key", "n", "o"))
    total = originals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    joined = skew_join(rows, originals, "key", "n", total, F.struct("page_id", "record_id"))
    revisit = F.col("record_type") == "revisit"
    return joined.select(
        "page_id", *keep, F.when(revisit, F.col("o.payload_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("o.payload_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", F.when(revisit, F.col("o.page_id")).alias("refers_to"),
    )


def dedupe(spark: SparkSession, source: str, target: str, min_bytes: int = MIN_BYTES) -> None:
    """Reads archives and writes deduplicated ones with fresh headers.

    Who refers to whom follows from headers alone; a payload moves once, to the page that becomes the response. Payloads under min_bytes are
    so short that they may be broadcast.
    """
    rows = read(spark, source, payloads=True)
    heads = cut(resolve(rows.drop("payload"), ("url",)).select("page_id", "url", "payload_bytes", "payload_digest"))
    held = rows.filter("record_type = 'response'").select("payload_digest", F.col("payload").cast("string").alias("payload")).dropDuplicates(["payload_digest"])
    headers = heads.filter(F.col("payload_bytes") >= min_bytes)
    originals = cut(headers.groupBy("payload_digest").agg(F.min("page_id").alias("original"), F.count("*").alias("n")))
    total = heads.count()
    large = skew_join(headers, originals, "payload_digest", "n", total, F.struct("page_id", "url")).drop("n")
    large = cut(large.withColumn("refers_to", F.when(F.col("original") != F.col("page_id"), F.col("original"))).drop("original"))
    short = heads.filter(F.col("payload_bytes") < min_bytes)
    counts = short.groupBy("payload_digest").agg(F.count("*").alias("n"))
    small = skew_join(short, cut(counts.join(held, "payload_digest")), "payload_digest", "n", total, F.struct("page_id", "url")).withColumn("refers_to", F.lit(None).cast("long"))
    columns = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to"]
    parts = [large.filter("refers_to is null").join(held, "payload_digest"), large.filter("refers_to is not null").withColumn("payload", F.lit("")), small]
    write(parts[0].select(*columns).unionByName(parts[1].select(*columns)).unionByName(parts[2].select(*columns)), target)
