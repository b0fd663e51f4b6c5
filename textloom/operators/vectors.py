"""The life of a vector index: what to embed, what to drop, and states of vectors that a service applies later.

Everything compares two tables of rows by key and digest; only changed texts reach an embedder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import text as X
from textloom.operators.store import stale_rows

PENDING, SENT, CONFIRMED = 0, 1, 2
# Milliseconds and numbers of the life cycle.
VERIFY_AGE, RESEND_AFTER, BACKOFF, BACKOFF_MOST, BATCH = 30_000, 600_000, 30_000, 3_600_000, 100

Embedder = Callable[[list[str]], list[list[float]]]


def usable(index: DataFrame, meta: dict[str, str], expected: dict[str, str]) -> DataFrame:
    """The index if it was made the way that is expected (schema, model, dimension), else none of it."""
    return index if meta == expected else index.limit(0)


def embedded(rows: DataFrame, text: str, embedder: Embedder) -> DataFrame:
    """rows with embedding, in Arrow batches; the embedder runs on the executors."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            vectors = embedder(pdf[text].tolist())
            if len(vectors) != len(pdf):
                raise ValueError("the embedder must give a vector for every text")
            yield pdf.assign(embedding=vectors)

    return rows.mapInPandas(run, T.StructType([*rows.schema, T.StructField("embedding", T.ArrayType(T.FloatType()))]))


def sync(sections: DataFrame, index: DataFrame, key: list[str], text: str, model: str, embedder: Embedder) -> DataFrame:
    """The index (key, content_hash, embedding) of the sections as they are: new and changed texts are embedded, equal ones keep their vector."""
    now = sections.select(*key, X.content_hash(model, text).alias("content_hash"), F.col(text).alias("_text"))
    kept = index.select(*key, "content_hash", "embedding").join(now.select(*key, "content_hash"), [*key, "content_hash"], "left_semi")
    new = now.join(kept.select(*key), key, "left_anti")
    return kept.unionByName(embedded(new, "_text", embedder).select(*kept.columns))


def states(sections: DataFrame, index: DataFrame, key: list[str], text: str, model: str) -> DataFrame:
    """key, state: kept, changed, new or stale."""
    return stale_rows(sections.select(*key, X.content_hash(model, text).alias("content_hash")), index, key, "content_hash")


def readiness(pages: DataFrame, sections: DataFrame, index: DataFrame, key: list[str]) -> DataFrame:
    """One row: pages, sections, vectors, and ready: every section has one vector and no other vector is there."""
    j = sections.select(*key).withColumn("_s", F.lit(1)).join(index.select(*key).withColumn("_v", F.lit(1)), key, "full_outer")
    n = j.agg(F.count("_s").alias("sections"), F.count("_v").alias("vectors"), F.count_if(F.col("_s").isNull() | F.col("_v").isNull()).alias("_odd"))
    return pages.agg(F.count("*").alias("pages")).crossJoin(F.broadcast(n)).select("pages", "sections", "vectors", (F.col("_odd") == 0).alias("ready"))  # one row each


# --- vectors that a service applies later: sections (path, section_index, vector_id, vec_state, sent_at, checked_at)

STATE = ["vec_state", "sent_at", "checked_at"]


def carry_over(old: DataFrame, new: DataFrame, deletes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new sections with the states of vectors they keep; the queue of vector_ids to delete).

    old: sections before; new: sections now, of the same pages, without states. A vector that was sent and isn't wanted any more is queued,
    and one that is wanted again is taken from the queue.
    """
    had = old.filter(F.col("vec_state") > PENDING).groupBy("vector_id").agg(F.max(F.struct(*STATE)).alias("_o"))
    rows = new.join(had, "vector_id", "left").select(*new.columns, F.coalesce(F.col("_o.vec_state"), F.lit(PENDING)).alias("vec_state"), F.col("_o.sent_at").alias("sent_at"), F.lit(None).cast("long").alias("checked_at"))
    queue = had.select("vector_id").unionByName(deletes.select("vector_id")).distinct().join(new.select("vector_id"), "vector_id", "left_anti")
    return rows, queue


def pending(sections: DataFrame, n: int = BATCH) -> DataFrame:
    """The next batch to embed and send, in order of path and section."""
    return sections.filter(F.col("vec_state") == PENDING).orderBy("path", "section_index").limit(n)


def mark_sent(sections: DataFrame, batch: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(sections after a batch was sent; vector_ids of the batch that no section wants any more, to be deleted)."""
    sent = F.col("_sent").isNotNull() & (F.col("vec_state") == PENDING)
    j = sections.join(batch.select("path", "section_index", "vector_id", F.lit(True).alias("_sent")), ["path", "section_index", "vector_id"], "left")
    rows = j.select(
        *[c for c in sections.columns if c not in STATE], F.when(sent, SENT).otherwise(F.col("vec_state")).alias("vec_state"), F.when(sent, F.lit(now).cast("long")).otherwise(F.col("sent_at")).alias("sent_at"),
        F.when(~sent, F.col("checked_at")).alias("checked_at"),
    )
    return rows, batch.select("vector_id").distinct().join(sections.select("vector_id"), "vector_id", "left_anti")


def due(sections: DataFrame, now: int, n: int = BATCH) -> DataFrame:
    """Sent vectors to look for now: not checked within VERIFY_AGE, the longest unchecked first."""
    last = F.coalesce("checked_at", F.lit(0).cast("long"))
    s = sections.filter((F.col("vec_state") == SENT) & (F.col("sent_at") <= now - VERIFY_AGE) & (last <= now - VERIFY_AGE))
    return s.orderBy(last, "sent_at", "path", "section_index").limit(n)


def verify(sections: DataFrame, checked: DataFrame, found: DataFrame, now: int) -> DataFrame:
    """sections after vectors were looked for: found ones are confirmed, ones missing for RESEND_AFTER wait to be sent again."""
    j = sections.join(checked.select("path", "section_index", "vector_id", F.lit(True).alias("_c")), ["path", "section_index", "vector_id"], "left")
    j = j.join(found.select("vector_id").distinct().withColumn("_f", F.lit(True)), "vector_id", "left")
    own = F.col("_c").isNotNull() & (F.col("vec_state") == SENT)
    lost = own & F.col("_f").isNull() & (F.lit(now) - F.col("sent_at") >= RESEND_AFTER)
    return j.select(
        *[c for c in sections.columns if c not in STATE], F.when(own & F.col("_f").isNotNull(), CONFIRMED).when(lost, PENDING).otherwise(F.col("vec_state")).alias("vec_state"),
        F.when(~lost | lost.isNull(), F.col("sent_at")).alias("sent_at"), F.when(lost, F.lit(None).cast("long")).when(own, F.lit(now).cast("long")).otherwise(F.col("checked_at")).alias("checked_at"),
    )


def backoff(failures: int) -> int:
    """Milliseconds to wait after so many failures in a row."""
    return min(BACKOFF_MOST, BACKOFF * 2 ** (failures - 1)) if failures > 0 else 0
