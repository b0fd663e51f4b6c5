"""The cache of tokens is as large as asked for, and the rows don't depend on it."""

import pyarrow as pa

import corpus_pipeline
from textloom.llm import packing
from textloom.llm.queries import tokenizer_path


def test_rows_are_the_same_with_a_small_cache(spark):
    docs = spark.range(60).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 80), i -> concat('w', id * i, 'x,'))) AS text").coalesce(2)
    small, large = (sorted(packing.pack(docs, tokenizer_path(), entries=n).select("doc_id", "piece", "start", "length", "ids_crc32").collect()) for n in (20, 100_000))
    assert small == large and len(small) >= 60


def test_cache_is_bounded(monkeypatch):
    class Context:
        @staticmethod
        def get():
            return Context

        @staticmethod
        def partitionId():
            return 0

    monkeypatch.setattr(packing, "TaskContext", Context)
    texts = [" ".join(f"w{i * j}x," for j in range(200)) for i in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(50), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    list(packing._local(tokenizer_path(), 2048, 0, 1000, 30)([batch]))
    (encoder,) = packing._encoders.values()
    assert len(encoder.chunks) + len(encoder.chunks.older) <= 2 * 30 + 4
    assert corpus_pipeline.CACHE_ENTRIES < packing._CACHE_ENTRIES
