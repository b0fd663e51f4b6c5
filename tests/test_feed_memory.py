"""A range of the log is read a few thousand rows at a time."""

import pyarrow as pa
import pyarrow.parquet as pq

from textloom.streaming import change_source


def test_batches_are_small_whatever_the_row_group(tmp_path):
    n = 60_000
    rows = pa.table({"seq": [i // 3 for i in range(n)], "path": ["p"] * n, "rev": [1] * n, "content": ["x"] * n, "sha256": [None] * n, "deleted": [False] * n}, schema=change_source._ARROW)
    for k in range(2):
        pq.write_table(rows.slice(k * n // 2, n // 2), tmp_path / f"part{k}.parquet", row_group_size=n)
    batches = list(change_source._Reader({"path": str(tmp_path)}).read(change_source.Span(4, 15_000)))
    assert max(b.num_rows for b in batches) <= 4096
    assert [s for b in batches for s in b.column("seq").to_pylist()] == [i // 3 for i in range(n) if 4 < i // 3 <= 15_000]
