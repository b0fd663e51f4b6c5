"""Pages that only grow: work by what is appended, with the sizes and digests of the whole texts."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from textloom.operators import commits, store

REQUESTS = "seq long, ops string, log string, author string, today string"


def test_work_goes_by_what_is_appended(monkeypatch):
    seen, size = [], store._size
    monkeypatch.setattr(store, "_size", lambda s: seen.append(len(s)) or size(s))
    state = store._State({}, {})
    for i in range(2000):
        ((_, rev, _, sha, _),) = store.written(state, [{"op": "append", "path": "p", "text": "line", "create": True}])
        assert rev == i + 1
    assert state.get("p") == (2000, "line\n" * 2000) and sha == hashlib.sha256(b"line\n" * 2000).hexdigest()
    assert sum(seen) < 100_000


def test_equal_to_texts_that_are_made_anew():
    r, state, want = random.Random(7), store._State({}, {}), {}
    made = []
    for _ in range(600):
        p, text = r.choice("ab"), r.choice(["x", "é\n", "", "z\n\n", "\n", "y\nw"])
        ops, now = [{"op": "append", "path": p, "text": text, "create": True}], dict(want)
        now[p] = store.append_text(now.get(p) or "", text)
        kind = r.random()
        if kind < 0.2:  # refused as a whole
            ops.append({"op": "create", "path": p, "content": "no"})
        elif kind < 0.3:
            ops.append({"op": "edit", "path": p, "edits": [{"old": "\n", "new": "!\n", "replace_all": True}]})
            now[p] = now[p].replace("\n", "!\n")
        elif kind < 0.4 and state.get(p)[1] is not None:
            ops, now = [{"op": "delete", "path": p, "base_rev": state.get(p)[0]}], now | {p: None}
        try:
            made += [(store.plain(content), sha) for _, _, content, sha, _ in store.written(state, ops)]
            want = now
        except store.Conflict as e:
            assert e.reason == "exists"
        assert {q: state.get(q)[1] for q in want} == want
    assert all(sha == (None if c is None else hashlib.sha256(c.encode()).hexdigest()) for c, sha in made) and len(made) > 300


def test_sizes_and_digests_without_texts(spark):
    r = random.Random(8)
    rows = [(i, json.dumps([{"op": "append", "path": f"g{i % 3}", "text": "é" * r.randint(0, 3), "create": True}, {"op": "upsert", "path": f"u{r.randint(0, 4)}", "content": str(i)}]), None, None, None) for i in range(60)]
    rows += [(99, '[{"op":"delete","path":"u0","base_rev":1}]', None, None, None), (100, '[{"op":"create","path":"g0","content":""}]', "line", "me", "2024-01-01")]
    nothing, requests = spark.createDataFrame([], store.VERSIONS), spark.createDataFrame(rows, REQUESTS)
    full, bare = (commits.apply_all(nothing, requests, texts=t).select("seq", "status", "reason", "details", F.inline_outer("versions")) for t in (True, False))
    assert full.filter("content is not null and (bytes <> octet_length(content) or sha256 <> sha2(content, 256))").isEmpty() and bare.filter("content is not null").isEmpty()
    assert sorted(map(str, full.drop("content").collect())) == sorted(map(str, bare.drop("content").collect())) and full.count() > 100
