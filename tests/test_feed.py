"""The change feed as a stream, the mirror that follows it, and snapshots that are swapped."""

import random

import pytest

from textloom.operators import snapshots, store
from textloom.streaming import change_source, mirror


def made_up(r, n=60):
    """Versions of n commits of one to four paths."""
    rows, revs = [], {}
    for seq in range(n):
        for p in r.sample("abcdefghij", r.randint(1, 4)):
            revs[p] = revs.get(p, 0) + 1
            gone = r.random() < 0.25
            rows.append((seq, p, revs[p], None if gone else f"{p}{seq % 7}", None if gone else store._sha(f"{p}{seq % 7}"), gone))
    return rows


def log(spark, folder, rows, files=4):
    step = -(-60 // files)
    for i in range(files):
        own = [x for x in rows if i * step <= x[0] < (i + 1) * step]
        spark.createDataFrame(own, store.VERSIONS).repartition(2).write.mode("append").parquet(folder)


@pytest.mark.parametrize("broken", [None, 1, 2])
def test_each_commit_once(spark, tmp_path, broken):
    rows = made_up(random.Random(2))
    folder, out, seen, fail = str(tmp_path / "log"), str(tmp_path / "out"), {}, [broken]
    log(spark, folder, [x for x in rows if x[0] < 45])

    def each(df, batch):
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        if fail[0] == batch:  # after it was written, before Spark notes it
            fail[0] = None
            raise RuntimeError("lost")
        seen[batch] = {x.seq for x in df.select("seq").collect()}

    def run():
        change_source.drain_pages(spark, folder, each, str(tmp_path / "checkpoint"), 13, ranges=3)

    if broken is not None:
        with pytest.raises(Exception, match="lost"):
            run()
    run()
    log(spark, folder, [x for x in rows if x[0] >= 45])
    run()
    run()  # nothing is new
    got = [tuple(x) for x in spark.read.parquet(out).select("seq", "path", "rev", "content", "sha256", "deleted").collect()]
    assert sorted(got, key=str) == sorted(rows, key=str)
    assert len(seen) >= 5 and sum(map(len, seen.values())) == 60  # no commit is in two batches


def test_ranges_and_options(spark, tmp_path):
    folder = str(tmp_path / "log")
    log(spark, folder, made_up(random.Random(3)))
    reader = change_source._Reader({"path": folder, "ranges": 4})
    assert reader.latestOffset() == {"seq": 59} and reader.initialOffset() == {"seq": -1}
    spans = reader.partitions({"seq": 9}, {"seq": 59})
    assert 2 <= len(spans) <= 5 and (spans[0].after, spans[-1].upto) == (9, 59) and all(a.upto == b.after for a, b in zip(spans, spans[1:], strict=False))
    assert reader.partitions({"seq": 59}, {"seq": 59}) == []
    assert {s for b in reader.read(change_source.Span(10, 12)) for s in b.column("seq").to_pylist()} == {11, 12}
    assert change_source._Reader({"path": folder, "until": 20, "since": 5}).latestOffset() == {"seq": 20}


def test_mirror_equals_plain_python(spark, tmp_path):
    r = random.Random(7)
    rows = made_up(r)
    files, base, pending, kept = {"a": "a0", "z": "mine"}, {}, {}, []
    blocked: list[set] = [{"a", "c"}, {"c", "d"}, set(), {"e"}, set()]
    now: list[str] = []
    m = mirror.Mirror(spark, str(tmp_path / "mirror"), lambda: spark.createDataFrame([(p,) for p in now], "path string"))
    m.start(spark.createDataFrame([(p, c, store._sha(c)) for p, c in files.items()], mirror.FILES))
    base = {p: (store._sha(c), -1) for p, c in files.items()}
    for batch in range(5):
        if batch == 2:  # someone edits two files here, and makes one
            have = {x.path: x.content for x in m.table("files").collect()}
            assert have == files
            own = sorted(files)[0]
            files |= {own: "edited here", "b": "made here"}
            m.store.publish("edit", {"files": spark.createDataFrame([(p, c, store._sha(c)) for p, c in files.items()], mirror.FILES), **{t: m.table(t) for t in ("base", "pending", "kept")}})
        own = [x for x in rows if batch * 12 <= x[0] < batch * 12 + 12]
        now[:] = blocked[batch]
        frame = spark.createDataFrame(own, store.VERSIONS)
        m.apply(frame, batch)
        m.apply(frame, batch)  # a repeated batch changes nothing
        newest = dict(pending)
        for seq, p, _, content, sha, gone in own:
            if p not in newest or newest[p][0] < seq:
                newest[p] = (seq, content, sha, gone)
        pending = {}
        for p, (seq, content, sha, gone) in newest.items():
            if seq <= base.get(p, (None, -2))[1]:
                continue
            if p in blocked[batch]:
                pending[p] = (seq, content, sha, gone)
                continue
            here = files.get(p)
            if here is not None and store._sha(here) != base.get(p, (None,))[0] and store._sha(here) != sha:
                kept.append((p, here, batch))
            files.pop(p, None)
            if not gone:
                files[p] = content
            base[p] = (sha, seq)
    assert {x.path: x.content for x in m.table("files").collect()} == files
    assert {x.path: (x.sha256, x.seq) for x in m.table("base").collect()} == base
    assert {x.path: (x.seq, x.content, x.sha256, x.deleted) for x in m.table("pending").collect()} == pending
    assert sorted((x.path, x.content, x.batch) for x in m.table("kept").collect()) == sorted(kept) and kept
    assert m.store.collect(keep=1) and {x.path for x in m.table("files").collect()} == set(files)


def test_mirror_follows_the_stream(spark, tmp_path):
    rows = made_up(random.Random(5))
    log(spark, str(tmp_path / "log"), rows)
    m = mirror.Mirror(spark, str(tmp_path / "mirror"))
    change_source.drain_pages(spark, str(tmp_path / "log"), m.apply, str(tmp_path / "checkpoint"), 25)
    want = {x.path: x.content for x in store.live(spark.createDataFrame(rows, store.VERSIONS)).collect()}
    assert {x.path: x.content for x in m.table("files").collect()} == want and m.table("pending").count() == 0


def test_snapshots_swap(spark, tmp_path):
    s = snapshots.Snapshots(spark, str(tmp_path / "graph"))
    ids = lambda pin=None: sorted(x.id for x in s.table("nodes", "id long", pin).collect())
    assert s.current() is None and ids() == []
    s.publish("one", {"nodes": spark.range(3), "edges": spark.range(2)})
    pin, steps = s.current(), []

    def broken():
        steps.append("edges")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        s.publish("two", {"nodes": lambda: steps.append("nodes") or spark.range(5), "edges": broken})
    assert ids() == [0, 1, 2] and s.current() == "one" and not s.has("two")
    s.publish("two", {"nodes": lambda: steps.append("nodes") or spark.range(9), "edges": spark.range(4)})
    assert steps == ["nodes", "edges"] and ids() == [0, 1, 2, 3, 4] and ids(pin) == [0, 1, 2]  # the first step wasn't done again
    s.publish("two", {"nodes": spark.range(1)})
    assert s.current() == "two" and len(ids()) == 5
    s.publish("three", {"nodes": spark.range(1), "edges": spark.range(1)})
    assert s.collect(keep=1, pins=("one",)) == ["two"] and ids() == [0] and ids(pin) == [0, 1, 2]


def test_scratch_is_removed(spark):
    from textloom.runtime import Scratch, _filesystem

    with Scratch(spark) as scratch:
        assert scratch.keep(spark.range(7)).count() == 7
        fs, root = _filesystem(spark, scratch.root)
        assert fs.exists(root)
    assert not fs.exists(root)
