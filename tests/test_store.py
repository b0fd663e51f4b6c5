"""Commits, conflicts, history, feeds, mirrors; evaluation operators; streams."""

import pytest
from pyspark.sql import functions as F

from textloom.operators import evaluation as E
from textloom.operators import store as St
from textloom.streaming import feed


def build(spark, commits):
    v = spark.createDataFrame([], St.VERSIONS)
    for seq, ops in enumerate(commits, 1):
        v = spark.createDataFrame(v.unionByName(St.commit(spark, v, ops, seq)).collect(), St.VERSIONS)
    return v


@pytest.fixture(scope="module")
def log(spark):
    return build(spark, [
        [{"op": "create", "path": "a", "content": "one\ntwo"}, {"op": "create", "path": "b", "content": "x"}],
        [{"op": "edit", "path": "a", "edits": [{"old": "two", "new": "2"}]}, {"op": "append", "path": "b", "text": "y"}],
        [{"op": "move", "from": "b", "to": "c", "base_rev": 2}],
        [{"op": "upsert", "path": "a", "content": "one\n2"}],
        [{"op": "delete", "path": "c", "base_rev": 1}],
    ])


def test_versions(log):
    got = [(r.seq, r.path, r.rev, r.content) for r in log.orderBy("seq", "path").collect()]
    assert got == [(1, "a", 1, "one\ntwo"), (1, "b", 1, "x"), (2, "a", 2, "one\n2"), (2, "b", 2, "x\ny\n"), (3, "b", 3, None), (3, "c", 1, "x\ny\n"), (5, "c", 2, None)]


@pytest.mark.parametrize(
    "op, reason",
    [
        ({"op": "create", "path": "a", "content": ""}, "exists"), ({"op": "put", "path": "zz", "content": "", "base_rev": 0}, "missing"), ({"op": "put", "path": "a", "content": "", "base_rev": 1}, "stale_base_rev"),
        ({"op": "upsert", "path": "a", "content": "", "expected_sha256": "0" * 64}, "sha_mismatch"), ({"op": "upsert", "path": "zz", "content": "", "expected_sha256": "0" * 64}, "sha_mismatch"),
        ({"op": "upsert", "path": "a", "content": "", "expected_sha256": None}, "exists"), ({"op": "upsert", "path": "zz", "content": "", "expected_sha256": None}, None),
        ({"op": "edit", "path": "a", "edits": [{"old": "n", "new": ""}, {"old": "zz", "new": ""}]}, "edit_no_match"), ({"op": "edit", "path": "a", "edits": [{"old": "n", "new": "nn"}, {"old": "n", "new": ""}]}, "edit_multiple_matches"),
        ({"op": "edit", "path": "a", "edits": [{"old": "n", "new": "nn"}, {"old": "n", "new": "m", "replace_all": True}]}, None), ({"op": "delete", "path": "c", "base_rev": 2}, "missing"),
        ({"op": "delete", "path": "a", "base_rev": 1}, "stale_base_rev"), ({"op": "move", "from": "a", "to": "new", "base_rev": 2}, "exists"), ({"op": "append", "path": "zz", "text": ""}, "missing"), ({"op": "append", "path": "zz", "text": "t", "create": True}, None),
    ],
)
def test_conflicts(spark, log, op, reason):
    if reason is None:
        assert St.commit(spark, log, [op], 6).count() == 1
        return
    with pytest.raises(St.Conflict) as e:
        St.commit(spark, log, [{"op": "create", "path": "new", "content": "n"}, op], 6)
    assert e.value.reason == reason and reason in St.REASONS and e.value.details["op_index"] == 1


def test_conflicts_say_what_is_there(spark, log):
    def details(op):
        with pytest.raises(St.Conflict) as e:
            St.commit(spark, log, [op], 6)
        return e.value.details

    stale = details({"op": "put", "path": "a", "content": "", "base_rev": 1})
    assert (stale["current_rev"], stale["base_rev"]) == (2, 1) and "--- a/a@1\n+++ b/a@2\n@@ " in stale["diff"] and "-two\n+2" in stale["diff"]
    edit = details({"op": "edit", "path": "a", "edits": [{"old": "absent", "new": ""}], "base_rev": 1})
    assert "-two" in edit["diff"] and edit["current_excerpt"] == "one\n2"
    assert "diff" not in details({"op": "edit", "path": "a", "edits": [{"old": "absent", "new": ""}]})
    assert details({"op": "upsert", "path": "a", "content": "", "expected_sha256": None})["current_sha256"] == St._sha("one\n2")


def test_log_line_and_appends(spark, log):
    rows = St.commit(spark, log, [{"op": "create", "path": "s", "content": "s"}], 6, log="ingest | s\nmore", author="me", today="2024-01-02").collect()
    assert {r.path: r.content for r in rows} == {"s": "s", "log.md": "- 2024-01-02 me: ingest | s more\n"}
    assert St.append_text("# I\n\n## Concepts\n- a\n\n## Sources\n- s\n", "- b", "concepts") == "# I\n\n## Concepts\n- a\n- b\n\n## Sources\n- s\n"
    assert St.append_text("```\n## A\n```\n## A\n### deep\nx\n\n", "y\n", "## a") == "```\n## A\n```\n## A\n### deep\nx\ny\n\n"
    assert (St.append_text("", "t"), St.append_text("x\n\n", "t"), St.append_text("x", "t", "none")) == ("t\n", "x\nt\n", "x\nt\n")


def test_bad_commits():
    bad = [
        [], [{"op": "fly", "path": "a"}], [{"op": "create", "path": "a", "content": "x" * 1_600_000}], [{"op": "put", "path": "a", "content": ""}], [{"op": "delete", "path": "a"}], [{"op": "edit", "path": "a", "edits": []}],
        [{"op": "edit", "path": "a", "edits": [{"old": "", "new": "x"}]}], [{"op": "create", "path": "a/../b", "content": ""}], [{"op": "create", "path": "/a", "content": ""}], [{"op": "create", "path": "a"}],
        [{"op": "upsert", "path": "a", "content": "", "expected_sha256": "x"}], [{"op": "move", "from": "a", "base_rev": 1}], [{"op": "create", "path": "a", "content": "\ud800"}], [{"op": "create", "path": "a", "content": ""}] * 201,
    ]
    for ops in bad:
        with pytest.raises(ValueError):
            St.validate(ops)
    with pytest.raises(ValueError):
        St.validate([{"op": "create", "path": "a", "content": ""}], "m" * 20_000)


def test_growing_edits_are_refused(spark):
    v = St.commit(spark, spark.createDataFrame([], St.VERSIONS), [{"op": "create", "path": "a", "content": "x" * 1000}], 1)
    with pytest.raises(ValueError):
        St.commit(spark, v, [{"op": "edit", "path": "a", "edits": [{"old": "x", "new": "y" * 2000, "replace_all": True}]}], 2)


def test_reading_and_listing(spark):
    v = build(spark, [[{"op": "create", "path": "a/x", "content": "# H\none\n## Sub\ntwo\n# Z\nend"}, {"op": "create", "path": "a/y", "content": "é"}, {"op": "create", "path": "b", "content": ""}], [{"op": "delete", "path": "b", "base_rev": 1}]])
    want = spark.createDataFrame([("a/x",), ("b",), ("none",)], "path string")
    got = {r.path: (r.found, r.content) for r in St.read(v, want, heading="h").collect()}
    assert got == {"a/x": (True, "# H\none\n## Sub\ntwo"), "b": (False, None), "none": (False, None)}
    assert {r.content for r in St.read(v, want.limit(1), start=2, end=3).collect()} == {"one\n## Sub"}
    assert {r.content for r in St.read(v, want.limit(1), heading="sub", start=2).collect()} == {"two"}
    assert {(r.path, r.bytes) for r in St.listing(v, "a/").collect()} == {("a/x", 26), ("a/y", 2)} and St.listing(v).count() == 2
    first = St.export_page(v, n=1).collect()
    assert [(r.path, r.more) for r in first] == [("a/x", True)] and [(r.path, r.more) for r in St.export_page(v, "a/x", 1).collect()] == [("a/y", False)]
    sections = spark.createDataFrame([(0,), (1,), (2,)], "vec_state int")
    flags = spark.createDataFrame([("f", 1, "open"), ("f", 2, "resolved"), ("g", 1, "open")], "id string, at int, status string")
    o = St.overview(v, sections, flags).first()
    assert (o.seq, o.pages, o.bytes, o.sections, o.vector_lag, o.open_review_flags) == (2, 2, 28, 3, 2, 1)
    closed = St.resolve_flags(flags, spark.createDataFrame([("g",), ("f",)], "id string"), 9)
    assert [tuple(r) for r in closed.collect()] == [("g", 9, "resolved")]
    out = St.register(spark.createDataFrame([("one",)], "id string"), spark.createDataFrame([("one",), ("two",), ("Bad",), (None,)], "id string"))
    assert {r.id: r.outcome for r in out.collect()} == {"one": "kept", "two": "created", "Bad": "invalid", None: "invalid"}
    assert St.anything(v.limit(0), v) and not St.anything(v.limit(0), flags.limit(0))


def test_diff_of_many_lines_is_one_block():
    a = "\n".join(["same"] + [f"old {i}" for i in range(700)] + ["end"])
    d = St.unified_diff(a, a.replace("old", "new")).split("\n")
    assert d[:4] == ["--- before", "+++ after", "@@ -1,702 +1,702 @@", " same"] and d[4] == "-old 0" and d[704] == "+new 0" and d[-1] == " end"


def test_state_and_feed(log):
    assert {r.path for r in St.live(log).collect()} == {"a"}
    assert {r.path for r in St.as_of(log, 3).collect()} == {"a", "c"}
    assert [(r.path, r.seq, r.deleted) for r in St.changes(log, 2).orderBy("seq", "path").collect()] == [("b", 3, True), ("c", 5, True)]
    assert {r.path for r in St.changes(log, 0, 1).collect()} == {"a"}


def test_history_diff_revert(log):
    h = St.history(log, log.select("seq").distinct(), path="b").collect()
    assert [(r.seq, r.paths) for r in h] == [(3, ["b", "c"]), (2, ["a", "b"]), (1, ["a", "b"])]
    assert "-two" in St.diff(log, "a", 1, 2).first()["diff"] and "+2" in St.diff(log, "a", 1, 2).first()["diff"]
    guard, back = St.revert(log, 2)
    assert {r.path for r in guard.collect()} == {"b"}
    assert {(r.path, r.rev, r.content) for r in back.collect()} == {("a", 3, "one\ntwo"), ("b", 3, "x")}


def test_mirror_and_classify(spark):
    row = lambda rows, schema: spark.createDataFrame(rows, schema)
    local = row([("a", "A", "a1"), ("b", "B!", "b9"), ("d", "D", "d1")], "path string, content string, sha256 string")
    base = row([("a", "a1"), ("b", "b1"), ("d", "d1")], "path string, sha256 string")
    new = row([("a", "A2", "a2", False), ("b", "B2", "b2", False), ("c", "C", "c1", False), ("d", None, None, True)], "path string, content string, sha256 string, deleted boolean")
    files, kept = St.mirror(local, base, new)
    assert {(r.path, r.content) for r in files.collect()} == {("a", "A2"), ("b", "B2"), ("c", "C")}
    assert {(r.path, r.content) for r in kept.collect()} == {("b", "B!")}
    assert {r.path: r.outcome for r in St.put_raw(base, row([("a", "a1"), ("b", "x"), ("z", "z")], "path string, sha256 string")).collect()} == {"a": "unchanged", "b": "conflict", "z": "stored"}
    assert {r.path: r.state for r in St.stale_rows(base, row([("a", "a1"), ("b", "x"), ("z", "z")], "path string, sha256 string"), ["path"], "sha256").collect()} == {"a": "kept", "b": "changed", "d": "new", "z": "stale"}
    s = {r.path: r.status for r in St.diff_snapshots(local, row([("a", "A"), ("b", "B"), ("e", "E")], "path string, content string")).collect()}
    assert s == {"b": "changed", "d": "removed", "e": "added"}


def test_imports_go_on_where_they_stopped(spark):
    row = lambda rows, schema: spark.createDataFrame(rows, schema)
    local = row([("a", "A", "a1"), ("b", "B", "b2"), ("c", "C", "c1"), ("d", "D", "d1")], "path string, content string, sha256 string")
    remote, done = row([("a", "a1"), ("b", "b1")], "path string, sha256 string"), row([("c", "c1"), ("d", "d0")], "path string, sha256 string")
    todo, left = St.import_plan(local, remote, done)
    assert {r.path for r in todo.collect()} == {"d"} and {r.path for r in left.collect()} == {"b"}
    todo, left = St.import_plan(local, remote, done, overwrite=True)
    assert {r.path for r in todo.collect()} == {"b", "d"} and left.count() == 0
    assert {(r.path, r.state) for r in St.verify_import(local, remote).collect()} == {("b", "different"), ("c", "missing"), ("d", "missing")}


def test_experiments(spark):
    runs = spark.createDataFrame([(t, k, v, "validation" if t < 3 else "holdout", v == "candidate" or t == 0, 1.0) for t in range(5) for k in range(2) for v in ("baseline", "candidate")], "task int, repeat int, variant string, split string, passed boolean, cost double")
    assert E.accepted(runs, {"cost": 1.0}).first().accepted and not E.accepted(runs, {"cost": 0.5}).first().accepted
    worse = runs.withColumn("passed", F.when((F.col("task") == 0) & (F.col("variant") == "candidate"), F.lit(False)).otherwise(F.col("passed")))
    assert not E.accepted(worse, {}).first().accepted and E.accepted(worse, {}, critical=spark.createDataFrame([(1,)], "task int")).first().accepted
    assert {(r.task, r.repeat) for r in E.paired_regressions(worse).collect()} == {(0, 0), (0, 1)}
    r = E.paired_report(runs, rounds=300).first()
    assert r.tasks == 5 and r.accuracy_delta == pytest.approx(0.8) and r.low <= 0.8 <= r.high and r.p_value == pytest.approx(4 / 32)
    assert 0 < E.random_flips(spark, [1.0] * 20, 500).first().p_value < 0.05
    flagged = E.flag_untrusted(spark.createDataFrame([(0.9,), (0.2,)], "p double"), F.col("p"))
    assert [(x.probability, x.kind) for x in flagged.collect()] == [(0.9, "untrusted_text")]
    assert [x.fp_rate for x in E.false_positives(spark.createDataFrame([("a", 1), ("c", 9)], "query string, rank int"), spark.createDataFrame([("a",), ("b",), ("c",)], "query string")).collect()] == [pytest.approx(1 / 3)]
    split = {x.k: x.fold for x in E.alternate_split(spark.range(100).select((F.col("id") * 3).alias("k")), "k").collect()}
    assert all(split[3 * i] == ("tune" if i % 2 == 0 else "test") for i in range(100))


def test_intervals_of_many_experiments(spark):
    import hashlib
    import math
    import random

    r = random.Random(3)
    rows = [("few", f"t{i}", d) for i, d in enumerate([1.0, -0.5, 2.0, 0.25, 1.5])] + [(x, f"t{i}", r.gauss(m, 1)) for x, m in (("up", 0.6), ("none", 0.0)) for i in range(40)] + [("one", "t", 1.0)]
    got = {x.x: x for x in E.intervals(spark.createDataFrame(rows, "x string, task string, difference double"), ["x"], 400).collect()}
    for x in ("few", "up", "none", "one"):
        d = {t: v for y, t, v in rows if y == x}
        digest = lambda t, k: hashlib.md5(f"{t}:{k}:0".encode()).hexdigest()
        cdf = [sum(math.exp(-1) / math.factorial(j) for j in range(i)) for i in range(1, 12)]
        means = []
        for k in range(400):
            w = {t: sum(int(digest(t, k)[:8], 16) / 2**32 >= c for c in cdf) for t in d}
            if sum(w.values()):
                means.append(sum(w[t] * v for t, v in d.items()) / sum(w.values()))
        means.sort()
        at = lambda q: means[int(q * (len(means) - 1))] + (q * (len(means) - 1) % 1) * (means[min(len(means) - 1, int(q * (len(means) - 1)) + 1)] - means[int(q * (len(means) - 1))])
        assert (got[x].tasks, got[x].accuracy_delta, got[x].low, got[x].high) == (len(d), pytest.approx(sum(d.values()) / len(d)), pytest.approx(at(0.025)), pytest.approx(at(0.975)))
    assert got["few"].p_value == pytest.approx(E.sign_flip_test(spark, [1.0, -0.5, 2.0, 0.25, 1.5]).first().p_value)
    assert got["up"].positive_evidence and not got["none"].positive_evidence and got["one"].p_value == 1.0
    with pytest.raises(Exception, match="unpaired"):
        E.intervals(spark.createDataFrame([("x", "t", None)], "x string, task string, difference double"), ["x"], 10).collect()


def test_json_contains_and_artifacts(spark):
    import json

    cases = [
        ({"a": 1}, {"a": 1, "b": 2}, True), ({"a": 1}, {"a": 1.0}, False), ({"a": True}, {"a": 1}, False), ([{"a": 1}, {"b": 2}], [{"b": 2, "c": 3}, {"a": 1}], True), ([{"a": 1, "b": 2}], [{"a": 1}, {"b": 2}], False),
        ([[1, 2], [3]], [[3, 2, 1]], True), ([], [1], True), ([], {}, False), ({}, {"a": None}, True), ({"a": None}, {}, False), ({"a": [{"b": [1]}]}, {"a": [{"b": [2]}, {"b": [0, 1]}]}, True), ("x", "x", True), (None, None, True), ([1, 1], [1], True),
    ]
    df = spark.createDataFrame([(json.dumps(e), json.dumps(a)) for e, a, _ in cases], "e string, a string").coalesce(1)
    assert [x.r for x in df.select(E.json_subset("e", "a").alias("r")).collect()] == [w for *_, w in cases] == [E.json_contains(e, a) for e, a, _ in cases]
    files = spark.createDataFrame([("a", "hello 7"), ("j", '{"k": 7, "l": [1]}'), ("l", '{"k": 1}\n\n{"k": 2, "z": 0}\n')], "path string, content string")
    checks = [
        ("a", "text", '"hello 7"', True), ("a", "text", '"hello"', False), ("a", "text", "7", False), ("a", "contains", '["he", "7"]', True), ("a", "contains", '["x"]', False), ("a", "contains", "[7]", False), ("a", "contains", "[]", True),
        ("a", "absent", None, False), ("none", "absent", None, True), ("none", "text", '"x"', False), ("j", "json", '{"l": [1], "k": 7}', True), ("j", "json", '{"k": 7}', False), ("j", "json_subset", '{"k": 7}', True), ("a", "json_subset", "{}", False),
        ("l", "jsonl_subset", '[{"k": 2}]', True), ("l", "jsonl_subset", '[{"k": 3}]', False), ("j", "json", "not json", False), ("a", "odd", '"x"', False), ("a", "text", None, False), ("a", None, None, False),
    ]
    got = E.artifact_checks(spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(checks)], "n int, path string, kind string, equals string"), files).collect()
    assert [x.passed for x in sorted(got, key=lambda x: x.n)] == [c[3] for c in checks]


def test_batches_are_bounded(spark):
    rows = spark.range(1000).select(F.format_string("p%04d", "id").alias("path"), (F.col("id") % 7).alias("size"))
    b = St.batches(rows, "path", "size", most=50, max_bytes=100).groupBy("batch").agg(F.count("*").alias("n"), F.sum("size").alias("s")).collect()
    assert max(r.n for r in b) <= 50 and max(r.s for r in b) <= 100 and sum(r.n for r in b) == 1000


def test_evaluation(spark):
    s = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.2, 0), (0.1, 1)], "score double, label int")
    assert E.auroc(s).first().auroc == pytest.approx((2 + 1.5 + 0) / 6)
    assert E.auroc(s.filter("label = 1")).first().auroc is None
    best = E.best_threshold(s).first()
    assert best.threshold == pytest.approx(0.05) and best.f1 == pytest.approx(0.75)
    lat = E.latencies(spark.createDataFrame([(float(i),) for i in range(1, 11)], "v double"), "v").first()
    assert (lat.p50, lat.p90, lat["mean"]) == (5.5, 9.0, 5.5)
    assert E.sign_flip_test(spark, [1.0, 1.0, 1.0]).first().p_value == pytest.approx(0.25)
    b = E.bootstrap(spark, [1.0, 2.0, 3.0], rounds=500).first()
    assert 1 <= b.low <= 2 <= b.high <= 3
    pool = spark.createDataFrame([(1, 0.9), (2, 0.1), (3, None), (4, 0.7)], "rank int, p double")
    assert [r["rank"] for r in E.gate(pool, F.col("p"), n=2).collect()] == [1, 3]
    ev = spark.createDataFrame([("The  cat\nsat.", "the cat SAT", "q"), ("none", "", "cat sat")], "body string, evidence string, claim string").withColumn("sentences", F.array(F.lit("A cat sat here.")))
    assert [r.supported for r in E.check_evidence(ev, "body", "evidence", "claim").collect()] == [True, True]
    t = spark.createDataFrame([("Yes it IS", ["is"], ["no"], ["a"], ["a", "b"], False, False)], "answer string, answer_all array<string>, answer_none array<string>, citations array<string>, cited array<string>, abstain boolean, abstained boolean")
    assert E.task_checks(t).first().passed


def test_stream_applies_each_batch_once(spark, log, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    log.filter("seq <= 2").write.parquet(src)
    run = lambda: feed.drain(feed.stream(spark, src, log.schema), lambda df, i: feed.apply_changes(out, df, i), str(tmp_path / "cp"))
    run()
    log.filter("seq > 2").write.mode("append").parquet(src)
    run()
    run()
    got = St.latest(spark.read.parquet(out).drop("batch"))
    assert {(r.path, r.seq, r.deleted) for r in got.collect()} == {("a", 2, False), ("b", 3, True), ("c", 5, True)}
