"""Many commits at once, against applying them one by one."""

import json
import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import commits, store
from textloom.operators.components import components

REQUESTS = "seq long, ops string, log string, author string, today string"


def some_ops(r, paths):
    p, q = r.choice(paths), r.choice(paths)
    word = r.choice(["one", "two", "three"])
    return r.choice([
        {"op": "create", "path": p, "content": f"{word}\n"}, {"op": "put", "path": p, "content": f"{word} {word}\n", "base_rev": r.randint(1, 4)}, {"op": "upsert", "path": p, "content": word},
        {"op": "edit", "path": p, "edits": [{"old": word, "new": "four", "replace_all": r.random() < 0.5}], "base_rev": r.randint(1, 4)}, {"op": "append", "path": p, "text": word, "create": r.random() < 0.5},
        {"op": "delete", "path": p, "base_rev": r.randint(1, 5)}, {"op": "move", "from": p, "to": q, "base_rev": r.randint(1, 4)}, {"op": "upsert", "path": p, "content": "x", "expected_sha256": None},
    ])


def one_by_one(spark, versions, requests):
    rows, out = list(versions), {}
    for seq, ops, log, author, today in sorted(requests):
        frame = spark.createDataFrame(rows, store.VERSIONS)
        try:
            made = store.commit(spark, frame, json.loads(ops), seq, log=log, author=author, today=today).collect()
            rows += [tuple(x) for x in made]
            out[seq] = ("applied" if made else "unchanged", None, None)
        except store.Conflict as e:
            out[seq] = ("conflict", e.reason, e.details["op_index"])
        except ValueError:
            out[seq] = ("invalid", None, None)
    return rows[len(versions) :], out


def test_equal_to_one_by_one(spark):
    r = random.Random(4)
    groups = [[f"g{k}-{i}" for i in range(4)] for k in range(5)]
    before = [tuple(x) for x in store.commit(spark, spark.createDataFrame([], store.VERSIONS), [{"op": "create", "path": g[0], "content": "one two\n"} for g in groups], 1).collect()]
    requests = [(seq, json.dumps([some_ops(r, r.choice(groups) if r.random() < 0.97 else [p for g in groups for p in g]) for _ in range(r.choice([1, 1, 2]))]), None, None, None) for seq in range(2, 42)]
    requests += [(50, json.dumps([{"op": "create", "path": "z/y", "content": "new"}]), "ingest | z", "me", "2024-01-02"), (51, json.dumps([{"op": "fly", "path": "a"}]), None, None, None), (52, json.dumps([{"op": "append", "path": "z/y", "text": "é"}]), "more", "you", "2024-01-03")]
    want, outcomes = one_by_one(spark, before, requests)
    got = commits.apply_all(spark.createDataFrame(before, store.VERSIONS), spark.createDataFrame(requests, REQUESTS).repartition(3)).collect()
    assert {x.seq: (x.status, x.reason if x.status == "conflict" else None, x.op_index) for x in got} == outcomes
    assert {"applied", "conflict", "invalid"} <= {s for s, _, _ in outcomes.values()} and len({x for _, x, _ in outcomes.values()}) >= 5
    rows = [tuple(v) for v in commits.versions_of(spark.createDataFrame(got, commits.RESULT)).collect()]
    assert sorted(rows, key=str) == sorted(want, key=str) and len(rows) > 20
    stale = [json.loads(x.details) for x in got if x.reason == "stale_base_rev"]
    assert stale and any("diff" in d for d in stale)


def test_odd_requests(spark):
    rows = [(1, None, None, None, None), (2, "no json", None, None, None), (3, "[]", None, None, None), (4, "{}", None, None, None), (5, '[{"op":"create","path":"a","content":"x"}]', None, None, None), (5, '[{"op":"create","path":"a","content":"x"}]', None, None, None), (6, '[{"op":"create","path":5,"content":"x"}]', None, None, None)]
    nothing = spark.createDataFrame([], store.VERSIONS)
    got = sorted((x.seq, x.status) for x in commits.apply_all(nothing, spark.createDataFrame(rows, REQUESTS)).collect())
    assert got == [(1, "invalid"), (2, "invalid"), (3, "invalid"), (4, "invalid"), (5, "applied"), (5, "conflict"), (6, "invalid")]
    assert commits.apply_all(nothing, spark.createDataFrame([], REQUESTS)).count() == 0


def test_too_large_a_component_is_refused(spark):
    rows = [(i, json.dumps([{"op": "append", "path": f"p{i}", "text": "x", "create": True}, {"op": "append", "path": f"p{i + 1}", "text": "x", "create": True}]), None, None, None) for i in range(12)]
    nothing, requests = spark.createDataFrame([], store.VERSIONS), spark.createDataFrame(rows, REQUESTS)
    with pytest.raises(ValueError, match="too many"):
        commits.apply_all(nothing, requests, most=11)
    assert {x.status for x in commits.apply_all(nothing, requests, most=12).collect()} == {"applied"}


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(40)] + [(7, 7), (None, 3), (500, 499)]
    parent = {x: x for e in edges for x in e if x is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a int, b int")).collect()))
    own = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert got == {x: find(x) for x in own}


def test_many_commits_on_one_page(spark):
    n = 20_050
    requests = spark.range(n).select(F.col("id").alias("seq"), F.lit('[{"op":"append","path":"log/a","text":"é","create":true}]').alias("ops"))
    done = commits.apply_all(spark.createDataFrame([], store.VERSIONS), requests).select("seq", "status", F.col("versions")[0]["rev"].alias("rev"), F.octet_length(F.col("versions")[0]["content"]).alias("bytes"))
    got = done.agg(F.count_if((F.col("status") == "applied") & (F.col("rev") == F.col("seq") + 1) & (F.col("bytes") == 3 * F.col("rev"))).alias("right"), F.count("*").alias("n")).first()
    assert (got.right, got.n) == (n, n)


def test_older_versions_are_kept_as_long_as_they_are_asked_for():
    c = commits._Component()
    rows = [{"kind": commits._BASE, "path": "a", "rev": rev, "seq": seq} for rev, seq in ((1, 3), (2, None), (3, 9))]
    rows += [{"kind": commits._REQUEST, "path": None, "rev": None, "seq": i, "ops": json.dumps([{"op": "upsert", "path": "a", "content": f"{i}\n"}]), "message": None, "log": None, "author": None, "today": None} for i in range(1, 11)]
    held = []
    for r in rows:
        c.take(r)
        held.append(sorted(rev for _, rev in c.state.versions))
    assert held[3:] == [[1], [1, 2], [1, 2, 3], [2, 3], [2, 3], [2, 3], [2, 3], [2, 3], [2, 3], [2]]
