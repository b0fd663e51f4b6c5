"""The stateful stream of vectors against a plain simulation of clock and timers."""

import random

from pyspark.sql import functions as F

from textloom.operators.vectors import RESEND_AFTER, VERIFY_AGE, backoff
from textloom.streaming import vector_states

SCHEMA = "vector_id string, kind string, at long"


def simulate(batches):
    """Actions by vector from a table of what each event does, and timers that fire once the time of earlier batches has passed them."""
    state, sent, fails, due, out = {}, {}, {}, {}, {}
    order = {k: i for i, k in enumerate(vector_states.KINDS)}
    clock = None

    def act(v, at, action, timer):
        out.setdefault(v, []).append((at, state.get(v, -1), action))
        due[v] = timer

    for events in [*batches, []]:
        for v, kind, at in sorted(events, key=lambda e: (e[2], order[e[1]])):
            now = state.get(v, -1)
            if (now, kind) == (-1, "want"):
                state[v], fails[v] = 0, 0
                act(v, at, "send", None)
            elif kind == "drop" and now >= 0:
                state[v] = -1
                act(v, at, "forget" if now == 0 else "delete", None)
            elif (now, kind) == (0, "sent"):
                state[v], sent[v], fails[v] = 1, at, 0
                act(v, at, "wait", at + VERIFY_AGE)
            elif (now, kind) == (0, "failed"):
                fails[v] += 1
                act(v, at, "retry", at + backoff(fails[v]))
            elif (now, kind) == (1, "found"):
                state[v] = 2
                act(v, at, "confirm", None)
            elif (now, kind) == (1, "missing") and at - sent[v] < RESEND_AFTER:
                act(v, at, "wait", at + VERIFY_AGE)
            elif (now, kind) == (1, "missing"):
                state[v] = 0
                act(v, at, "send", None)
        for v, t in sorted(due.items()):
            if t is not None and clock is not None and t <= clock:
                act(v, t, "look" if state[v] == 1 else "send", None)
        clock = max([at for *_, at in events], default=clock)
    return out, {v: s for v, s in state.items()}


def test_states_equal_a_simulation(spark, tmp_path):
    r = random.Random(1)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    batches, now = [], 1_700_000_000_000
    for _ in range(7):
        own = []
        for _ in range(60):
            now += r.choice([0, 100, 2_000, 9_000])
            own.append((f"v{r.randrange(14)}", r.choice(["want", "want", "sent", "sent", "failed", "missing", "missing", "found", "drop"]), now))
        batches.append(own)
        now += r.choice([0, 40_000, 700_000])
    for i, own in enumerate(batches):
        spark.createDataFrame(own, SCHEMA).withColumn("ts", F.timestamp_millis("at")).coalesce(1).write.parquet(str(tmp_path / "in" / f"b={i}"))
    want, end = simulate(batches)
    source = lambda: spark.readStream.schema(f"{SCHEMA}, ts timestamp").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in" / "b=*"))
    write = lambda df, batch: df.write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={batch}"))
    q = vector_states.actions(source(), event_time=True).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out"))
    acted: dict = {}
    for x in got.orderBy("vector_id", "n").collect():
        acted.setdefault(x.vector_id, []).append((x.at, x.state, x.action))
    assert acted == want
    assert {x.vector_id: x.state for x in vector_states.states(got).collect()} == end
    assert {a for own in want.values() for *_, a in own} == {"send", "wait", "retry", "confirm", "look", "delete", "forget"}
