"""The life of vectors in a service that applies writes later, as a stream with state and timers.

Events (vector_id, kind, at in milliseconds) come from the store and from the service; what is to be done goes out as actions:

* want: a section has this vector now. Unless it was sent, it is to be sent.
* drop: no section has it any more. If it was sent, it is to be deleted.
* sent, failed: what became of a send. A sent one is looked for after VERIFY_AGE; after a failure the next try waits for
  vectors.backoff(failures in a row).
* found, missing: what became of a look. Found vectors are confirmed. A missing one is sent again RESEND_AFTER its last send; until then it is
  looked for every VERIFY_AGE.

Each vector has one state and at most one timer. By default timers follow the clock; with event_time they follow the events' own
(ts, of which the watermark is taken), so that a replay makes the same decisions. States last in the state store of the
checkpoint, so a query that starts again goes on where it ended.

Defined results: events of one vector in a batch are taken in order of at, and of equal ones in order of KINDS. Events that don't fit the
state (a late answer for what isn't waited for) change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from textloom.operators.vectors import CONFIRMED, PENDING, RESEND_AFTER, SENT, VERIFY_AGE, backoff

KINDS = ("want", "sent", "failed", "found", "missing", "drop")
ACTIONS = "vector_id string, n long, at long, state int, action string"
#: The state of a vector that nobody wants and the service doesn't have.
GONE = -1


class VectorStates(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.vector = handle.getValueState("vector", "state int, sent_at long, failures int, n long, due long")

    def _row(self) -> list:
        return list(self.vector.get()) if self.vector.exists() else [GONE, 0, 0, 0, 0]

    def _keep(self, row: list, due: int) -> None:
        """Keeps a state, with its one timer moved to due (0: none)."""
        if row[4] and row[4] != due:
            self.handle.deleteTimer(row[4])
        if due and row[4] != due:
            self.handle.registerTimer(due)
        row[4] = due
        self.vector.update(tuple(row))

    @staticmethod
    def _step(row: list, kind: str, at: int) -> tuple[str, int] | None:
        """Moves a state by one event: (action, when its timer is due); None if the event doesn't fit."""
        state, sent_at, failures = row[:3]
        if kind == "want" and state == GONE:
            row[0], row[2] = PENDING, 0
            return "send", 0
        if kind == "drop" and state != GONE:
            row[0], row[2] = GONE, 0
            return ("delete" if state != PENDING else "forget"), 0
        if kind == "sent" and state == PENDING:
            row[:3] = [SENT, at, 0]
            return "wait", at + VERIFY_AGE
        if kind == "failed" and state == PENDING:
            row[2] = failures + 1
            return "retry", at + backoff(failures + 1)
        if kind == "found" and state == SENT:
            row[0] = CONFIRMED
            return "confirm", 0
        if kind == "missing" and state == SENT:
            if at - sent_at >= RESEND_AFTER:
                row[0] = PENDING
                return "send", 0
            return "wait", at + VERIFY_AGE
        return None

    def _out(self, key, made: list[tuple]) -> Iterator[pd.DataFrame]:
        if made:
            yield pd.DataFrame([(key[0], *m) for m in made], columns=["vector_id", "n", "at", "state", "action"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows))
        row, made = self._row(), []
        due = row[4]
        for at, _, kind in sorted((int(a), KINDS.index(k), k) for a, k in zip(events["at"], events["kind"], strict=True) if k in KINDS):
            if step := self._step(row, kind, at):
                row[3] += 1
                made.append((row[3], at, row[0], step[0]))
                due = step[1]
        self._keep(row, due)
        yield from self._out(key, made)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        row, at = self._row(), expiredTimerInfo.getExpiryTimeInMs()
        if row[4] != at:
            return
        row[3] += 1
        row[4] = 0
        self.vector.update(tuple(row))
        yield from self._out(key, [(row[3], at, row[0], "look" if row[0] == SENT else "send")])

    def close(self) -> None:
        pass


def actions(events: DataFrame, event_time: bool = False, late: str = "0 seconds") -> DataFrame:
    """The actions of a stream of events (vector_id, kind, at, and ts, a timestamp, with event_time). Output mode: update or append."""
    e = events.select(F.col("vector_id").cast("string").alias("vector_id"), "kind", F.col("at").cast("long").alias("at"), *(["ts"] if event_time else []))
    e = e.withWatermark("ts", late) if event_time else e
    return e.groupBy("vector_id").transformWithStateInPandas(VectorStates(), ACTIONS, "Update", "EventTime" if event_time else "ProcessingTime")


def states(acted: DataFrame) -> DataFrame:
    """vector_id, state, at of every vector after the actions."""
    return acted.groupBy("vector_id").agg(F.max_by(F.struct("state", "at"), "n").alias("v")).select("vector_id", "v.*")
