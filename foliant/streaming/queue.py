"""Runs that wait for each other: each queue runs one at a time, in the order they were submitted.

Messages say that a run was submitted, cancelled, or how it ended; a tick only tells the time. A run that doesn't end
within a limit fails when its time is over, at once or with the next message, whichever is seen first; both give the
same. State is the running one and the list of those that wait, in one value: each access is a call to the JVM.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

CHANGES = "queue string, n long, run_id string, state string, at long, reason string"
#: How messages end a run.
ENDS = {"succeed": "succeeded", "fail": "failed", "cancel": "cancelled"}


class Fifo(StatefulProcessor):
    def __init__(self, limit_ms: int, timers: bool = True):
        self.limit, self.timers = limit_ms, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "json string")

    def _turn(self, queue: str, messages: list[tuple[str, str, int]], now: int | None) -> Iterator[pd.DataFrame]:
        """Handles messages (type, run, time) in their order, then the time ``now``, and keeps what is left."""
        kept = self.kept.get()
        running, waiting, n = json.loads(kept[0]) if kept else (None, [], 0)
        out: list[tuple] = []

        def say(run: str, state: str, at: int, reason: str = "") -> None:
            out.append((queue, n + len(out), run, state, at, reason))

        def next_one(at: int) -> None:
            nonlocal running
            running = (waiting.pop(0), at) if waiting else None
            if running:
                say(running[0], "running", at)

        def advance(to: int) -> None:
            while running and running[1] + self.limit <= to:
                over = running[1] + self.limit
                say(running[0], "failed", over, "stale")
                next_one(over)

        for kind, run, at in messages:
            advance(at)
            if kind == "submit":
                say(run, "queued", at)
                waiting.append(run)
                if running is None:
                    next_one(at)
            elif kind in ENDS and running and running[0] == run:
                say(run, ENDS[kind], at, "by user" if kind == "cancel" else "")
                next_one(at)
            elif kind == "cancel" and run in waiting:
                waiting.remove(run)
                say(run, "cancelled", at, "while queued")
        if now is not None:
            advance(now)
        if self.timers:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if running:
                self.handle.registerTimer(running[1] + self.limit)
        self.kept.update((json.dumps([running, waiting, n + len(out)]),))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("event_id")
        yield from self._turn(key[0], list(zip(batch["type"], batch["run_id"], batch["at"].astype(int))), None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._turn(key[0], [], int(expiredTimerInfo.getExpiryTimeInMs()))

    def close(self) -> None:
        pass


def run_queue(messages: DataFrame, limit_ms: int, late: str | None = "0 seconds") -> DataFrame:
    """CHANGES of messages (queue, event_id, ts, type, run_id): each run's states, numbered in each queue.

    Messages of a queue come in ascending event_id and time. Unknown runs and messages are ignored. Messages later than
    the others by over ``late`` are dropped; where it is None none are, and only a queue's own messages tell it the time.
    """
    known = messages.selectExpr("queue", "event_id", "ts", "type", "run_id", "unix_millis(ts) as at")
    if late is None:
        return known.groupBy("queue").transformWithStateInPandas(Fifo(limit_ms, timers=False), CHANGES, "Append", "None")
    return known.withWatermark("ts", late).groupBy("queue").transformWithStateInPandas(Fifo(limit_ms), CHANGES, "Append", "EventTime")
