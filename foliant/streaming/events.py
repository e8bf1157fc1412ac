"""The run event log as a stream: replay, dedup, step and run states, and (an extension) event-time windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EVENTS = "event_id long, run_id string, ts timestamp, type string, step string, message string, done long, total long"
#: Which states may follow which.
NEXT = {None: ("queued", "running"), "queued": ("running", "cancelled", "failed"), "running": ("succeeded", "failed", "cancelled")}


def append(events: DataFrame, path: str) -> None:
    """Adds events to the log: they are kept first, streams see them afterwards."""
    events.write.mode("append").parquet(path)


def follow(spark: SparkSession, path: str, schema: str = EVENTS, after: int | None = None) -> DataFrame:
    """The log as a stream, from after an id."""
    stream = spark.readStream.schema(schema).parquet(path)
    return stream if after is None else stream.where(F.col("event_id") > after)


def once(stream: DataFrame, keys: list[str], late: str | None = None, ts: str = "ts") -> DataFrame:
    """Each event once; with ``late``, state is kept for that long only."""
    return stream.dropDuplicates(keys) if late is None else stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def replay(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hands all events that are new since the checkpoint to ``each``, batch by batch, and ends."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()


def step_states(stream: DataFrame) -> DataFrame:
    """State and progress of each run's steps, for update mode: an aggregate that needs no order of arrival."""
    kind = F.when(F.col("type") == "step_started", "running").when(F.col("type") == "step_finished", "done").when(F.col("type") == "error", "failed")
    progress = F.when(F.col("total").isNotNull(), F.struct("done", "total"))
    return stream.groupBy("run_id", "step").agg(F.max_by(kind, F.when(kind.isNotNull(), F.col("event_id"))).alias("state"), F.max_by(progress, F.when(progress.isNotNull(), F.col("event_id"))).alias("progress"))


class RunState(StatefulProcessor):
    """Keeps each run's state and lets only permitted changes through; others are reported as refused."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = self.state.get()[0] if self.state.exists() else None
        out = []
        for r in sorted((r for df in rows for r in df.itertuples()), key=lambda r: r.event_id):
            fine = r.type in NEXT.get(now, ())
            if fine:
                now = r.type
            out.append((key[0], int(r.event_id), r.type, bool(fine), now))
        if now is not None:
            self.state.update((now,))
        yield pd.DataFrame(out, columns=["run_id", "event_id", "wanted", "accepted", "state"])

    def close(self) -> None:
        pass


def run_states(stream: DataFrame) -> DataFrame:
    """(run_id, event_id, wanted, accepted, state) of events whose type is a run state."""
    names = sorted({x for v in NEXT.values() for x in v})
    return stream.where(F.col("type").isin(*names)).select("run_id", "event_id", "type").groupBy("run_id").transformWithStateInPandas(RunState(), "run_id string, event_id long, wanted string, accepted boolean, state string", "Append", "None")


def windowed(stream: DataFrame, length: str, slide: str | None, late: str, by: list[str], ts: str = "ts") -> DataFrame:
    """An extension: counts by event-time window, with a watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, length, slide), *by).agg(F.count(F.lit(1)).alias("n"))


def wait(query: StreamingQuery, seconds: float) -> bool:
    """Whether the query ended in time; it is stopped otherwise."""
    done = query.awaitTermination(seconds)
    if not done:
        query.stop()
    return bool(done)
