"""Following an event log: what is stored is replayed from a cursor, then what is added comes, each event once.

The log is a folder of Parquet files that only grows. Its stream's offset is an event id, so a query that was stopped
goes on after the last id that it had; files that repeat older ids give nothing new. Row groups whose ids lie outside
a batch are never opened: the files' footers tell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from foliant.sources import records
from foliant.streaming.events import EVENTS

ID = "event_id"
#: The event that ends a run.
FINISHED = "run_finished"


@dataclass
class Group(InputPartition):
    path: str
    group: int
    after: int
    upto: int


class LogReader(DataSourceStreamReader):
    def __init__(self, options, schema):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.folder, self.after, self.run = options["path"], int(options.get("after", -1)), options.get("runId")
        self.schema = to_arrow_schema(schema)

    def _groups(self):
        """(file, row group, least id, greatest id), from the footers."""
        for path, _ in records.listed(self.folder):
            fs, base = records.opened(path)
            with fs.open_input_file(base) as stream:
                meta = pq.read_metadata(stream)
            column = next(i for i in range(meta.num_columns) if meta.schema.column(i).path == ID)
            for g in range(meta.num_row_groups):
                if meta.row_group(g).num_rows:
                    stats = meta.row_group(g).column(column).statistics
                    yield (path, g, stats.min, stats.max) if stats is not None and stats.has_min_max else (path, g, *self._ids(path, g))

    @staticmethod
    def _ids(path: str, group: int) -> tuple[int, int]:
        fs, base = records.opened(path)
        with fs.open_input_file(base) as stream:
            ids = pq.ParquetFile(stream).read_row_group(group, [ID]).column(ID)
        return pa.compute.min(ids).as_py(), pa.compute.max(ids).as_py()

    def initialOffset(self) -> dict:
        return {"id": self.after}

    def latestOffset(self) -> dict:
        return {"id": max([self.after, *(high for *_, high in self._groups())])}

    def partitions(self, start: dict, end: dict):
        return [Group(path, g, start["id"], end["id"]) for path, g, low, high in self._groups() if high > start["id"] and low <= end["id"]]

    def read(self, partition: Group):
        fs, base = records.opened(partition.path)
        with fs.open_input_file(base) as stream:
            table = pq.ParquetFile(stream).read_row_group(partition.group)
        fits = (ds.field(ID) > partition.after) & (ds.field(ID) <= partition.upto)
        if self.run is not None:
            fits &= ds.field("run_id") == self.run
        wanted = table.filter(fits).select(self.schema.names)
        yield from pa.Table.from_arrays([wanted.column(f.name).cast(f.type) for f in self.schema], schema=self.schema).to_batches()


class EventLog(DataSource):
    """spark.readStream.format("event_log").option("after", id).option("runId", run).schema(...).load(folder)"""

    @classmethod
    def name(cls):
        return "event_log"

    def schema(self):
        return EVENTS

    def streamReader(self, schema):
        return LogReader(self.options, schema)


def log(spark: SparkSession, folder: str, schema: str = EVENTS, after: int = -1, run_id: str | None = None) -> DataFrame:
    """The log as a stream of events with ids over ``after``, of one run or of all."""
    spark.dataSource.register(EventLog)
    made = spark.readStream.format("event_log").schema(schema).option("after", after)
    return (made if run_id is None else made.option("runId", run_id)).load(folder)


class Follower(StatefulProcessor):
    """Lets a run's events through in the order of their ids, none twice, and none after the run has finished."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "last long, finished boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, finished = self.state.get() if self.state.exists() else (None, False)
        if finished:
            return
        batch = pd.concat(list(rows)).drop_duplicates(ID).sort_values(ID)
        if last is not None:
            batch = batch[batch[ID] > last]
        ends = batch.index[batch["type"] == FINISHED]
        if len(ends):
            batch = batch[batch[ID] <= batch[ID][ends].min()]
        if len(batch):
            self.state.update((int(batch[ID].max()), bool(len(ends))))
            yield batch[self.columns]

    def close(self) -> None:
        pass


def followed(stream: DataFrame) -> DataFrame:
    """stream (run_id, event_id, type and others), each run up to its run_finished. The state is an id for each run."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    numbered = stream.dropna(subset=["run_id", ID])
    return numbered.groupBy("run_id").transformWithStateInPandas(Follower(stream.columns), schema, "Append", "None")
