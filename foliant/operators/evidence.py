"""Stages that keep evidence: what each made, what it decided and why, in the order in which it happened.

A stage takes a DataFrame and gives one. Its figures are observed while its result is written, so they cost no further
pass and are those of the rows that were kept. The log is a folder of Parquet files that only grows.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LOG = "run_id string, event_id long, ts timestamp, type string, step string, message string, data map<string,string>"


@dataclass
class Decision:
    """A choice that a stage made: about what, which rule led to it, from which figures, and what else was possible."""

    subject: str
    choice: str
    rule_id: str | None = None
    inputs: dict = field(default_factory=dict)
    alternatives: list = field(default_factory=list)
    confidence: float | None = None
    reasoning: str = ""


class Run:
    """A run's stages, one after another; each writes its result and its evidence below ``folder``."""

    def __init__(self, spark: SparkSession, run_id: str, folder: str):
        self.spark, self.run_id, self.folder, self.last = spark, run_id, folder.rstrip("/"), -1
        self.log = f"{self.folder}/log"

    def emit(self, kind: str, step: str | None = None, message: str = "", data: dict | None = None) -> None:
        self.last += 1
        told = {k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in (data or {}).items()}
        row = (self.run_id, self.last, datetime.now(timezone.utc), kind, step, message, told)
        self.spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(self.log)

    def stage(self, step: str, df: DataFrame, work: Callable[[DataFrame], DataFrame], figures: dict[str, Column] | None = None, decide: Callable[[dict], list[Decision]] | None = None) -> DataFrame:
        """work(df), written and read again.

        figures: aggregates of the result beside its ``rows``. decide(figures) gives decisions; what it is given also
        has ``rows_in``, the rows of the stage before. What fails is logged, ends the run, and is raised again.
        """
        self.emit("step_started", step, f"{step} started")
        began, seen = time.monotonic(), Observation(f"{self.run_id}-{step}-{self.last}")
        path = f"{self.folder}/{step}"
        try:
            made = work(df)
            made.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in (figures or {}).items())).write.mode("overwrite").parquet(path)
            told = seen.get
            for d in decide({**told, "rows_in": getattr(self, "rows", None)}) if decide else []:
                self.emit("decision", step, f"{d.subject}: {d.choice}", asdict(d))
        except Exception as error:
            self.emit("error", step, f"{type(error).__name__}: {error}"[:4000])
            self.finish("failed")
            raise
        self.rows = told["rows"]
        self.emit("step_finished", step, f"{step} finished", {**told, "seconds": round(time.monotonic() - began, 2)})
        return self.spark.read.schema(made.schema).parquet(path)

    def finish(self, status: str = "succeeded") -> None:
        self.emit("run_finished", None, status, {"status": status})

    def read(self) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(self.log)


def figures(log: DataFrame) -> DataFrame:
    """(run_id, step, figure, value): what each step that ended has made; of a step that ran twice, the later."""
    done = log.where("type = 'step_finished'").groupBy("run_id", "step").agg(F.max_by("data", "event_id").alias("data"))
    return done.select("run_id", "step", F.explode("data").alias("figure", "value"))


def decisions(log: DataFrame) -> DataFrame:
    """(run_id, event_id, step, subject, choice, rule_id, inputs, alternatives, confidence, reasoning) in order of events."""
    d = F.col("data")
    return log.where("type = 'decision'").select("run_id", "event_id", "step", d["subject"].alias("subject"), d["choice"].alias("choice"), F.nullif(d["rule_id"], F.lit("null")).alias("rule_id"), d["inputs"].alias("inputs"), F.from_json(d["alternatives"], "array<string>").alias("alternatives"), d["confidence"].try_cast("double").alias("confidence"), d["reasoning"].alias("reasoning"))


def call_stats(calls: DataFrame, by: list[str]) -> DataFrame:
    """Calls (by, ok, truncated, retried, seconds, bytes) counted; the average time is that of the calls that went well."""
    well = F.count_if("ok")
    return calls.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("errors"), F.count_if("truncated").alias("truncated"), F.count_if("retried").alias("retried"),
        F.round(F.try_divide(F.sum(F.when(F.col("ok"), F.col("seconds"))), well), 2).alias("avg_seconds"), F.round(F.sum("bytes") / (1 << 20), 1).alias("mb"),
    )
