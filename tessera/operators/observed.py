"""What stages report while they run: counts that ride on a stage's own job, and a stream's progress, as rows.

An observer is a callable that takes a dict; without one the reports are collected and can be had as a
frame.  Nothing is counted twice: metrics are those of the action that the caller runs anyway.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

REPORT = "stage string, metric string, value double"


class Observer:
    def __init__(self, on_event: Callable[[dict], None] | None = None):
        self.on_event, self.watched, self.told = on_event, [], []

    def watch(self, rows: DataFrame, stage: str, **metrics: Column) -> DataFrame:
        """``rows``, counted (n_rows and ``metrics``) when they pass."""
        observation = Observation(f"{stage}-{len(self.watched)}")
        self.watched.append((stage, observation))
        return rows.observe(observation, F.count(F.lit(1)).alias("n_rows"), *[m.alias(n) for n, m in metrics.items()])

    def collect(self) -> list[dict]:
        """Reports of the stages whose action is done; call it after the action."""
        for stage, observation in self.watched[len(self.told) :]:
            event = {"stage": stage, **observation.get}
            self.told.append(event)
            if self.on_event:
                self.on_event(event)
        return self.told

    def frame(self, spark: SparkSession) -> DataFrame:
        """(stage, metric, value), a row a metric."""
        rows = [(e["stage"], k, float(v)) for e in self.collect() for k, v in e.items() if k != "stage" and v is not None]
        return spark.createDataFrame(rows, REPORT)


class Progress(StreamingQueryListener):
    """Reports a stream's batches: rows in, rows in state.  Add it to ``spark.streams`` while the query runs."""

    def __init__(self, on_event: Callable[[dict], None]):
        self.on_event = on_event

    def onQueryStarted(self, event):
        self.on_event({"stage": "started", "query": str(event.id)})

    def onQueryProgress(self, event):
        p = event.progress
        self.on_event({"stage": "batch", "query": str(p.id), "batch": p.batchId, "n_rows": p.numInputRows, "n_state": sum(s.numRowsTotal for s in p.stateOperators)})

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.on_event({"stage": "failed" if event.exception else "done", "query": str(event.id)})
