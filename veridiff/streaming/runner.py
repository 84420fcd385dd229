"""Periodic runs of a stream, and a table of their progress.

Micro-batches of one query never overlap: a batch that takes longer than the interval delays the next one, which then starts at once.
"""

from __future__ import annotations

import threading
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

PROGRESS = "run_id string, name string, batch long, started_at timestamp, ended_at timestamp, n_rows long, error string"


class ProgressLog(StreamingQueryListener):
    """Keeps a row of PROGRESS for each batch of the queries named, and for each failure, and appends them to a table; at most ``hold`` rows stay with the driver."""

    def __init__(self, spark: SparkSession, path: str, names: set[str] | None = None, hold: int = 100) -> None:
        self.spark, self.path, self.names, self.hold = spark, path, names, hold
        self._rows: list[tuple] = []
        self._of: dict[str, str] = {}
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self._of[str(event.runId)] = event.name

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self.names is not None and p.name not in self.names:
            return
        start = datetime.fromisoformat(p.timestamp.replace("Z", "+00:00"))
        took = timedelta(milliseconds=p.durationMs.get("triggerExecution", 0))
        if "addBatch" in p.durationMs:  # a look without new rows is no batch
            self._add((str(p.runId), p.name, p.batchId, start, start + took, p.numInputRows, None))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        name = self._of.pop(str(event.runId), None)
        if event.exception and (self.names is None or name in self.names):
            now = datetime.now(timezone.utc)
            self._add((str(event.runId), name, None, now, now, 0, event.exception[:4000]))
        self.flush()

    def _add(self, row: tuple) -> None:
        with self._lock:
            self._rows.append(row)
            full = len(self._rows) >= self.hold
        if full:
            self.flush()

    def flush(self) -> None:
        with self._lock:
            rows, self._rows = self._rows, []
        if rows:
            self.spark.createDataFrame(rows, PROGRESS).coalesce(1).write.mode("append").parquet(self.path)

    def table(self) -> DataFrame:
        self.flush()
        return self.spark.read.schema(PROGRESS).parquet(self.path)


def every(stream: DataFrame, step, seconds: float, checkpoint: str, name: str) -> StreamingQuery:
    """Run ``step(batch, number)`` on what has come in, every ``seconds``."""
    return stream.writeStream.queryName(name).foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=f"{int(seconds * 1000)} milliseconds").start()
