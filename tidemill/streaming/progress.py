"""What a stream has done, batch by batch, as rows."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

PROGRESS = "run_id string, batch_id long, input_rows long, output_rows long, milliseconds long"
#: Seconds to wait for the events of a query that has ended.
PATIENCE = 60


class ProgressRows(StreamingQueryListener):
    """Keeps a row for each micro-batch of the queries that run while it listens."""

    def __init__(self):
        self.rows: list[tuple[str, int, int, int, int]] = []
        self._ended: dict[str, threading.Event] = {}
        self._lock = threading.Lock()

    def _end_of(self, run_id: str) -> threading.Event:
        with self._lock:
            return self._ended.setdefault(run_id, threading.Event())

    def onQueryStarted(self, event) -> None:
        self._end_of(str(event.runId))

    def onQueryProgress(self, event) -> None:
        done = event.progress
        self.rows.append(
            (str(done.runId), done.batchId, done.numInputRows, done.sink.numOutputRows, done.batchDuration)
        )

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end_of(str(event.runId)).set()

    def of(self, spark: SparkSession, query: StreamingQuery) -> DataFrame:
        """The batches of a query that has ended; its events come in order, the end last."""
        run_id = str(query.runId)
        if not self._end_of(run_id).wait(PATIENCE):
            raise TimeoutError(f"no end of the stream {run_id} within {PATIENCE} seconds")
        return spark.createDataFrame([row for row in self.rows if row[0] == run_id], PROGRESS)


@contextmanager
def listening(spark: SparkSession) -> Iterator[ProgressRows]:
    listener = ProgressRows()
    spark.streams.addListener(listener)
    try:
        yield listener
    finally:
        spark.streams.removeListener(listener)
