"""Service metrics of running streams as rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

METRICS = "metric string, query string, value double, ts timestamp"


class ProgressMetrics(StreamingQueryListener):
    """Collects a few numbers per micro-batch: rows, duration, rate, and failed queries.

    Register with ``spark.streams.addListener`` and empty it regularly with ``drain``.
    """

    def __init__(self):
        self._rows: list[tuple] = []

    def _add(self, query, at: str, **values: float) -> None:
        when = dt.datetime.fromisoformat(at.replace("Z", "+00:00"))
        self._rows += [(name, str(query), float(v), when) for name, v in values.items() if v == v]

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._add(p.name or p.id, p.timestamp, batch_id=p.batchId, batch_rows=p.numInputRows,
                  batch_seconds=p.durationMs.get("triggerExecution", 0) / 1000, rows_per_second=p.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self._add(event.id, dt.datetime.now(dt.timezone.utc).isoformat(), batch_failed=1.0)

    def drain(self, spark: SparkSession) -> DataFrame:
        """The rows since the last call, ready for a metric table."""
        rows, self._rows = self._rows, []
        return spark.createDataFrame(rows, METRICS)
