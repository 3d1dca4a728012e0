"""How far streams lag behind, as a table."""

from __future__ import annotations

import json
import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from ..shared import create_text

LAG = "name string, batch long, rows long, rows_per_s double, duration_ms long, state_rows long, started string, age_ms long"


class LagListener(StreamingQueryListener):
    """Writes a JSON file for each micro-batch of every stream of the application, below a folder.

    age_ms is the time from the batch's trigger to when its progress is told: how old what it has read is at least.
    Register with spark.streams.addListener(); lag() reads the table.  A file is never written twice.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.lock, self.told = spark, folder.rstrip("/"), threading.Lock(), 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        began = time.mktime(time.strptime(p.timestamp[:19], "%Y-%m-%dT%H:%M:%S")) - time.timezone
        row = {"name": p.name or str(p.id), "batch": p.batchId, "rows": p.numInputRows, "rows_per_s": p.processedRowsPerSecond, "duration_ms": p.batchDuration, "state_rows": sum(s.numRowsTotal for s in p.stateOperators), "started": p.timestamp, "age_ms": int((time.time() - began) * 1000)}
        with self.lock:
            self.told += 1
            create_text(self.spark, f"{self.folder}/{p.runId}-{p.batchId}-{self.told}.json", json.dumps(row))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def lag(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(LAG).json(folder)
