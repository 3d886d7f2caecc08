"""What a stream did, batch by batch: counts observed inside the job, kept by a listener as a table."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

SCHEMA = "query string, name string, batch long, input_rows long, metrics string"


class ProgressLog(StreamingQueryListener):
    """Appends one row per micro-batch to ``path`` when a query ends: input rows, and the observed metrics as JSON."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.rows: dict[str, list[tuple]] = {}
        self.ended: dict[str, threading.Event] = {}

    def onQueryStarted(self, event) -> None:
        self.ended.setdefault(str(event.id), threading.Event())

    def onQueryProgress(self, event) -> None:
        p = event.progress
        metrics = {name: row.asDict() for name, row in p.observedMetrics.items()}
        self.rows.setdefault(str(p.id), []).append((str(p.id), p.name, p.batchId, p.numInputRows, json.dumps(metrics, default=str)))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        rows = self.rows.pop(str(event.id), [])
        if rows:
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        self.ended.setdefault(str(event.id), threading.Event()).set()

    def wait(self, seconds: float = 60.0) -> None:
        """Until the rows of all queries seen so far are written; listeners hear of things a little later."""
        for event in list(self.ended.values()):
            event.wait(seconds)


def observed(stream: DataFrame, name: str, **metrics: Column) -> DataFrame:
    """The stream with named metrics of each batch, gathered while it runs."""
    return stream.observe(name, *[c.alias(n) for n, c in metrics.items()])


def logged(spark: SparkSession, path: str, run: Callable[[], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """What ``run`` returns, and the progress table of the queries that it drained."""
    log = ProgressLog(spark, path)
    spark.streams.addListener(log)
    try:
        out = run()
        log.wait()
    finally:
        spark.streams.removeListener(log)
    return out, spark.read.schema(SCHEMA).parquet(path)
