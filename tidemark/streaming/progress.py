"""Paced queries, and what became of them: progress, silence and outages as a table.

A listener hears of a query's batches and of triggers that found nothing, so a heartbeat needs no batch.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

SCHEMA = "at double, kind string, query string, run string, batch long, rows long, error string"


class ProgressLog(StreamingQueryListener):
    """Writes a row of SCHEMA for each start, batch with rows (PROGRESS), end, failure (OUTAGE) and, when nothing
    else was written for `heartbeat` seconds, HEARTBEAT, also while the source is idle.

    A row is a JSON file of its own in `path`, on any file system that Spark knows: the log is as long as
    there are batches, and an unfinished write is no row. `names` limits it to queries of these names.
    """

    def __init__(self, spark: SparkSession, path: str, heartbeat: float = 15.0, names: tuple[str, ...] = (), clock: Callable[[], float] = time.time) -> None:
        self.spark, self.path, self.heartbeat, self.names, self.clock = spark, path.rstrip("/"), heartbeat, names, clock
        self.last: dict[str, float] = {}
        self.named: dict[str, str] = {}

    def _write(self, kind: str, run: str, batch: int | None = None, rows: int | None = None, error: str | None = None) -> None:
        now = self.clock()
        self.last[run] = now
        row = {"at": now, "kind": kind, "query": self.named.get(run), "run": run, "batch": batch, "rows": rows, "error": error}
        jvm = self.spark._jvm
        own, to = (jvm.org.apache.hadoop.fs.Path(f"{self.path}/{x}") for x in (f".{uuid.uuid4().hex}", f"{now:020.6f}-{uuid.uuid4().hex}.json"))
        system = own.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = system.create(own)
        out.write(bytearray((json.dumps(row) + "\n").encode()))
        out.close()
        system.rename(own, to)

    def _wanted(self, run: str) -> bool:
        return run in self.named

    def onQueryStarted(self, event) -> None:  # noqa: N802
        if not self.names or event.name in self.names:
            self.named[str(event.runId)] = event.name
            self._write("STARTED", str(event.runId))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if self._wanted(str(p.runId)):
            if p.numInputRows:
                self._write("PROGRESS", str(p.runId), p.batchId, p.numInputRows)
            else:
                self._beat(str(p.runId))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        if self._wanted(str(event.runId)):
            self._beat(str(event.runId))

    def _beat(self, run: str) -> None:
        if self.clock() - self.last.get(run, 0.0) >= self.heartbeat:
            self._write("HEARTBEAT", run)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if self._wanted(str(event.runId)):
            self._write("OUTAGE" if event.exception else "ENDED", str(event.runId), error=(event.exception or "")[:2000] or None)


def paced(stream: DataFrame, path: str, checkpoint: str, every: str = "3 seconds", name: str | None = None) -> StreamingQuery:
    """A running query that looks for new rows every `every` of processing time and appends them to a Parquet table."""
    w = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(processingTime=every).format("parquet")
    return (w.queryName(name) if name else w).start(path)


def log_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def source_status(log: DataFrame, now: float, silent: float = 60.0) -> DataFrame:
    """query, status, last_at, outages: DOWN where the last word is an outage, ENDED, SILENT where nothing was heard for
    `silent` seconds, else UP."""
    last = log.groupBy("query").agg(F.max_by("kind", F.struct("at", "kind")).alias("kind"), F.max("at").alias("last_at"), F.count_if(F.col("kind") == "OUTAGE").alias("outages"))
    status = F.when(F.col("kind") == "OUTAGE", "DOWN").when(F.col("kind") == "ENDED", "ENDED").when(F.lit(now) - F.col("last_at") > silent, "SILENT").otherwise("UP")
    return last.select("query", status.alias("status"), "last_at", "outages")
