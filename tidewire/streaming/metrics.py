"""Progress of streams as a table, for running and for ended queries."""

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidewire.sources.files import Files

PROGRESS = ("query_id string, run_id string, name string, batch_id bigint, timestamp string, rows bigint, late_rows bigint, watermark string, "
            "duration_ms bigint, observed map<string, map<string, double>>, error string")


class ProgressTable(StreamingQueryListener):
    """Writes the progress of every query: input rows, rows behind the watermark, and all observed metrics.

    A batch has one file per run, named by it, so telling it again changes nothing. Written by the driver without a
    Spark job, as listeners have to return soon.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        super().__init__()
        self.files, self.ended = Files(spark, root), {}
        self.lock = threading.Lock()

    def _end(self, run_id: str) -> threading.Event:
        with self.lock:
            return self.ended.setdefault(run_id, threading.Event())

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        observed = {name: {k: float(v) for k, v in row.asDict().items() if v is not None and not isinstance(v, str)}
                    for name, row in p.observedMetrics.items()}
        late = sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
        self.files.write_json(f"{p.runId}/{p.batchId}.json", {
            "query_id": str(p.id), "run_id": str(p.runId), "name": p.name, "batch_id": p.batchId, "timestamp": p.timestamp,
            "rows": max(0, p.numInputRows), "late_rows": late, "watermark": p.eventTime.get("watermark"),
            "duration_ms": p.batchDuration, "observed": observed})

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.files.write_json(f"{event.runId}/end.json", {"query_id": str(event.id), "run_id": str(event.runId), "error": event.exception})
        self._end(str(event.runId)).set()

    def wait(self, query: StreamingQuery, timeout: float = 60) -> bool:
        """Whether all of an ended query has been written; listeners are told a little later than callers."""
        return self._end(str(query.runId)).wait(timeout)


def read_progress(spark: SparkSession, root: str) -> DataFrame:
    """One row for each batch: the last telling, where a batch was run again after a restart."""
    rows = spark.read.schema(PROGRESS).option("recursiveFileLookup", True).json(root).filter("batch_id is not null")
    newest = F.max_by(F.struct(*[F.col(c) for c in rows.columns]), "timestamp").alias("row")
    return rows.groupBy("query_id", "batch_id").agg(newest).select("row.*")


def read_ends(spark: SparkSession, root: str) -> DataFrame:
    """Ended runs, with the error of those that failed."""
    rows = spark.read.schema(PROGRESS).option("recursiveFileLookup", True).json(root)
    return rows.filter("batch_id is null").select("query_id", "run_id", "error")
