"""Streams that can be stopped at any point: each batch is committed once, and a table says how the run stands."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

STATE = "run string, query string, batch long, status string, rows long, message string, at string"


class RunState(StreamingQueryListener):
    """Appends a row to a state table at each event of a run's query: RUNNING when it starts and after each batch, COMPLETE or FAILED when it ends."""

    def __init__(self, spark: SparkSession, run: str, path: str):
        self.spark, self.run, self.path = spark, run, path

    def _put(self, query: object, batch: int | None, status: str, rows: int | None, message: str | None = None) -> None:
        row = (self.run, str(query), batch, status, rows, message, datetime.datetime.now(datetime.UTC).isoformat())
        self.spark.createDataFrame([row], STATE).coalesce(1).write.mode("append").parquet(self.path)

    def _mine(self, name: str | None) -> bool:
        return name == self.run

    def onQueryStarted(self, event) -> None:
        if self._mine(event.name):
            self.query = event.id
            self._put(event.id, None, "RUNNING", 0)

    def onQueryProgress(self, event) -> None:
        if self._mine(event.progress.name):
            self._put(event.progress.id, event.progress.batchId, "RUNNING", event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if getattr(self, "query", None) == event.id:
            self._put(event.id, None, "FAILED" if event.exception else "COMPLETE", None, event.exception)


def committed_once(sink: str, work: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a batch's rows go to a folder of its number, in place of what is there. A batch that is run again after a crash, which has the same rows, takes its own place."""

    def commit(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return commit


def run_stream(spark: SparkSession, schema: StructType | str, source: str, sink: str, checkpoint: str, state: str, run: str, work: Callable[[DataFrame], DataFrame] = lambda df: df, files_at_once: int = 250, source_format: str = "parquet", commit: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Works off the files that are new since the last run, in batches, then ends; each file once, wherever an earlier run was stopped. The run's state goes to a table.

    Read the sink with spark.read.parquet(sink); its column batch says which batch a row came with.
    """
    listener = RunState(spark, run, state)
    spark.streams.addListener(listener)
    stream = spark.readStream.schema(schema).format(source_format).option("maxFilesPerTrigger", files_at_once).load(source)
    query = stream.writeStream.queryName(run).foreachBatch(commit or committed_once(sink, work)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.vetra_listener = listener
    return query


def ended(query: StreamingQuery) -> None:
    """Waits for the query to end, and for its listener to have written that; then takes the listener off. Fails as the query does."""
    spark = query.vetra_listener.spark
    try:
        query.awaitTermination()
    finally:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        spark.streams.removeListener(query.vetra_listener)


def run_status(states: DataFrame) -> DataFrame:
    """Of each run: its last status and message, batches, rows and starts."""
    return states.groupBy("run").agg(
        F.max_by("status", F.struct("at", F.col("status") != "RUNNING")).alias("status"), F.max_by("message", F.struct("at", F.col("status") != "RUNNING")).alias("message"),
        F.count_distinct("batch").alias("batches"), F.coalesce(F.sum(F.when(F.col("batch").isNotNull(), F.col("rows"))), F.lit(0)).alias("rows"), F.count_if(F.col("batch").isNull() & (F.col("status") == "RUNNING")).alias("starts"),
    )
