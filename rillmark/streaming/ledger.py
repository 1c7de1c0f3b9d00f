"""What a stream has done, kept as tables: counts of every batch, batches written once, and state read back."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

PROGRESS = "query string, run string, batch bigint, metric string, name string, value bigint"


class ProgressTable(StreamingQueryListener):
    """Writes each batch's observed metrics as rows ``query, run, batch, metric, name, value``. The file's name is made of query and
    batch, so a batch that is repeated after a restart replaces its rows instead of adding to them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        rows = [(str(p.id), str(p.runId), p.batchId, metric, name, int(value)) for metric, row in p.observedMetrics.items() for name, value in row.asDict().items() if value is not None]
        if rows:
            self.spark.createDataFrame(rows, PROGRESS).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{p.id}-{p.batchId}")

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def progress(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(PROGRESS).option("recursiveFileLookup", "true").parquet(folder)


def progress_totals(rows: DataFrame) -> DataFrame:
    """``metric, name, n`` over all batches."""
    return rows.groupBy("metric", "name").agg(F.sum("value").alias("n"))


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_once(folder: str, done: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: a batch's rows go to a folder of its number, in place of what a broken attempt left there, and
    then its number into the ledger. A batch that the ledger has isn't written again. ``done`` is called between the two."""
    folder = folder.rstrip("/")

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fs, entry = _path(spark, f"{folder}/ledger/{batch_id}")
        if fs.exists(entry):
            return
        batch.write.mode("overwrite").parquet(f"{folder}/data/batch={batch_id}")
        if done:
            done(batch_id)
        out = fs.create(entry, True)  # one small file, there whole or not at all
        out.write(json.dumps({"batch": batch_id}).encode())
        out.close()

    return each


def written(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the batches in the ledger, with ``batch``: a batch without its entry was broken off and doesn't count."""
    folder = folder.rstrip("/")
    ledger = spark.read.schema("batch int").json(f"{folder}/ledger")
    return spark.read.parquet(f"{folder}/data").join(F.broadcast(ledger), "batch", "left_semi")  # a number a batch


def stored_sessions(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """``user_id, session``: the sessions that a stream holds at its last committed batch, read from its checkpoint. ``operator`` is the place
    of the session state among the query's states: 0 in ``session_stream`` and in ``first_sessions``, where it comes last and counts first."""
    state = spark.read.format("statestore").option("operatorId", operator).option("stateVarName", "session").load(checkpoint)
    return state.select(F.col("key.user_id").alias("user_id"), F.col("value.items").alias("session"))
