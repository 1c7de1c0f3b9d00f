"""Written tables that cut lineage, in the folder all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_ROOT = "/tmp/checkpoints"
#: Everything that this process writes lies in a folder of its own.
RUN = uuid.uuid4().hex


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a local one only for a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return LOCAL_ROOT


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/rillmark/{RUN}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Deletes all that this process has written, once its results have been read: lazy frames over written tables can't be read afterwards."""
    _delete(spark, f"{scratch_root(spark)}/rillmark/{RUN}")


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: later steps neither recompute it nor depend on lost executors."""
    return _write(df, new_folder(df.sparkSession, name))


class Scratch:
    """Tables of one computation, deleted at its end: ``with Scratch(spark, name) as s: a = s.keep(df, "a")``. What is to
    outlive the block is written with ``materialize`` inside it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.paths = spark, new_folder(spark, name), {}

    def __enter__(self) -> Scratch:
        return self

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{len(self.paths)}-{name}"
        kept = _write(df, path)
        self.paths[id(kept)] = (kept, path)
        return kept

    def drop(self, df: DataFrame) -> None:
        """Deletes a kept table before the end of the block; nothing may read it afterwards."""
        _delete(self.spark, self.paths[id(df)][1])

    def __exit__(self, *_) -> None:
        _delete(self.spark, self.folder)
