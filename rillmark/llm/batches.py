"""How many rows a Python worker holds at once."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """What is computed inside hands Python at most ``rows`` rows at a time: rows that carry a text and the set of its shingles have
    some 20 kB each in a worker."""
    before = spark.conf.get(_SETTING)
    spark.conf.set(_SETTING, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_SETTING, before)
