"""Running sums and row numbers over a whole table without one task that holds it all.

Boundaries of the order column split the rows into buckets by value, so equal values stay together and a retry puts every
row where it was. A small table of bucket totals gives the offsets; windows then run inside buckets.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmark.scratch import materialize

BUCKETS = 256


def _bucketed(df: DataFrame, order: str, buckets: int) -> DataFrame:
    bounds = sorted({b for b in df.approxQuantile(order, [i / buckets for i in range(1, buckets)], 0.5 / buckets) if math.isfinite(b)})
    if not bounds:
        return df.withColumn("__b", F.lit(0))
    # a binary search a row; rows without a value are sorted first, so they go into the first bucket
    cut = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol=order, outputCol="__b", handleInvalid="keep").transform(df)
    return cut.withColumn("__b", F.when(F.col(order).isNull(), 0).otherwise(F.col("__b").cast("int")))


def prefix_sum(df: DataFrame, order: str, values: dict[str, Column], ties: list[Column] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Adds, for each name, the sum of its value over this and all rows before it in ascending ``order`` (a number).

    The rows are written once: three passes read them, and what they come from may be costly."""
    rows = _bucketed(materialize(df.withColumns({f"__v_{n}": v for n, v in values.items()}), "prefix"), order, buckets)
    totals = rows.groupBy("__b").agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in values])
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    offsets = totals.select(F.col("__b"), *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in values])
    inside = Window.partitionBy("__b").orderBy(F.col(order), *(ties or [])).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.join(F.broadcast(offsets), "__b").withColumns({n: F.sum(f"__v_{n}").over(inside) + F.col(f"__o_{n}") for n in values})
    return summed.drop("__b", *[f"__v_{n}" for n in values], *[f"__o_{n}" for n in values])


def dense_rank_index(df: DataFrame, order: str, ties: list[Column], name: str = "idx", start: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """Numbers all rows in ascending ``order`` (a number), ties by ``ties``, from ``start``."""
    numbered = prefix_sum(df, order, {name: F.lit(1).cast("bigint")}, ties, buckets)
    return numbered.withColumn(name, F.col(name) - 1 + start)
