"""Tables and the interaction frames that the operators work on."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.scratch import materialize

#: Interactions before this date are for training, later ones for testing.
SPLIT_DATE = "2000-07-01"


#: Frames written by ``written_once``, while it lasts.
_shared: dict[tuple[str, str], DataFrame] | None = None


@contextmanager
def written_once() -> Iterator[None]:
    """Frames of ``shareable`` functions that are asked for inside are written at first and read by all who ask again."""
    global _shared
    before, _shared = _shared, {}
    try:
        yield
    finally:
        _shared = before


def shareable(make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(make)
    def get(spark: SparkSession, folder: str) -> DataFrame:
        if _shared is None:
            return make(spark, folder)
        key = (make.__name__, folder)
        if key not in _shared:
            _shared[key] = materialize(make(spark, folder), make.__name__)
        return _shared[key]

    return get


def load(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A Parquet table with its columns pruned; timestamps without a zone are read in the session's (UTC)."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    df = df.select(*columns) if columns else df
    naive = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


@shareable
def interactions(spark: SparkSession, folder: str) -> DataFrame:
    """``user_id, item_id, label, last_ts, split``: one row a customer and part."""
    lines = load(spark, folder, "lineitem", "l_orderkey", "l_partkey", "l_returnflag")
    orders = load(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    last = F.max("o_orderdate")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"))
        .agg(
            F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("label"),
            last.alias("last_ts"),
            F.when(last < F.lit(SPLIT_DATE).cast("timestamp"), "train").otherwise("test").alias("split"),
        )
    )


def purchases(spark: SparkSession, folder: str) -> DataFrame:
    """``user_id, item_id, ts, order_id, line``: every purchase, before they are joined to interactions."""
    lines = load(spark, folder, "lineitem", "l_orderkey", "l_partkey", "l_linenumber")
    orders = load(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), F.col("o_orderdate").alias("ts"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line")
    )


def item_features(spark: SparkSession, folder: str) -> DataFrame:
    """``item_id, category, city, province``."""
    return load(spark, folder, "part", "p_partkey", "p_brand", "p_type", "p_size").select(
        F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("category"), F.col("p_type").alias("city"), F.col("p_size").alias("province")
    )


def item_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """``item_id, vec`` as doubles."""
    return load(spark, folder, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("vec"))


def demographics(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "customer", "c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal").select(
        F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.signum("c_acctbal").cast("int").alias("balance")
    )


@shareable
def clicks(spark: SparkSession, folder: str) -> DataFrame:
    """``event_id, ts, user_id, event_type, value, item_id`` of the event log."""
    return load(spark, folder, "events").select(
        "event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("item_id")
    )
