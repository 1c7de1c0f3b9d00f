"""Sources and sinks beyond plain tables, and seeded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.functions.expr import hash_unit, seeded_md5
from rillmark.functions.prefix import dense_rank_index

BEHAVIOUR_SCHEMA = "user_id bigint, item_id bigint, category_id bigint, behavior_type string, ts bigint"
EVENT_SCHEMA = "user_id bigint, item_id bigint, event_type string, event_id string, ts string"
#: Up to this many rows a sample is taken by a top-n; beyond, by a threshold and ranks.
TOP_N = 100_000


def scan_project(spark: SparkSession, paths: str | list[str], columns: list[str], limit: int | None = None) -> DataFrame:
    """A Parquet scan that reads the named columns only, over a choice of files."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths)).select(*columns)
    return df if limit is None else df.limit(limit)


def table_inventory(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """Rows, files, bytes and columns of each table, from the scans' metadata."""
    out = None
    for name in names:
        df = spark.read.parquet(f"{folder}/{name}.parquet")
        files = df.select("_metadata.file_path", "_metadata.file_size").groupBy("file_path").agg(F.first("file_size").alias("size"), F.count(F.lit(1)).alias("n"))
        one = files.agg(
            F.lit(name).alias("table"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_files"),
            F.coalesce(F.sum("size"), F.lit(0)).alias("n_bytes"), F.lit(len(df.columns)).alias("n_columns"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def write_zstd(df: DataFrame, path: str, rows_per_file: int = 5_000_000, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """A table stored by buckets of the key: joins of two such tables on it need no exchange."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)


def behaviour_csv(spark: SparkSession, path: str) -> DataFrame:
    """The headerless behaviour log; ``ts`` becomes a timestamp."""
    return spark.read.schema(BEHAVIOUR_SCHEMA).csv(path).withColumn("ts", F.timestamp_seconds("ts"))


def event_source(spark: SparkSession, options: dict[str, str], fmt: str = "kafka") -> DataFrame:
    """A stream of raw events under ``raw``: a topic read from its start, or text files."""
    reader = spark.readStream.format(fmt).options(**({"startingOffsets": "earliest"} if fmt == "kafka" else {}) | options)
    return reader.load().select(F.col("value").cast("binary").alias("raw"))


def keyed_json(events: DataFrame, key: str = "user_id") -> DataFrame:
    """``key, value``: compact JSON keyed by user, so that a partitioned log keeps each user's order."""
    return events.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*events.columns)).alias("value"))


def event_sink(events: DataFrame, options: dict[str, str], fmt: str = "kafka"):
    return keyed_json(events).writeStream.format(fmt).options(**options)


def uniform_sample(df: DataFrame, n: int, *keys: Column, seed: int = 42) -> DataFrame:
    """The same ``n`` rows whatever the partitioning: those with the least hashes of their keys."""
    order = seeded_md5(seed, *keys)
    if n <= TOP_N:
        return df.orderBy(order, *keys).limit(n)
    total = df.count()
    near = df.withColumn("__u", hash_unit(seed, *keys)).where(F.col("__u") < min(1.0, (n + 6 * n**0.5) / max(total, 1)))
    return dense_rank_index(near, "__u", [order, *keys], "__i").where(F.col("__i") < n).drop("__u", "__i")


def fraction_sample(df: DataFrame, fraction: float, *keys: Column, seed: int = 42, n: int | None = None) -> DataFrame:
    """Rows whose hash falls under the fraction: decided row by row, without a shuffle. With ``n``, exactly ``n`` of them, those with the least
    hashes: take the fraction a little above what ``n`` needs."""
    near = df.where(hash_unit(seed, *keys) < fraction)
    return near if n is None else uniform_sample(near, n, *keys, seed=seed)
