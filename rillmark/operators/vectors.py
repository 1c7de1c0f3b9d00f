"""Embedding tables: norms, ranges, look-ups and the cost of their encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.functions.expr import dequantise, l2_normalise, norm, quantise_int8

#: Bytes an element of each encoding.
ENCODINGS = {"int8": 1, "float16": 2, "bfloat16": 2, "float32": 4, "float64": 8}


def norm_stats(vectors: DataFrame) -> DataFrame:
    """Norms of the raw rows and of the rows quantised and back: mean, deviation, least, greatest."""
    long = vectors.select(F.explode(F.array(
        F.struct(F.lit("raw").alias("space"), norm(F.col("vec")).alias("n")),
        F.struct(F.lit("dequantised").alias("space"), norm(dequantise(quantise_int8(F.col("vec")))).alias("n")),
    )).alias("x"))
    return long.groupBy("x.space").agg(F.avg("x.n").alias("mean"), F.stddev_pop("x.n").alias("std"), F.min("x.n").alias("min"), F.max("x.n").alias("max"))


def norm_verdict(stats: DataFrame) -> DataFrame:
    """Whether all rows have nearly one length, and that length nearly 1."""
    return stats.select("space", (((F.col("max") - F.col("min")) / F.col("mean") < 0.05) & (F.abs(F.col("mean") - 1) < 0.05)).alias("unit_norm"))


def dim_means(vectors: DataFrame) -> DataFrame:
    """Mean of each dimension."""
    return vectors.select(F.posexplode("vec").alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("mean"))


def value_range(vectors: DataFrame) -> DataFrame:
    return vectors.agg(F.min(F.array_min("vec")).alias("least"), F.max(F.array_max("vec")).alias("greatest"), F.count(F.lit(1)).alias("n_rows"), F.max(F.size("vec")).alias("dim"))


def lookup_masked(ids: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """``ids`` with ``vec`` and ``known``; ids without a vector get zeros."""
    v = vectors.select(F.col("item_id").alias("__v"), "vec")
    zero = F.array_repeat(F.lit(0.0), dim)
    return ids.join(v, ids["item_id"] == F.col("__v"), "left").select(*[ids[c] for c in ids.columns], F.coalesce("vec", zero).alias("vec"), F.col("__v").isNotNull().alias("known"))


def dedupe_keys(vectors: DataFrame, key: str, order: str) -> DataFrame:
    """One vector a key: the first in order."""
    rest = [c for c in vectors.columns if c not in (key,)]
    return vectors.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("__r")).select(key, "__r.*")


def subset_vectors(vectors: DataFrame, keep: DataFrame, dim: int, pad_id: int = -1) -> DataFrame:
    """The vectors of the kept ids and one row of zeros for padding."""
    pad = vectors.sparkSession.range(1).select(F.lit(pad_id).cast("bigint").alias("item_id"), F.array_repeat(F.lit(0.0), dim).alias("vec"))
    return vectors.join(keep.select("item_id").distinct(), "item_id", "left_semi").select("item_id", "vec").unionByName(pad)


def mean_pairwise_cosine(vectors: DataFrame) -> DataFrame:
    """Mean cosine over all pairs of rows, from the length of the sum of unit rows: no pair is formed."""
    unit = vectors.select(l2_normalise(F.col("vec")).alias("u"))
    sums = unit.select(F.posexplode("u").alias("dim", "x")).groupBy("dim").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    n = F.max("n")
    return sums.agg(n.alias("n"), ((F.sum(F.col("s") * F.col("s")) - n) / (n * (n - 1))).alias("mean_cosine"))


def encoding_footprint(vectors: DataFrame) -> DataFrame:
    """Bytes a vector and in all under each encoding."""
    encodings = F.array(*[F.struct(F.lit(k).alias("encoding"), F.lit(v).alias("width")) for k, v in ENCODINGS.items()])
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim"))
    return size.select("n", "dim", F.inline(encodings)).select("encoding", (F.col("dim") * F.col("width")).cast("bigint").alias("bytes_per_vector"), (F.col("n") * F.col("dim") * F.col("width")).alias("total_bytes"))
