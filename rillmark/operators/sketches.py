"""Order statistics, distinct counts and hot keys: exact ones by passes over value classes, approximate ones by sketches that merge."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges into which a group's values are cut.
RANGES = 64


def exact_quantiles(rows: DataFrame, by: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """``by`` and a column a quantile, interpolated between neighbours as for a sorted list; nulls don't count.

    Rows are first counted by value, and a group's values cut into ranges, so neither a group's rows nor its distinct values meet in one task:
    totals of the ranges, at most ``RANGES`` a group, say in which range each wanted place lies and how many rows come before, and only there
    values are counted through."""
    classes = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    edges = classes.groupBy(*by).agg(F.percentile_approx("__v", F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)]), F.lit(1000)).alias("__e"))
    joined = classes.join(edges, by) if by else classes.crossJoin(F.broadcast(edges))
    cut = joined.select(*by, "__v", "__n", F.size(F.filter("__e", lambda e: e < F.col("__v"))).alias("__b"))
    totals = cut.groupBy(*by, "__b").agg(F.sum("__n").alias("__t"))
    earlier = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    placed = totals.select(*by, "__b", "__t", F.coalesce(F.sum("__t").over(earlier), F.lit(0)).alias("__o"), F.sum("__t").over(Window.partitionBy(*by)).alias("__all"))
    # the two neighbours of every wanted place, as numbers from 0
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(float(q)) * (F.col("__all") - 1)).alias("at")) for name, q in qs.items()])
    asked = placed.select("*", F.explode(wanted).alias("w")).where((F.floor("w.at") < F.col("__o") + F.col("__t")) & (F.ceil("w.at") >= F.col("__o")))
    ranges = asked.groupBy(*by, "__b", "__o").agg(F.collect_list("w").alias("__w"))
    inside = Window.partitionBy(*by, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    counted = cut.join(ranges, [*by, "__b"]).withColumn("__to", F.sum("__n").over(inside) + F.col("__o")).select("*", F.explode("__w").alias("w"))
    start = F.col("__to") - F.col("__n")
    holds = lambda place: (place >= start) & (place < F.col("__to"))
    low, high, part = F.floor("w.at"), F.ceil("w.at"), F.col("w.at") - F.floor("w.at")
    ends = counted.where(holds(low) | holds(high)).groupBy(*by, "w.name").agg(F.max(F.when(holds(low), F.col("__v"))).alias("a"), F.max(F.when(holds(high), F.col("__v"))).alias("b"), F.max(part).alias("p"))
    found = ends.select(*by, "name", (F.col("a") + (F.col("b") - F.col("a")) * F.col("p")).alias("q"))
    cells = [F.max(F.when(F.col("name") == name, F.col("q"))).alias(name) for name in qs]
    return found.groupBy(*by).agg(*cells) if by else found.agg(*cells)


def quantile_sketches(rows: DataFrame, by: list[str], value: str, k: int = 400) -> DataFrame:
    """``by, sketch``: a sketch of some kilobytes a group, whatever its rows; sketches of parts merge into that of the whole."""
    return rows.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def merged_quantiles(sketches: DataFrame, by: list[str], qs: dict[str, float], k: int = 400) -> DataFrame:
    """``by, n`` and a column a quantile of merged sketches; ranks are off by about 1 % at ``k`` 400."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("s"))
    return merged.select(*by, F.kll_sketch_get_n_double("s").alias("n"), *[F.kll_sketch_get_quantile_double("s", F.lit(float(q))).alias(name) for name, q in qs.items()])


def distinct_sketches(rows: DataFrame, by: list[str], columns: list[str], bits: int = 14) -> DataFrame:
    """``by`` and a sketch a column: stored by day, a new day costs that day."""
    return rows.groupBy(*by).agg(*[F.hll_sketch_agg(c, F.lit(bits)).alias(c) for c in columns])


def merged_distinct(sketches: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """``by`` and ``n_<column>``, the estimated distinct values of merged sketches: off by about 0.7 % at 14 bits."""
    return sketches.groupBy(*by).agg(*[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(f"n_{c}") for c in columns])


def _summarised(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """A Misra-Gries summary of the rows' keys: at most ``size`` of them, each short by no more than a ``size``-th of the task's rows."""
    held: dict = {}
    for b in batches:
        for k, n in b["key"].value_counts().items():
            held[k] = held.get(k, 0) + int(n)
        if len(held) > size:
            cut = sorted(held.values(), reverse=True)[size]
            held = {k: n - cut for k, n in held.items() if n > cut}
    if held:
        yield pd.DataFrame({"key": list(held), "n": list(held.values())})


def hot_keys(rows: DataFrame, key: str, share: float, size: int = 4096) -> DataFrame:
    """``key, n``: every key that holds more than ``share`` of all rows, with its exact number. Each task keeps a summary of at most ``size``
    keys, so a key with over a ``size``-th of a task's rows can't be missed by it; keys that any summary holds are then counted out.
    ``share`` must be over 2 / ``size``."""
    if share * size <= 2:
        raise ValueError(f"a summary of {size} keys can't find all keys with a share of {share}")
    kind = dict(rows.dtypes)[key]
    keys = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"))
    summaries = keys.mapInPandas(partial(_summarised, size=size), f"key {kind}, n long")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    # a hot key has its share of some task's rows at least; what the summaries took off is at most a size-th of all rows
    least = F.col("total") * (share - 1.0 / size)
    likely = summaries.groupBy("key").agg(F.sum("n").alias("low")).crossJoin(F.broadcast(total)).where(F.col("low") > least).select("key")  # at most 1 / (share - 1 / size) keys
    counted = keys.join(F.broadcast(likely), "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return counted.crossJoin(F.broadcast(total)).where(F.col("n") > F.col("total") * share).select(F.col("key").alias(key), "n")


def salts_of(hot: DataFrame, rows_a_task: int) -> DataFrame:
    """``hot`` with ``salts``, the number of tasks over which a key is to be spread."""
    return hot.withColumn("salts", F.greatest(F.lit(1), F.ceil(F.col("n") / rows_a_task)).cast("int"))


def within(estimate: Column, exact: Column, share: float) -> Column:
    return F.abs(estimate - exact) <= share * exact
