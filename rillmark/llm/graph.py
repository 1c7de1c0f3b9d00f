"""Connected components of links, and joins whose hot keys don't land in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.scratch import Scratch

#: A key is hot if it has more than this share of all rows, and at least ``HOT_ROWS``: so at most 10,000 keys are.
HOT_SHARE, HOT_ROWS = 10_000, 500


def join_lookup(rows: DataFrame, lookup: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``lookup``, which has at most one row a key, none of them null. Hot keys are joined by a
    broadcast of theirs alone, at most ``HOT_SHARE`` rows; others by a shuffle. ``rows`` are read three times."""
    least = F.greatest(F.col("total") / HOT_SHARE, F.lit(HOT_ROWS))
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hot = counts.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total")))).where(F.col("n") > least).select(key)
    few = lookup.join(F.broadcast(hot), key, "left_semi")
    rest = rows.join(F.broadcast(hot), key, "left_anti").join(lookup, key, how)
    return rows.join(F.broadcast(few), key).unionByName(rest)


def components(pairs: DataFrame, space: Scratch) -> DataFrame:
    """``node, root``: every node of the links ``a, b`` and the smallest node that it reaches, by alternating stars. Each round
    is written once and the one before is deleted."""
    edges = space.keep(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    while True:
        # large stars: each node's larger neighbours go to the smallest node around it
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = space.keep(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "large")
        # small stars: each node and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = space.keep(moved.select("e.u", "e.v").where("u != v").distinct(), "small")
        gone = edges.join(small, ["u", "v"], "left_anti").isEmpty() and small.join(edges, ["u", "v"], "left_anti").isEmpty()
        space.drop(edges)
        space.drop(large)
        edges = small
        if gone:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
