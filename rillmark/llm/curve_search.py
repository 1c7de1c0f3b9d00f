"""Nearest neighbours by inner product along shifted space-filling curves.

Vectors are projected to a few random directions, a draw of them a curve, shifted, and numbered along a Hilbert curve through the
projected space: near vectors get near numbers on some of the curves. Each curve's numbers are cut into cells of like size, a
vector asks the cells within a window around its own on every curve, and what the windows hold is merged and ranked by the inner
product of the whole vectors. All rows are indexed.

The window's width is measured, not assumed: ``TRIAL`` queries, chosen by hash, are also searched exactly, and the window is the
narrowest that holds ``RECALL`` of their true neighbours. On clustered vectors that is a cell or two; on vectors without any
structure, as random directions in 64 dimensions, no order of them keeps neighbours together and it comes to several hundredths of all
rows on each side. A table of fewer than two cells is searched whole.

For a largest inner product among vectors of different lengths, a vector gets one more coordinate that brings all to the greatest
length, and a query is stretched to it: nearest by distance is then largest by product.

Equal vectors are indexed once, with the ``k + 1`` smallest of their ids: more can't be among anyone's ``k`` nearest. So a vector
on a third of all rows is one row in the index, and its queries share one search.

Defined cases: rows without an id, and vectors that are null, empty, zero or hold a null or a number that isn't finite take no part, nor do
those of another dimension than most; repeated rows of one id and vector count once; an id with several vectors asks with each,
and none of its own rows is its neighbour; ties go to the smaller id; fewer candidates than ``k`` are all returned; an empty table
gives an empty result. Other columns, whatever their names, are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmark.functions.expr import dot, norm
from rillmark.llm.graph import join_lookup
from rillmark.operators.retrieval import cell_topk, exact_topk
from rillmark.scratch import Scratch, materialize

#: Curves, directions of each, and bits a direction.
CURVES, DIRECTIONS, DEPTH = 8, 6, 10
#: Vectors in a cell before windows are chosen, and most cells of a curve.
CELL_ROWS, MOST_CELLS = 512, 4096
#: Vectors from which the projections' centre and spread are taken, queries that choose the window, and the share of their
#: neighbours that it must hold.
SAMPLE, TRIAL, RECALL = 2_000, 256, 0.96
#: Cells on each side of a query's own that a window has at most: wider windows have larger cells.
SIDE = 3
#: Candidates that are kept beyond the number asked for, so that sums in another order can't push out a tie.
SPARE = 12
BLOCK = 4096


def hilbert(places: np.ndarray, bits: int) -> np.ndarray:
    """Numbers along the Hilbert curve of grid places, one row of ``places`` (of ``bits`` bits) a point: places are turned into the
    curve's own axes, from the coarsest bit to the finest, and their bits interleaved."""
    axes = list(places.T.astype(np.uint64))
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        low = (one << np.uint64(b)) - one
        for i in range(len(axes)):
            turned = (axes[i] >> np.uint64(b)) & one == 1
            swap = np.where(turned, np.uint64(0), (axes[0] ^ axes[i]) & low)
            axes[0] = np.where(turned, axes[0] ^ low, axes[0] ^ swap)
            axes[i] = axes[i] ^ swap
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    flip = np.zeros_like(axes[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((axes[-1] >> np.uint64(b)) & one == 1, (one << np.uint64(b)) - one, np.uint64(0))
    number = np.zeros_like(axes[0])
    for b in range(bits - 1, -1, -1):
        for a in axes:
            number = (number << one) | (((a ^ flip) >> np.uint64(b)) & one)
    return number.astype(np.int64)


@dataclass(frozen=True)
class Curves:
    """Directions (one more coordinate than the vectors have), centre and spread of the projections, shifts, and the greatest length."""

    directions: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    shift: np.ndarray
    length: float

    def numbers(self, vecs: np.ndarray, query: bool) -> np.ndarray:
        """Each vector's number on every curve."""
        n = np.linalg.norm(vecs, axis=1, keepdims=True)
        whole = np.hstack([vecs * (self.length / n), np.zeros_like(n)]) if query else np.hstack([vecs, np.sqrt(np.maximum(self.length**2 - n**2, 0.0))])
        at = np.clip((whole @ self.directions - self.centre) / (8 * self.spread) + 0.5, 0, 1 - 2**-30)
        places = ((at + self.shift) / 2 * (1 << DEPTH)).astype(np.int64)
        return np.stack([hilbert(places[:, c * DIRECTIONS : (c + 1) * DIRECTIONS], DEPTH) for c in range(CURVES)], axis=1)


def fit_curves(vectors: DataFrame, dim: int, seed: int = 42) -> Curves:
    rng = np.random.default_rng(seed)
    turns = [np.linalg.qr(rng.normal(size=(dim + 1, dim + 1)))[0] for _ in range(-(-CURVES * DIRECTIONS // (dim + 1)))]
    directions = np.hstack(turns)[:, : CURVES * DIRECTIONS]
    length = vectors.agg(F.max(norm(F.col("vec")))).first()[0]
    sample = vectors.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE).select("vec").collect()
    vecs = np.array([r["vec"] for r in sample])
    over = np.sqrt(np.maximum(length**2 - (vecs**2).sum(1, keepdims=True), 0.0))
    seen = np.hstack([vecs, over]) @ directions
    spread = seen.std(0)
    return Curves(directions, seen.mean(0), np.where(spread > 0, spread, 1.0), rng.random(CURVES * DIRECTIONS), length)


def usable(vectors: DataFrame, key: str, vec: str) -> tuple[DataFrame, int]:
    """Distinct ``id, vec`` of the rows that take part, and their dimension (0 if there are none)."""
    rows = vectors.select(vectors[key].cast("long").alias("id"), vectors[vec].cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = rows.where(F.col("id").isNotNull() & F.coalesce(finite & F.exists("vec", lambda x: x != 0), F.lit(False)))
    sizes = good.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    dim = sizes["d"] if sizes else 0
    return good.where(F.size("vec") == dim).distinct().withColumn("same", F.struct(F.xxhash64("vec").alias("h"), "vec")), dim


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """``id, same, vec, members``: each vector once, by its smallest id, with its ``k + 1`` smallest ids."""
    first = Window.partitionBy("same").orderBy("id")  # each task hands on k + 1 rows a vector
    kept = rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    return kept.groupBy("same").agg(F.sort_array(F.collect_list("id")).alias("members")).select(F.get("members", 0).alias("id"), "same", F.col("same.vec").alias("vec"), "members")


def numbered(vectors: DataFrame, curves: Curves, query: bool) -> DataFrame:
    """``id, vec, numbers``."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(numbers=list(curves.numbers(np.stack(b["vec"].to_list()), query)))

    return vectors.select("id", "vec").mapInPandas(each, "id long, vec array<double>, numbers array<long>")


def cell_bounds(numbers: DataFrame, cells: int) -> list[list[int]]:
    """Each curve's numbers at the ends of its cells, all but the last."""
    if cells < 2:
        return [[] for _ in range(CURVES)]
    shares = F.array(*[F.lit(i / cells) for i in range(1, cells)])
    row = numbers.agg(*[F.percentile_approx(F.get("numbers", c), shares, F.lit(20 * cells)).alias(str(c)) for c in range(CURVES)]).first()
    return [sorted(set(row[str(c)])) for c in range(CURVES)]


def placed(numbers: DataFrame, bounds: list[list[int]]) -> DataFrame:
    """``id, vec, cells``: the cell on every curve."""
    edges = [np.array(b, dtype=np.int64) for b in bounds]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                n = np.stack(b["numbers"].to_list())
                cells = np.stack([np.searchsorted(e, n[:, c], side="left") for c, e in enumerate(edges)], axis=1)
                yield b[["id", "vec"]].assign(cells=list(cells))

    return numbers.mapInPandas(each, "id long, vec array<double>, cells array<long>")


def window_for(items: DataFrame, queries: DataFrame, k: int, recall: float, seed: int) -> int:
    """Cells on each side that a window needs: over ``TRIAL`` queries and all items, the narrowest with that share of the ``k`` nearest."""
    trial = queries.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(TRIAL)
    exact = exact_topk(trial.select(F.col("id").alias("user_id"), "vec"), items.select(F.col("id").alias("item_id"), "vec"), k + 1, BLOCK)
    pairs = exact.where("user_id != item_id").select("user_id", "item_id")
    both = pairs.join(trial.select(F.col("id").alias("user_id"), F.col("cells").alias("a")), "user_id").join(items.select(F.col("id").alias("item_id"), F.col("cells").alias("b")), "item_id")
    apart = both.select(F.array_min(F.zip_with("a", "b", lambda x, y: F.abs(x - y))).alias("apart")).collect()  # at most TRIAL x (k + 1)
    far = sorted(r["apart"] for r in apart)
    return far[min(len(far) - 1, int(np.ceil(recall * len(far))))] if far else 0


def _cells(width: int, side: int) -> Column:
    """The cells around each curve's own, ``width`` to one, under one number for curve and cell."""
    wide = lambda x: F.floor(x / width)
    return F.flatten(F.transform("cells", lambda x, c: F.transform(F.sequence(wide(x) - side, wide(x) + side), lambda y: c * (MOST_CELLS + 2 * SIDE) + y)))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vec: str = "embedding", recall: float = RECALL, seed: int = 42, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest of each row for which ``is_query``, an expression over ``id``, holds."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    with Scratch(spark, "curve-search") as space:
        rows, dim = usable(vectors, key, vec)
        if not dim:
            return spark.createDataFrame([], schema)
        rows = space.keep(rows, "rows")
        index = space.keep(distinct_vectors(rows, k), "index")
        asked = space.keep(join_lookup(rows.where(is_query).select(F.col("id").alias("query_id"), "same"), index.select("same", F.col("id").alias("id")), "same").select("query_id", "id"), "asked")
        queries = index.join(asked.select("id").distinct(), "id", "left_semi").select("id", "vec")
        curves = fit_curves(index, dim, seed)
        numbers = space.keep(numbered(index, curves, False), "numbers")
        cells = int(min(MOST_CELLS, max(1, numbers.count() // cell_rows)))
        bounds = cell_bounds(numbers, cells)
        items = space.keep(placed(numbers, bounds), "items")
        queries = space.keep(placed(numbered(queries, curves, True), bounds), "queries")
        window = window_for(items, queries, k, recall, seed) if cells > 1 else 0
        width = max(1, -(-window // SIDE))
        side = -(-window // width)
        user = queries.select(F.col("id").alias("user_id"), "vec", F.explode(_cells(width, side)).alias("cell"))
        item = items.select(F.col("id").alias("item_id"), "vec", F.explode(_cells(width, 0)).alias("cell"))
        if cells == 1:  # all curves agree
            user, item = (d.where("cell = 0") for d in (user, item))
        met = space.keep(cell_topk(space.keep(user, "probes"), space.keep(item, "cells"), k + SPARE, BLOCK).select("user_id", "item_id"), "met")
        there = index.select(F.col("id").alias("item_id"), F.col("vec").alias("v"), "members")
        scored = met.join(there, "item_id").join(queries.select(F.col("id").alias("user_id"), F.col("vec").alias("u")), "user_id").select("user_id", "members", dot(F.col("u"), F.col("v")).alias("score"))
        ranked = scored.groupBy("user_id").agg(F.flatten(F.collect_list(F.transform("members", lambda m: F.struct((-F.col("score")).alias("s"), m.alias("vec_id"))))).alias("all"))
        lists = ranked.select(F.col("user_id").alias("id"), F.sort_array("all").alias("found"))
        own = join_lookup(asked, lists, "id").select("query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("found"))
        out = own.select("query_id", F.posexplode("found").alias("at", "x"))
        return materialize(out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (0.0 - F.col("x.s")).alias("score")), "nearest")
