"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source with target t and size s should be taken t / s times. The whole part is certain; the fractional
parts are rounded together: two documents pool their fractions, a random draw moves mass from one to the other until one
of them is 0 or 1, and the other goes on with the rest. Documents meet in small groups of like size, then the groups'
residuals meet in larger groups, up to one residual a source: a reduction tree whose nodes hold some 64 rows at any input
size. The number of copies of a source stays within one of its expectation, and since neighbours are of like size, so do
its words, nearly.

Defined cases: a null text has size 0 and nothing is taken of it; texts of any length count whole; a null source is a source of its
own, last in order; repeated rows are drawn one by one; rows of equal size and hash meet in the order of their draws; sources
that stop at one level, as sources of equal or proportional sizes do, stop together or not at all; an empty table
gives an empty result. Draws are hashes of a row's key, text and seed, so reruns agree. Other columns are carried along if asked
for, under their own names, but for those that the mix itself computes, which take their place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmark.functions.prefix import prefix_sum
from rillmark.llm.text import whole, words
from rillmark.scratch import materialize

#: Rows that a node of the reduction tree holds on average, as a power of two.
FAN_BITS = 6
#: No document is taken more than this many times.
MOST = 3


def sizes(docs: DataFrame, carry: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """Distinct rows with their multiplicity, spread again: one row a document without its text. ``dup`` numbers equal
    rows, so that a large group of them neither shares a draw nor meets in one place."""
    row = docs.select(
        F.struct(docs["doc_id"], *[docs[c] for c in carry]).alias("row"),
        docs["source"].alias("source"),
        F.size(words(docs[text])).cast("long").alias("size"),
        F.xxhash64(whole(docs[text])).alias("text_key"),
    )
    counted = row.groupBy("row", "source", "size", "text_key").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("row", "source", "size", "text_key", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("dup"))


def targets(sized: DataFrame) -> DataFrame:
    """``source, source_size, target``: weights 1, 2, 3 in code point order share all words; a source stops at ``MOST``
    times its size and the excess is shared again by weight until none is above."""
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # ranks without one global window: ranks inside ranges of the order, plus the rows of the ranges before
    ordered = F.col("source").asc_nulls_last()
    parted = per_source.repartitionByRange(ordered).select("*", F.spark_partition_id().alias("part"))
    local = materialize(parted.select("*", F.row_number().over(Window.partitionBy("part").orderBy(ordered)).alias("rn")), "sources")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    counts = local.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    weighted = local.join(F.broadcast(before), "part").select(
        "source", "source_size", ((F.col("rn") + F.col("offset") - 1) % 3 + 1).cast("long").alias("weight")
    )
    # classes of sources in order of the level at which they stop, equal ones together: each class's level if it and those after
    # it don't stop, in one pass of prefix sums; the first class that its own level leaves free fixes the level of all
    stop = (F.col("source_size") * MOST).cast("double")
    classes = weighted.groupBy((stop / F.col("weight")).alias("at")).agg(F.sum(stop).alias("stop"), F.sum("weight").alias("weight"))
    summed = prefix_sum(classes, "at", {"stopped": F.col("stop"), "used": F.col("weight")})
    total, weight = weighted.agg(F.sum("source_size"), F.sum("weight")).first()
    free = F.lit(float(weight or 0)) - F.col("used") + F.col("weight")
    levels = summed.select("at", ((F.lit(float(total or 0)) - F.col("stopped") + F.col("stop")) / free).alias("level"))
    level = levels.where(F.col("at") >= F.col("level") * (1 - 1e-12)).agg(F.min_by("level", "at")).first()[0] or 0.0
    target = F.least(stop, F.lit(level) * F.col("weight"))
    return weighted.select("source", "source_size", target.alias("target"))


def _draw(seed: int, *cols: Column) -> Column:
    """A number from 0 up to 1, fixed by the columns and the seed."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 52)).cast("double") / float(1 << 52)


def _node(group: DataFrame) -> DataFrame:
    """Rounds each group's array of rows: all but at most one row get ``copy`` 0 or 1; the rest of mass stays on it."""
    done_type = "array<struct<i:int,t:int>>"
    rows = F.transform(F.sort_array("rows", asc=False), lambda x, i: F.struct(i.alias("i"), x["p"].alias("p"), x["u"].alias("u")))

    def state(c: Column, p: Column, done: Column) -> Column:
        return F.struct(c.cast("int").alias("c"), p.cast("double").alias("p"), done.cast(done_type).alias("done"))

    def settled(i: Column, t: int) -> Column:
        return F.array(F.struct(i.cast("int").alias("i"), F.lit(t).alias("t")))

    def step(a: Column, x: Column) -> Column:
        both = a["p"] + x["p"]
        few = both < 1.0
        stays = F.when(few, x["u"] * both < a["p"]).otherwise(x["u"] * (2.0 - both) >= 1.0 - x["p"])
        bit = F.when(few, F.lit(0)).otherwise(F.lit(1))
        out = F.array(F.struct(F.when(stays, x["i"]).otherwise(a["c"]).cast("int").alias("i"), bit.alias("t")))
        left = F.when(few, both).otherwise(both - 1.0)
        keeper = F.when(stays, a["c"]).otherwise(x["i"])
        met = F.when(left < 1e-9, state(F.lit(-1), F.lit(0.0), F.concat(a["done"], out, settled(keeper, 0)))).otherwise(
            state(keeper, left, F.concat(a["done"], out))
        )
        return F.when(a["c"] < 0, state(x["i"], x["p"], a["done"])).otherwise(met)

    result = F.aggregate(rows, state(F.lit(-1), F.lit(0.0), F.array()), step)
    group = group.select(F.sort_array("rows", asc=False).alias("rows"), result.alias("r"))
    row = lambda i: F.get(F.col("rows"), i)["d"]
    out = F.transform("r.done", lambda d: F.struct(row(d["i"]).alias("d"), d["t"].alias("copy"), F.lit(0.0).alias("p")))
    rest = F.array(F.struct(row(F.col("r.c")).alias("d"), F.lit(None).cast("int").alias("copy"), F.col("r.p").alias("p")))
    return group.select(F.inline(F.when(F.col("r.c") >= 0, F.concat(out, rest)).otherwise(out)))


def mix(docs: DataFrame, carry: tuple[str, ...] = (), seed: int = 42, text: str = "text") -> DataFrame:
    """``doc_id``, the carried columns, ``source, size, text_key, source_size, target, copies, taken``."""
    carry = tuple(c for c in carry if c not in ("doc_id", "source", "size", "text_key", "source_size", "target", "copies", "taken"))
    sized = materialize(sizes(docs, carry, text), "sizes")
    rate = F.col("target") / F.col("source_size")
    key = [F.col("row.doc_id").cast("string"), F.col("source"), F.col("text_key"), F.col("dup")]
    planned = sized.withColumnRenamed("source", "s").join(targets(sized), F.col("s").eqNullSafe(F.col("source"))).select(
        F.struct("row", "source", "size", "text_key", "dup", "source_size", "target", F.when(F.col("size") > 0, F.floor(rate)).otherwise(0).cast("int").alias("whole")).alias("d"),
        F.when(F.col("size") > 0, rate - F.floor(rate)).otherwise(0.0).alias("p"),
        F.floor(4 * F.log2(F.greatest("size", F.lit(1)))).cast("int").alias("band"),
        F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 62)).alias("h"),
    )
    planned = materialize(planned, "planned")
    open_rows = planned.where("p > 0")
    most = open_rows.groupBy(F.col("d.source").alias("s"), "band").count().agg(F.max("count")).first()[0] or 0
    levels = max(1, math.ceil(math.log2(max(most, 1)) / FAN_BITS))
    done = [planned.where("p = 0").select("d", F.lit(0).alias("copy"))]
    for level in range(levels + 1):
        slices = 1 << (FAN_BITS * max(0, levels - 1 - level))
        by_band = F.col("band") if level < levels else F.lit(0)
        grouped = open_rows.groupBy(F.col("d.source").alias("s"), by_band.alias("b"), (F.col("h") % slices).alias("g")).agg(
            F.collect_list(F.struct(F.col("d.size").alias("size"), F.col("h"), _draw(seed + 1 + level, F.col("h")).alias("u"), F.col("p"), F.struct("d", "band", "h").alias("d"))).alias("rows")
        )
        met = materialize(_node(grouped), f"round{level}")
        done.append(met.where("copy is not null").select("d.d", "copy"))
        open_rows = met.where("copy is null").select("d.d", "p", "d.band", "d.h")
    done.append(open_rows.select("d", F.when(_draw(seed, F.col("h")) < F.col("p"), 1).otherwise(0).alias("copy")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = F.col("d.whole") + F.col("copy")
    return out.select("d.row.*", *[F.col(f"d.{c}").alias(c) for c in ("source", "size", "text_key", "source_size", "target")], copies.alias("copies"), (copies * F.col("d.size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 42) -> DataFrame:
    """The documents that the mix takes, once each, with ``size, source_size, target, copies, taken``; these take the place of
    columns of the same names. Repeated rows become one with the sum of their copies, its other columns those of one of them;
    documents without words are never taken; an empty table gives an empty result."""
    added = ("size", "source_size", "target", "copies", "taken")
    kinds = {c: F.first(c) if c in ("size", "source_size", "target") else F.sum(c) for c in added}
    key = [F.col(c).alias(f"k_{c}") for c in ("doc_id", "source", "text_key")]
    mixed = mix(docs, seed=seed).groupBy(*key).agg(*[kinds[c].alias(c) for c in added]).where("copies > 0")
    packed = docs.select(docs["doc_id"].alias("doc_id"), docs["source"].alias("source"), F.xxhash64(whole(docs["text"])).alias("text_key"), F.struct(*[docs[c] for c in docs.columns if c not in added]).alias("doc"))
    one = packed.groupBy("doc_id", "source", "text_key").agg(F.first("doc").alias("doc"))
    same = F.col("doc_id").eqNullSafe(F.col("k_doc_id")) & F.col("source").eqNullSafe(F.col("k_source")) & (F.col("text_key") == F.col("k_text_key"))
    return one.join(mixed, same).select("doc.*", *added)
