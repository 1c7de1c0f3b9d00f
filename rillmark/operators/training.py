"""Splits, negatives and training tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmark.functions.expr import hash_unit, seeded_md5
from rillmark.functions.prefix import dense_rank_index
from rillmark.scratch import materialize


def pos_weight(rows: DataFrame) -> DataFrame:
    p = F.avg("label")
    return rows.agg(p.alias("positive_rate"), ((1 - p) / F.greatest(p, F.lit(1e-6))).alias("pos_weight"))


def log_q(rows: DataFrame) -> DataFrame:
    """``item_id, log_q``: log of the share of clicked rows that an item has."""
    counts = rows.where("label = 1").groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.crossJoin(F.broadcast(total)).select("item_id", F.log(F.col("n") / F.col("t") + 1e-12).alias("log_q"))


def epoch_shuffle(rows: DataFrame, keys: list[Column], batch: int, seed: int = 42, epoch: int = 0) -> DataFrame:
    """Rows in a seeded order with ``position`` and ``batch``: the same whatever the partitioning."""
    hashed = rows.withColumn("__u", hash_unit(seed + epoch, *keys))
    ranked = dense_rank_index(hashed, "__u", [seeded_md5(seed + epoch, *keys)], "position")
    return ranked.withColumn("batch", F.floor(F.col("position") / batch)).drop("__u")


def inbatch_negatives(clicked: DataFrame, log_q_of: DataFrame) -> DataFrame:
    """``batch, user_id, item_id, negative, weight``: the items of the other rows of the batch, but for the same user or
    item. A batch has a fixed number of rows, so the pairs stay proportional to the rows."""
    a, b = clicked.select("batch", "user_id", "item_id").alias("a"), clicked.select("batch", "user_id", "item_id").alias("b")
    pairs = a.join(b, (F.col("a.batch") == F.col("b.batch")) & (F.col("a.user_id") != F.col("b.user_id")) & (F.col("a.item_id") != F.col("b.item_id")))
    listed = pairs.select(F.col("a.batch").alias("batch"), F.col("a.user_id").alias("user_id"), F.col("a.item_id").alias("item_id"), F.col("b.item_id").alias("negative"))
    q = log_q_of.select(F.col("item_id").alias("negative"), (-F.col("log_q")).alias("weight"))
    return listed.join(q, "negative").select("batch", "user_id", "item_id", "negative", "weight")


def temporal_split(log: DataFrame) -> DataFrame:
    """The last day is for testing."""
    last = log.agg(F.date_trunc("day", F.max("ts")).alias("__last"))
    return log.crossJoin(F.broadcast(last)).withColumn("split", F.when(F.col("ts") < F.col("__last"), "train").otherwise("test")).drop("__last")


def leave_one_out(log: DataFrame) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return log.withColumn("split", F.when(F.row_number().over(w) == 1, "test").otherwise("train"))


def random_split(log: DataFrame, share: float, keys: list[Column], seed: int = 42) -> DataFrame:
    return log.withColumn("split", F.when(hash_unit(seed, *keys) < share, "test").otherwise("train"))


def _unseen(placed: DataFrame, seen: DataFrame, bounds: DataFrame) -> DataFrame:
    """``user_id, stratum, first, last``: for each user the stretches of positions of a stratum which they haven't seen, empty ones
    (``first > last``) among them; users who have seen nothing of a stratum don't occur."""
    held = seen.select("user_id", "item_id").distinct().join(placed.select("item_id", "pos"), "item_id")
    inside = held.join(F.broadcast(bounds), (F.col("pos") >= F.col("low")) & (F.col("pos") < F.col("high")))  # a row a stratum
    next_ = F.coalesce(F.lead("pos").over(Window.partitionBy("user_id", "stratum").orderBy("pos")), F.col("high"))
    after = inside.select("user_id", "stratum", (F.col("pos") + 1).alias("first"), (next_ - 1).alias("last"))
    head = inside.groupBy("user_id", "stratum").agg(F.min("low").alias("first"), (F.min("pos") - 1).alias("last"))
    return head.unionByName(after)


def stratified_negatives(positives: DataFrame, counts: DataFrame, seen: DataFrame, strata: int = 5, per_stratum: int = 1, slots: int = 20, seed: int = 42) -> DataFrame:
    """``user_id, item_id, stratum, negative``: for each positive and popularity stratum, the first ``per_stratum`` of ``slots`` hash-drawn
    items of the stratum that the user hasn't seen. Draws are index look-ups, so no user meets every item; ``per_stratum`` of them are made
    first, and all only where one of these is seen. Where fewer draws are new,
    the stratum's unseen items from the first draw on, and from its start after its end, fill up what is missing: a stratum with
    ``per_stratum`` unseen items or more gives that many, another all it has."""
    numbered = dense_rank_index(counts.withColumn("__o", -F.col("n")), "__o", [F.col("item_id")], "pos")
    size = numbered.agg(F.count(F.lit(1)).alias("total"))
    placed = materialize(numbered.select("item_id", "pos"), "placed")
    low, high = F.floor(F.col("total") * F.col("stratum") / strata), F.floor(F.col("total") * (F.col("stratum") + 1) / strata)
    bounds = size.select("total", F.explode(F.sequence(F.lit(0), F.lit(strata - 1))).alias("stratum")).select("stratum", low.cast("bigint").alias("low"), high.cast("bigint").alias("high"))
    every = positives.select("user_id", "item_id").distinct().crossJoin(F.broadcast(bounds)).where("low < high")  # a row a stratum
    place = lambda slot: (F.col("low") + F.floor(hash_unit(seed, F.col("user_id"), F.col("item_id"), F.col("stratum"), slot) * (F.col("high") - F.col("low")))).cast("bigint")
    known = seen.select("user_id", F.col("item_id").alias("negative")).distinct()
    group, first = ["user_id", "item_id", "stratum"], min(per_stratum, slots)

    def drawn(asked: DataFrame, n: int) -> DataFrame:
        tries = asked.select("*", F.posexplode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), place))).alias("slot", "pos"))
        return tries.join(placed.select("pos", F.col("item_id").alias("negative")), "pos")

    flagged = drawn(every, first).join(known.withColumn("met", F.lit(True)), ["user_id", "negative"], "left").withColumn("met", F.coalesce("met", F.lit(False)))
    n_fresh = F.when(~F.col("met"), 1).otherwise(0)
    if first > 1:  # one draw is a row of its own
        n_fresh = F.sum(n_fresh).over(Window.partitionBy(*group))
    tried = materialize(flagged.select(*group, "low", "high", "negative", (n_fresh == per_stratum).alias("done")), "draws")
    done = tried.where("done").select(*group, "negative")
    asked = materialize(tried.where("NOT done").select(*group, "low", "high").distinct(), "asked")
    seen = seen.join(asked.select("user_id").distinct(), "user_id", "left_semi")
    fresh = drawn(asked, slots).join(known, ["user_id", "negative"], "left_anti")
    w = Window.partitionBy("user_id", "item_id", "stratum").orderBy("slot")
    chosen = fresh.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_stratum)
    got = chosen.groupBy("user_id", "item_id", "stratum").agg(F.collect_list("pos").alias("taken"))
    short = asked.join(got, ["user_id", "item_id", "stratum"], "left").withColumn("missing", F.lit(per_stratum) - F.coalesce(F.size("taken"), F.lit(0))).where("missing > 0")
    # the next unseen places, past those that are taken: each stretch hands on as many as can be wanted of it
    gaps = short.withColumn("start", place(F.lit(0))).join(_unseen(placed, seen, bounds), ["user_id", "stratum"], "left")
    begun = gaps.withColumns({"first": F.coalesce("first", "low"), "last": F.coalesce("last", F.col("high") - 1)})
    wanted = F.lit(per_stratum) + F.coalesce(F.size("taken"), F.lit(0))
    ahead = F.greatest("first", "start")
    two = F.array(F.struct(F.lit(0).alias("lap"), ahead.alias("a"), F.col("last").alias("z")), F.struct(F.lit(1).alias("lap"), F.col("first").alias("a"), F.least("last", F.col("start") - 1).alias("z")))
    stretches = begun.select("*", F.inline(two)).where("a <= z")
    nth = Window.partitionBy("user_id", "item_id", "stratum").orderBy("lap", "a")
    near = stretches.withColumn("before", F.coalesce(F.sum(F.col("z") - F.col("a") + 1).over(nth.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") < wanted)
    places = near.select("*", F.explode(F.sequence(F.col("a"), F.least("z", F.col("a") + wanted - 1))).alias("pos")).where(~F.coalesce(F.array_contains("taken", F.col("pos")), F.lit(False)))
    filled = places.withColumn("r", F.row_number().over(nth.orderBy("lap", "pos"))).where(F.col("r") <= F.col("missing"))
    rest = filled.join(placed.select("pos", F.col("item_id").alias("negative")), "pos")
    return done.unionByName(chosen.select("user_id", "item_id", "stratum", "negative")).unionByName(rest.select("user_id", "item_id", "stratum", "negative"))


def split_overlap(frames: dict[str, DataFrame]) -> DataFrame:
    """``scheme, n_test, shared_users, shared_items``: what each way to split lets through."""
    out = None
    for name, df in frames.items():
        flags = lambda key: df.groupBy(key).agg(F.max((F.col("split") == "train").cast("int")).alias("a"), F.max((F.col("split") == "test").cast("int")).alias("b"))  # noqa: E731, B023
        shared = lambda key, alias: flags(key).agg(F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias(alias))
        one = df.agg(F.lit(name).alias("scheme"), F.count_if(F.col("split") == "test").alias("n_test")).crossJoin(shared("user_id", "shared_users")).crossJoin(shared("item_id", "shared_items"))
        out = one if out is None else out.unionByName(one)
    return out
