"""Per-user histories, sessions and pooled vectors."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillmark.functions.expr import l2_normalise, pad_left


#: Vectors of up to so many bytes are broadcast.
BROADCAST_BYTES = 64 << 20


def newest_rows(rows: DataFrame, order: list[str], newest: int = 1000) -> DataFrame:
    """The newest rows of each user, numbered as ``__r`` from the newest."""
    last = Window.partitionBy("user_id").orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__r", F.row_number().over(last)).where(F.col("__r") <= newest)


def user_history(rows: DataFrame, order: list[str], newest: int = 1000) -> DataFrame:
    """``user_id, history``: the newest items of each user, oldest first."""
    # sort_array: array_sort goes through an interpreted comparison
    listed = newest_rows(rows, order, newest).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("__r")).alias("o"), "item_id"))).alias("h"))
    return listed.select("user_id", F.col("h")["item_id"].alias("history"))


def first_row_per_user(rows: DataFrame, order: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c != "user_id"]
    return rows.groupBy("user_id").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select("user_id", "__r.*")


def padded(histories: DataFrame, length: int, pad: int = -1) -> DataFrame:
    return histories.select("user_id", pad_left(F.col("history"), length, pad).alias("history"))


def ragged_offsets(histories: DataFrame) -> DataFrame:
    """``user_id, start, end``: where each user's items lie when all histories are laid end to end by user."""
    from rillmark.functions.prefix import prefix_sum

    sized = histories.select("user_id", F.size("history").cast("bigint").alias("n"))
    summed = prefix_sum(sized, "user_id", {"end": F.col("n")})
    return summed.select("user_id", (F.col("end") - F.col("n")).alias("start"), "end")


def pooled(histories: DataFrame, vectors: DataFrame, last: int | None = 200, missing_as_zero: bool = False) -> DataFrame:
    """``user_id, vec``: the mean vector of the last items; unknown ones are left out or, for the retrieval baseline, count as
    zeros. Users without any vector are absent: theirs is zero."""
    items = F.col("history") if last is None else F.slice("history", -F.least(F.size("history"), F.lit(last)), last)
    flat = histories.where(F.size("history") > 0).select("user_id", F.explode(items).alias("item_id"), F.size(items).alias("n"))
    found = flat.join(vectors, "item_id").select("user_id", "n", array_to_vector("vec").alias("v"))
    mean = found.groupBy("user_id").agg(Summarizer.mean(F.col("v")).alias("mean"), (F.count(F.lit(1)) / F.max("n")).alias("share"))  # summed map-side
    vec = vector_to_array("mean")
    return mean.select("user_id", (F.transform(vec, lambda x: x * F.col("share")) if missing_as_zero else vec).alias("vec"))


def unit_pooled(histories: DataFrame, vectors: DataFrame) -> DataFrame:
    return pooled(histories, vectors, None, True).select("user_id", l2_normalise(F.col("vec")).alias("vec"))


def unit_directions(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """What ``unit_pooled`` gives for lists of all ``rows`` of a user, ``user_id, item_id``, without making the lists. Vectors of up to ``BROADCAST_BYTES`` come to the
    rows, so that rows that lie by user stay where they are."""
    size = vectors.agg(F.sum(F.size("vec") * 8 + 24)).first()[0] or 0
    known = vectors.select("item_id", array_to_vector("vec").alias("v"))
    found = rows.select("user_id", "item_id").join(F.broadcast(known) if size <= BROADCAST_BYTES else known, "item_id")
    return found.groupBy("user_id").agg(Summarizer.sum(F.col("v")).alias("v")).select("user_id", l2_normalise(vector_to_array("v")).alias("vec"))


def completeness_check(rows: DataFrame, histories: DataFrame, least: int, most: int) -> DataFrame:
    per_user = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    known = histories.where(F.size("history") > 0).select(F.col("user_id").alias("__u"))
    both = per_user.join(known, per_user["user_id"] == F.col("__u"), "left")
    mean = F.avg("n")
    return both.agg(mean.alias("rows_per_user"), ((mean > least) & (mean < most)).alias("within_bounds"), F.count_if(F.col("__u").isNull()).alias("n_without_history"))


def session_snapshot(events: DataFrame, keep: int = 50) -> DataFrame:
    """``user_id, session``: the last items of each user, newest first."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    kept = events.withColumn("r", F.row_number().over(w)).where(F.col("r") <= keep)
    return kept.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("r", "item_id"))).alias("s")).select("user_id", F.transform("s", lambda x: x["item_id"]).alias("session"))


def sessions(events: DataFrame, ttl_seconds: int) -> DataFrame:
    """``events`` with ``session_no`` from 1 by user: a session ends after ``ttl_seconds`` without an event."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))
    started = F.when(gap < ttl_seconds * 1_000_000, 0).otherwise(1)
    return events.withColumn("__new", started).withColumn("session_no", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
