"""Joins of labels with vectors and metadata, and what they lose."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.functions.expr import hash_unit
from rillmark.operators.sketches import hot_keys, salts_of

#: Metadata tables up to this many rows are broadcast.
BROADCAST_ROWS = 1_000_000


def join_embeddings(samples: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rows whose item has a vector, with it."""
    return samples.join(vectors, "item_id")


def join_item_meta(samples: DataFrame, meta: DataFrame, rows: int | None = None) -> DataFrame:
    """All rows with their item's metadata; ``rows``, if the metadata's size is known, allows a broadcast."""
    return samples.join(F.broadcast(meta) if rows is not None and rows <= BROADCAST_ROWS else meta, "item_id", "left")


def vectorless_join(samples: DataFrame, meta: DataFrame, vectors: DataFrame) -> DataFrame:
    """Keys and metadata are joined first, and only for items with a vector; the wide vectors come last."""
    narrow = samples.join(vectors.select("item_id"), "item_id", "left_semi")
    return join_item_meta(narrow, meta).join(vectors, "item_id")


def training_join_summary(joined: DataFrame) -> DataFrame:
    return joined.agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("label").alias("positive_rate"), F.count_distinct("user_id").alias("n_users"),
        F.count_distinct("item_id").alias("n_items"), F.count_if(F.col("category").isNull()).alias("n_without_meta"), F.max(F.size("vec")).alias("dim"),
    )


def join_loss_audit(samples: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rows matched by the inner join, retention, and the positive rate before and after."""
    v = vectors.select(F.col("item_id").alias("__v")).distinct()
    both = samples.join(v, samples["item_id"] == F.col("__v"), "left")
    hit = F.col("__v").isNotNull()
    before, after = F.avg("label"), F.avg(F.when(hit, F.col("label")))
    return both.agg(
        F.count(F.lit(1)).alias("n_sampled"), F.count_if(hit).alias("n_matched"), F.avg(hit.cast("double")).alias("retention"),
        before.alias("rate_before"), after.alias("rate_after"), F.abs(after - before).alias("rate_shift"),
    )


def join_loss_rows(samples: DataFrame, vectors: DataFrame) -> DataFrame:
    return samples.join(vectors, "item_id", "left_anti")


def user_overlap(train: DataFrame, test: DataFrame) -> DataFrame:
    a, b = train.select("user_id").distinct().withColumn("a", F.lit(1)), test.select("user_id").distinct().withColumn("b", F.lit(1))
    both = F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull())
    return a.join(b, "user_id", "full").agg(F.count("a").alias("n_train_users"), F.count("b").alias("n_test_users"), both.alias("n_both"), (both / F.count("b")).alias("test_share"))


def complete_candidates(rows: DataFrame, users: DataFrame, meta: DataFrame, people: DataFrame) -> DataFrame:
    """Every row of the wanted users with item metadata and demographics."""
    return rows.join(users.select("user_id").distinct(), "user_id", "left_semi").join(meta, "item_id", "left").join(people, "user_id", "left")


def catalogue_union(*frames: DataFrame) -> DataFrame:
    out = frames[0].select("item_id")
    for f in frames[1:]:
        out = out.union(f.select("item_id"))
    return out.distinct()


def salted_join(large: DataFrame, small: DataFrame, key: str, salts: int, *row_key: str, how: str = "inner") -> DataFrame:
    """An equi-join whose hot keys are spread over ``salts`` tasks: the small side is repeated once a salt. For engines
    without run-time skew handling, or keys too hot for it."""
    salt = F.floor(hash_unit(42, *[F.col(c) for c in row_key]) * salts).cast("int")
    spread = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return large.withColumn("__salt", salt).join(spread, [key, "__salt"], how).drop("__salt")


def hot_key_join(large: DataFrame, small: DataFrame, key: str, *row_key: str, rows_a_task: int = 1_000_000, share: float = 0.001, how: str = "inner") -> DataFrame:
    """An equi-join in which only hot keys are spread, each over as many tasks as its rows need: ``rows_a_task`` of them each. Keys with over
    ``share`` of the rows are found by mergeable summaries; others have one salt, and the small side holds them once. ``large`` is
    read three times: write it first if it is costly."""
    salts = salts_of(hot_keys(large, key, share), rows_a_task).where("salts > 1").select(key, "salts")  # at most 1 / share rows
    spread = lambda df: df.join(F.broadcast(salts), key, "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    dealt = spread(large).withColumn("__salt", F.floor(hash_unit(42, *[F.col(c) for c in row_key]) * F.col("salts")).cast("int")).drop("salts")
    repeated = spread(small).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return dealt.join(repeated, [key, "__salt"], how).drop("__salt")
