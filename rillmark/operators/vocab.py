"""Vocabularies: sorted distinct ids with a dense index, encoding, decoding and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillmark.functions.prefix import dense_rank_index
from rillmark.scratch import materialize


def build_vocab(ids: DataFrame, column: str) -> DataFrame:
    """``id, idx``: distinct non-null ids in ascending order from 0."""
    return dense_rank_index(ids.select(F.col(column).alias("id")).where("id is not null").distinct(), "id", [])


#: Distinct values up to which a column's vocabulary goes through the driver.
SMALL = 100_000


def small_vocab(ids: DataFrame, column: str) -> DataFrame:
    """The same for a category column of any type. Values are numbered inside ranges of their order, and the ranges' sizes, a row a
    partition, give the offsets: no task holds them all, however many there are."""
    distinct = ids.select(F.col(column).alias("id")).where("id is not null").distinct()
    parted = materialize(distinct.repartitionByRange("id").select("id", F.spark_partition_id().alias("part")), "vocabulary")
    local = parted.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("id")))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parted.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    return local.join(F.broadcast(before), "part").select("id", (F.col("r") - 1 + F.col("offset")).cast("bigint").alias("idx"))


def small_vocabs(df: DataFrame, columns: list[str]) -> dict[str, tuple[DataFrame, int]]:
    """A vocabulary and its size for each column: of columns of up to some ``SMALL`` values by one pass for their numbers and one for all of them
    together, of others by ``small_vocab``."""
    spark = df.sparkSession
    near = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    few = [c for c in columns if near[c] <= SMALL]
    held = df.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in few]).first() if few else {}
    out = {}
    for c in columns:
        if c in few:
            rows = [(v, i) for i, v in enumerate(held[c])]
            out[c] = spark.createDataFrame(rows, f"id {dict(df.dtypes)[c]}, idx bigint"), len(rows)
        else:
            vocab = materialize(small_vocab(df, c), "vocabulary")
            out[c] = vocab, vocab.count()
    return out


def vocab_size(vocab: DataFrame) -> DataFrame:
    return vocab.agg(F.count(F.lit(1)).alias("size"))


def encode_ids(df: DataFrame, vocab: DataFrame, column: str, out: str, size: int | None = None) -> DataFrame:
    """Adds the index; ids outside the vocabulary share the slot after the last. A known ``size`` of the vocabulary saves counting it."""
    v = vocab.select(F.col("id").alias("__id"), F.col("idx").alias("__idx"))
    if size is not None:
        v = F.broadcast(v) if size <= SMALL else v
        return df.join(v, df[column] == F.col("__id"), "left").withColumn(out, F.coalesce("__idx", F.lit(size).cast("bigint"))).drop("__id", "__idx")
    return df.join(v, df[column] == F.col("__id"), "left").crossJoin(F.broadcast(vocab_size(vocab))).withColumn(out, F.coalesce("__idx", "size")).drop("__id", "__idx", "size")


def decode_ids(df: DataFrame, vocab: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the id; an index out of range gives -1."""
    v = vocab.select(F.col("id").alias(out), F.col("idx").alias("__idx"))
    return df.join(v, df[column] == F.col("__idx"), "left").withColumn(out, F.coalesce(out, F.lit(-1))).drop("__idx")


def encode_ragged(df: DataFrame, vocab: DataFrame, key: str, column: str, out: str) -> DataFrame:
    """``key, out``: each list with its elements encoded in place."""
    flat = df.select(key, F.posexplode(column).alias("pos", "element"))
    coded = encode_ids(flat, vocab, "element", "idx").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "idx"))).alias("p"))
    listed = coded.select(F.col(key).alias("__k"), F.transform("p", lambda x: x["idx"]).alias(out))
    empty = F.array().cast("array<bigint>")
    return df.select(key).join(listed, F.col(key) == F.col("__k"), "left").select(key, F.coalesce(out, empty).alias(out))


def vocab_coverage(df: DataFrame, vocab: DataFrame, column: str) -> DataFrame:
    """``n, n_found, coverage`` of the rows' ids."""
    found = df.join(vocab.select(F.col("id").alias("__id")), df[column] == F.col("__id"), "left")
    return found.agg(F.count(F.lit(1)).alias("n"), F.count("__id").alias("n_found"), F.avg(F.col("__id").isNotNull().cast("double")).alias("coverage"))


def vocab_stats(vocab: DataFrame, vectors: DataFrame) -> DataFrame:
    """Size, members with a vector and their share, the pad index, and the least and greatest id."""
    has = vocab.join(vectors.select(F.col("item_id").alias("__v")).distinct(), vocab["id"] == F.col("__v"), "left")
    n, w = F.count(F.lit(1)), F.count("__v")
    return has.agg(n.alias("size"), w.alias("n_with_vector"), (w / n).alias("vector_share"), n.alias("pad_index"), F.min("id").alias("min_id"), F.max("id").alias("max_id"))


def encode_categoricals(df: DataFrame, vocabs: dict[str, DataFrame | tuple[DataFrame, int]]) -> DataFrame:
    """Adds ``<column>_idx`` for each small vocabulary, with or without its size."""
    for column, vocab in vocabs.items():
        df = encode_ids(df, *([vocab] if isinstance(vocab, DataFrame) else [vocab[0]]), column, f"{column}_idx", None if isinstance(vocab, DataFrame) else vocab[1])
    return df


def cardinalities(vocabs: dict[str, DataFrame]) -> DataFrame:
    """``field, cardinality``: the size of each vocabulary with its slot for the unknown."""
    out = None
    for name, vocab in vocabs.items():
        one = vocab.agg(F.lit(name).alias("field"), (F.count(F.lit(1)) + 1).alias("cardinality"))
        out = one if out is None else out.unionByName(one)
    return out


def key_order_check(df: DataFrame, key: str, order: str) -> DataFrame:
    """Inversions of ``key`` along ``order``, and keys that repeat. Neighbours are compared within ranges of ``order``, then
    the ends of the ranges with each other."""
    part = materialize(df.repartitionByRange(order).select(F.col(key).alias("k"), F.col(order).alias("o"), F.spark_partition_id().alias("p")), "ranges")  # two branches read one and the same ranges
    w = Window.partitionBy("p").orderBy("o")
    inside = part.withColumn("prev", F.lag("k").over(w))
    ends = part.groupBy("p").agg(F.min_by("k", "o").alias("first"), F.max_by("k", "o").alias("last"))
    across = ends.withColumn("prev", F.lag("last").over(Window.orderBy("p"))).agg(F.count_if(F.col("first") < F.col("prev")).alias("x"))
    counts = inside.agg(F.count_if(F.col("k") < F.col("prev")).alias("i"))
    repeated = df.groupBy(key).count().where("count > 1").agg(F.count(F.lit(1)).alias("n_repeated_keys"))
    return counts.crossJoin(across).crossJoin(repeated).select((F.col("i") + F.col("x")).alias("n_inversions"), "n_repeated_keys")


def key_to_row(ids: DataFrame, keyed: DataFrame, column: str, key: str, row: str) -> DataFrame:
    """Adds ``row_index``: the first row of the key, -1 if it has none."""
    first = keyed.groupBy(F.col(key).alias("__k")).agg(F.min(row).alias("row_index"))
    return ids.join(first, ids[column] == F.col("__k"), "left").withColumn("row_index", F.coalesce("row_index", F.lit(-1).cast("bigint"))).drop("__k")


def unify_users(frames: list[DataFrame], key: str) -> DataFrame:
    """One row a user over frames in order of preference, the first that has the user wins."""
    tagged = None
    for i, f in enumerate(frames):
        one = f.withColumn("__rank", F.lit(i))
        tagged = one if tagged is None else tagged.unionByName(one)
    rest = [c for c in tagged.columns if c not in (key, "__rank")]
    return tagged.groupBy(key).agg(F.min_by(F.struct(*rest), "__rank").alias("__best")).select(key, "__best.*")
