"""Event streams as plain frames: decoding, validation, de-duplication, sessions, rate limits. The functions without state
work on streaming frames too."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.functions.expr import bound

REQUIRED = ("user_id", "item_id", "event_type")
#: Why a message becomes a dead letter.
REASONS = ("decode", "schema", "store")
# Names of fields whose values are masked.
SECRET_FIELDS = ("api_key", "apikey", "authorization", "credential", "password", "secret", "token", "x-api-key")


def redact(name: Column, value: Column) -> Column:
    """``***`` for the value of a field with a secret-looking name."""
    return F.when(F.lower(name).rlike("|".join(SECRET_FIELDS)), F.lit("***")).otherwise(value)


def redact_map(fields: Column) -> Column:
    return F.transform_values(fields, lambda k, v: redact(k, v))


def redact_columns(df: DataFrame) -> DataFrame:
    masked = [c for c in df.columns if any(h in c.lower() for h in SECRET_FIELDS)]
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.lit("***")) for c in masked})


def check_event(raw: Column) -> Column:
    """``reason, user_id, item_id, event_type, event_id`` of a text: why it's rejected, or null and the typed fields. The text is parsed once."""
    kind = lambda v, path: F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit(""))

    def fields(v: Column, good: Column) -> Column:
        get = lambda path, type_: F.when(good, F.try_variant_get(v, path, type_))
        return F.struct(
            F.when(v.isNull(), F.lit("decode")).when(~good, F.lit("schema")).alias("reason"), get("$.user_id", "bigint").alias("user_id"), get("$.item_id", "bigint").alias("item_id"),
            get("$.event_type", "string").alias("event_type"), get("$.event_id", "string").alias("event_id"),
        )

    def read(v: Column) -> Column:
        is_object = F.schema_of_variant(v).startswith("OBJECT")
        return bound(is_object & (kind(v, "$.user_id") == "BIGINT") & (kind(v, "$.item_id") == "BIGINT") & (kind(v, "$.event_type") == "STRING"), lambda good: fields(v, good))

    return bound(F.try_parse_json(raw), read)


def validate(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds ``reason`` (null if accepted) and the typed fields of accepted events."""
    return df.withColumn("__event", check_event(F.col(raw))).select("*", "__event.*").drop("__event")


def default_event_id() -> Column:
    """The event's own id, or one made of its user, item, type and minute."""
    made = F.concat_ws(":", "user_id", "item_id", "event_type", F.floor(F.unix_seconds("ts") / 60).cast("bigint"))
    return F.coalesce(F.col("event_id").cast("string"), made)


def _first_in_ttl(batches: Iterator[pd.DataFrame], ttl: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by key and time: whether each is the first, or the first ``ttl`` after the last accepted one, of its key."""
    key, last = None, 0
    for b in batches:
        ok = []
        for k, t in zip(b["__key"].tolist(), b["__t"].tolist(), strict=True):
            fresh = k != key or t - last >= ttl
            if fresh:
                key, last = k, t
            ok.append(fresh)
        yield b.drop(columns=["__key", "__t"]).assign(accepted=ok)


def dedup(events: DataFrame, ttl_seconds: int, key: str = "event_id") -> DataFrame:
    """Adds ``accepted``: the first event of an id, and again the first one ``ttl_seconds`` or more after the last accepted.
    Rows of one id are sorted and read as a stream with a constant state, so an id of any number of rows fits in memory.
    Events without an id are all accepted; they stay out of the grouping, so they can't become one hot group."""
    named, unnamed = events.where(F.col(key).isNotNull()), events.where(F.col(key).isNull())
    keyed = named.select("*", F.col(key).cast("string").alias("__key"), F.unix_micros("ts").alias("__t"))
    ordered = keyed.repartition("__key").sortWithinPartitions("__key", "__t", "arrival")
    schema = T.StructType([*events.schema.fields, T.StructField("accepted", T.BooleanType())])
    return ordered.mapInPandas(partial(_first_in_ttl, ttl=ttl_seconds * 1_000_000), schema).unionByName(unnamed.withColumn("accepted", F.lit(True)))


def ingest_result() -> Column:
    """``rejected`` by the decoder or the schema, ``failed`` where the store refused it, else ``accepted`` or ``duplicate``."""
    return F.when(F.col("reason").isin("decode", "schema"), "rejected").when(F.col("reason").isNotNull(), "failed").when(F.col("accepted"), "accepted").otherwise("duplicate")


def ingest_counts(judged: DataFrame) -> DataFrame:
    """Events by day, result and, for dead letters, reason."""
    return judged.groupBy(F.date_trunc("day", "ts").alias("day"), ingest_result().alias("result"), "reason").agg(F.count(F.lit(1)).alias("n"))


def windows(events: DataFrame, *spec: str) -> DataFrame:
    """Counts and sums of values by tumbling or sliding window and type."""
    grouped = events.groupBy(F.window("ts", *spec), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def session_windows(events: DataFrame, gap: str) -> DataFrame:
    grouped = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


#: Ranges of arrival into which a source's rows are cut.
RANGES = 64


def late_events(events: DataFrame, delay_seconds: int, arrival: str, by: str, tie: str | None = None) -> DataFrame:
    """Events out of order and behind the watermark, along the order of ``arrival``, a number, inside each source; equal arrivals are ordered by
    ``tie``. A source's rows are cut into ranges of arrival, and each range starts from the latest time of those before it, so that a
    source with most of the rows isn't one task."""
    ties = [tie] if tie else []
    rows = events.select(by, F.col(arrival).alias("__a"), *ties, F.unix_micros("ts").alias("__t"))
    edges = rows.groupBy(by).agg(F.percentile_approx("__a", F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)]), F.lit(1000)).alias("__e"))
    cut = rows.join(edges, by).withColumn("__r", F.size(F.filter("__e", lambda e: e < F.col("__a")))).drop("__e")
    earlier = Window.partitionBy(by).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    tops = cut.groupBy(by, "__r").agg(F.max("__t").alias("__m")).select(by, "__r", F.max("__m").over(earlier).alias("__before"))
    before = Window.partitionBy(by, "__r").orderBy("__a", *ties).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.greatest(F.max("__t").over(before), F.col("__before"))
    marked = cut.join(tops, [by, "__r"]).select(by, (F.col("__t") - seen).alias("d"))
    return marked.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") < 0).alias("n_out_of_order"), F.count_if(F.col("d") < -delay_seconds * 1_000_000).alias("n_late"))


def _bucket(batches: Iterator[pd.DataFrame], burst: float, per_second: float) -> Iterator[pd.DataFrame]:
    """Rows sorted by user and time: each user's requests against the bucket; one row a user comes out."""
    columns = ["user_id", "n_requests", "n_admitted", "longest_wait"]
    user, at, tokens, n, ok, wait = None, None, 0.0, 0, 0, 0.0
    for b in batches:
        ended = []
        for u, t in zip(b["user_id"].tolist(), b["__t"].tolist(), strict=True):
            if n == 0 or u != user:
                if n:
                    ended.append((user, n, ok, wait))
                user, at, tokens, n, ok, wait = u, t, burst, 0, 0, 0.0
            tokens, at, n = min(burst, tokens + max(0, t - at) / 1e6 * per_second), t, n + 1
            if tokens >= 1:
                tokens, ok = tokens - 1, ok + 1
            else:
                wait = max(wait, (1 - tokens) / per_second)
        yield pd.DataFrame(ended, columns=columns)
    if n:
        yield pd.DataFrame([(user, n, ok, wait)], columns=columns)


def token_bucket(requests: DataFrame, burst: float, per_second: float) -> DataFrame:
    """``user_id, n_requests, n_admitted, longest_wait``: each user's requests, in order, against a bucket of ``burst`` tokens
    that fills by ``per_second``. A user's rows are sorted and read as a stream with a constant state: whatever share of all
    requests they hold, no task keeps them."""
    ordered = requests.select("user_id", F.unix_micros("ts").alias("__t"), "event_id").repartition("user_id").sortWithinPartitions("user_id", "__t", "event_id")
    work = partial(_bucket, burst=float(burst), per_second=float(per_second))
    return ordered.select("user_id", "__t").mapInPandas(work, "user_id long, n_requests long, n_admitted long, longest_wait double")


def publish_order(log: DataFrame, key: str, sequence: str, position: str) -> DataFrame:
    """Keys, and inversions of the sequence along the log's positions inside keys: none if the log keeps each key's order."""
    prev = F.lag(sequence).over(Window.partitionBy(key).orderBy(position))
    per = log.select(key, (F.col(sequence) < prev).alias("bad"))
    return per.agg(F.count_distinct(key).alias("n_keys"), F.count(F.lit(1)).alias("n_events"), F.count_if("bad").alias("n_inversions"))
