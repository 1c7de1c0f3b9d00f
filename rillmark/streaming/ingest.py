"""The event stream: validation and dead letters, de-duplication and sessions with state, and recommendations per batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from rillmark.operators import events as E

KEEP = 50
TTL_SECONDS = 3600
#: How far behind the latest event an event may still come.
DELAY = "1 hour"


def parsed_stream(raw: DataFrame) -> DataFrame:
    """Raw bytes under ``raw`` with ``text``, ``reason`` and the typed fields; bytes that aren't UTF-8 fail to decode."""
    text = F.try_validate_utf8(F.col("raw").cast("string"))
    return E.validate(raw.withColumn("text", F.coalesce(text, F.lit(""))), "text")


def dead_letters(parsed: DataFrame) -> DataFrame:
    """``reason, error, raw``: what was refused, with its bytes as they came."""
    return parsed.where(F.col("reason").isNotNull()).select("reason", F.concat(F.lit("refused: "), "reason").alias("error"), "raw")


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNull()).drop("reason", "raw", "text")


def route(accept: Callable[[DataFrame], None], reject: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function with two sinks that reads its batch once."""

    def each(batch: DataFrame, _: int) -> None:
        kept = batch.persist()
        try:
            accept(accepted(kept))
            reject(dead_letters(kept))
        finally:
            kept.unpersist()

    return each


def write_with_retry(write: Callable[[DataFrame, int], None], give_up: Callable[[DataFrame], None], attempts: int = 3) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that tries a sink again and, when it keeps failing, sets the batch aside as dead letters
    with reason ``store``. Sinks should be idempotent by the batch's number: a restart repeats the last batch."""

    def each(batch: DataFrame, batch_id: int) -> None:
        kept, error = batch.persist(), ""
        try:
            for _ in range(attempts):
                try:
                    write(kept, batch_id)
                    return
                except Exception as e:  # noqa: BLE001 - whatever a sink raises
                    error = str(e)[:500]
            raw = F.to_json(F.struct(*kept.columns)).cast("binary")
            give_up(kept.select(F.lit("store").alias("reason"), F.lit(error).alias("error"), raw.alias("raw")))
        finally:
            kept.unpersist()

    return each


def _millis(t) -> int:
    return int(pd.Timestamp(t).value // 1_000_000)


class FirstSight(StatefulProcessor):
    """Passes the first event of an id, and again the first one a time-to-live after the last that passed. An id is
    forgotten once the watermark is a time-to-live beyond the event that passed."""

    def __init__(self, ttl_seconds: int = TTL_SECONDS):
        self.ttl = ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "t timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = last = self.last.get()[0] if self.last.exists() else None
        # all rows of the trigger in order of time, over all of its batches: one row a time is enough, others are repeats
        events = pd.concat([b.drop_duplicates("ts") for b in rows]).drop_duplicates("ts").sort_values("ts", kind="stable")
        ok = []
        for t in events["ts"]:
            passes = last is None or (t - pd.Timestamp(last)).total_seconds() >= self.ttl
            ok.append(passes)
            last = t if passes else last
        if last is not before:
            if before is not None:
                self.handle.deleteTimer(_millis(before) + self.ttl * 1000)
            self.last.update((pd.Timestamp(last).to_pydatetime(),))
            self.handle.registerTimer(_millis(last) + self.ttl * 1000)
        yield events[ok]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


class Session(StatefulProcessor):
    """The last items of a user, newest first; forgotten once the watermark is a time-to-live beyond the last event."""

    def __init__(self, keep: int = KEEP, ttl_seconds: int = TTL_SECONDS):
        self.keep, self.ttl = keep, ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("session", "items array<bigint>, times array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        items, times = self.state.get() if self.state.exists() else ([], [])
        held = pd.DataFrame({"t": list(times), "item": list(items), "new": 0})
        before = max(times, default=None)
        for b in rows:  # never more than one batch and the newest events before it
            more = pd.DataFrame({"t": pd.to_datetime(b["ts"]).astype("datetime64[us]").astype("int64"), "item": b["item_id"], "new": 1})
            held = pd.concat([held, more]).sort_values(["t", "new", "item"], kind="stable").tail(self.keep)
        held = held.astype("int64")
        t = held["t"].to_numpy()[::-1]
        gaps = (t[:-1] - t[1:] >= self.ttl * 1_000_000).nonzero()[0]  # the session begins after the last pause
        n = int(gaps[0]) + 1 if len(gaps) else len(t)
        items, times = held["item"].tolist()[::-1][:n], t[:n].tolist()
        self.state.update(([int(x) for x in items], [int(x) for x in times]))
        if before is not None:
            self.handle.deleteTimer(before // 1000 + self.ttl * 1000)
        self.handle.registerTimer(times[0] // 1000 + self.ttl * 1000)
        yield pd.DataFrame({"user_id": [key[0]], "session": [items], "updated": [pd.Timestamp(times[0], unit="us")]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


class Lateness(StatefulProcessor):
    """Counts of a source's events, of those out of order and of those behind its watermark, along their arrival."""

    def __init__(self, delay_seconds: int):
        self.delay = delay_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("counts", "seen bigint, n bigint, disordered bigint, late bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen, n, disordered, late = self.state.get() if self.state.exists() else (None, 0, 0, 0)
        for b in rows:
            t = pd.to_datetime(b.sort_values("arrival")["ts"]).astype("datetime64[us]").astype("int64").to_numpy()
            high = np.maximum.accumulate(np.concatenate([[t[0] if seen is None else seen], t]))
            behind = t - high[:-1]
            n, disordered, late = n + len(t), disordered + int((behind < 0).sum()), late + int((behind < -self.delay * 1_000_000).sum())
            seen = int(high[-1])
        self.state.update((seen, n, disordered, late))
        yield pd.DataFrame({"source": [str(key[0])], "n": [n], "n_out_of_order": [disordered], "n_late": [late]})

    def close(self) -> None:
        pass


def dedup_stream(events: DataFrame, ttl_seconds: int = TTL_SECONDS, delay: str = DELAY) -> DataFrame:
    """Accepted events of a stream; those without an id go around the state. Events with an id that are older than the
    watermark, ``delay`` behind the latest, are refused: their ids may have been forgotten."""
    named, unnamed = events.where("event_id is not null"), events.where("event_id is null")
    watched = named.withWatermark("ts", delay).groupBy("event_id")
    passed = watched.transformWithStateInPandas(FirstSight(ttl_seconds), outputStructType=events.schema, outputMode="Append", timeMode="EventTime")
    return passed.unionByName(unnamed)


def session_stream(events: DataFrame, keep: int = KEEP, ttl_seconds: int = TTL_SECONDS, delay: str | None = DELAY) -> DataFrame:
    """``user_id, session, updated`` of each user touched in a batch. Without a ``delay`` the events carry a watermark already."""
    return (events.withWatermark("ts", delay) if delay else events).groupBy("user_id").transformWithStateInPandas(
        Session(keep, ttl_seconds), outputStructType="user_id long, session array<bigint>, updated timestamp", outputMode="Update", timeMode="EventTime"
    )


def first_sessions(events: DataFrame, keep: int = KEEP, ttl_seconds: int = TTL_SECONDS, delay: str = DELAY) -> DataFrame:
    """De-duplicated events made into sessions by one query, whose checkpoint commits what it has seen and what it holds together. All
    events pass the first state: those without an id by an id of their own, made of what they are, so that a replay drops them too."""
    own = F.concat_ws(":", F.lit("none"), "user_id", "item_id", F.unix_micros("ts"))
    named = events.withColumn("event_id", F.coalesce("event_id", own)).withWatermark("ts", delay).groupBy("event_id")
    passed = named.transformWithStateInPandas(FirstSight(ttl_seconds), outputStructType=events.schema, outputMode="Append", timeMode="EventTime", eventTimeColumnName="ts")
    return passed.groupBy("user_id").transformWithStateInPandas(
        Session(keep, ttl_seconds), outputStructType="user_id long, session array<bigint>, updated timestamp", outputMode="Append", timeMode="EventTime"
    )


def window_stream(events: DataFrame, *spec: str, delay: str = DELAY) -> DataFrame:
    """Counts and sums by tumbling or sliding window and type, each given out once, when the watermark has passed its end."""
    return E.windows(events.withWatermark("ts", delay), *spec)


def session_window_stream(events: DataFrame, gap: str, delay: str = DELAY) -> DataFrame:
    return E.session_windows(events.withWatermark("ts", delay), gap)


def late_stream(events: DataFrame, delay_seconds: int) -> DataFrame:
    """Running counts of a stream's late events, for ``source, ts, arrival``: constant state a source."""
    return events.groupBy("source").transformWithStateInPandas(
        Lateness(delay_seconds), outputStructType="source string, n long, n_out_of_order long, n_late long", outputMode="Update", timeMode="None"
    )


def recommend_touched(recommend: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function over ``session_stream``: new lists for the users of the batch, by their last session."""

    def each(batch: DataFrame, batch_id: int) -> None:
        latest = batch.groupBy("user_id").agg(F.max_by("session", "updated").alias("session"))
        write(recommend(latest), batch_id)

    return each


def observed_counts(parsed: DataFrame, name: str = "ingest") -> DataFrame:
    """The stream with each batch's received, valid and refused rows, and dead letters by reason, in its progress."""
    refused = F.col("reason").isNotNull()
    return parsed.observe(
        name, F.count(F.lit(1)).alias("received"), F.count_if(~refused).alias("valid"), F.count_if(refused).alias("rejected"),
        *[F.count_if(F.col("reason") == r).alias(r) for r in E.REASONS],
    )


def observed_accepted(passed: DataFrame, name: str = "accepted") -> DataFrame:
    """The same for what de-duplication has let through: valid rows beyond these are duplicates."""
    return passed.observe(name, F.count(F.lit(1)).alias("accepted"))


def ingest_count_stream(judged: DataFrame, width: str = "1 day", delay: str = DELAY) -> DataFrame:
    """``start, result, reason, n`` of a stream of judged rows by window, each given out once, when the watermark has passed its end."""
    counted = judged.withWatermark("ts", delay).groupBy(F.window("ts", width), E.ingest_result().alias("result"), "reason").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), "result", "reason", "n")


def replay(log: DataFrame, folder: str, slices: int) -> None:
    """Lays a log out as files in order of time, for a file stream with ``maxFilesPerTrigger`` to replay at any speed."""
    sliced = log.repartitionByRange(slices, "ts").sortWithinPartitions("ts")
    sliced.write.mode("overwrite").json(folder)
