"""Rate limits over a stream: requests put back into order, then held against each caller's token bucket."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from rillmark.streaming.ingest import DELAY

OUT = "user_id long, event_id long, ts timestamp, admitted boolean, wait double"


class OrderedBucket(StatefulProcessor):
    """Requests wait in list state until the watermark has passed them, since an earlier one may still come. A timer at the
    earliest of them releases all that are due, in order of time and then of id, into the bucket's value state. Once nothing waits and the
    bucket would be full again, both are forgotten: a new caller starts with a full bucket too.

    What is held is a caller's requests within the watermark's delay."""

    def __init__(self, burst: float, per_second: float):
        self.burst, self.per_second = float(burst), float(per_second)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "t bigint, id bigint")
        self.bucket = handle.getValueState("bucket", "tokens double, at bigint, timer bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for b in rows:
            t = pd.to_datetime(b["ts"]).astype("datetime64[us]").astype("int64")
            self.held.appendList(list(zip(t.tolist(), b["event_id"].tolist(), strict=True)))
        yield self._release(key[0], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._release(key[0], timerValues.getCurrentWatermarkInMs())

    def _release(self, user: int, watermark: int) -> pd.DataFrame:
        waiting = sorted(tuple(map(int, x)) for x in self.held.get()) if self.held.exists() else []
        tokens, at, timer = self.bucket.get() if self.bucket.exists() else (self.burst, None, None)
        due = [x for x in waiting if x[0] <= watermark * 1000]
        out = []
        for t, id_ in due:
            tokens, at = min(self.burst, tokens + max(0, t - (t if at is None else at)) / 1e6 * self.per_second), t
            admitted = tokens >= 1
            out.append((user, id_, pd.Timestamp(t, unit="us"), admitted, 0.0 if admitted else (1 - tokens) / self.per_second))
            tokens -= admitted
        rest = waiting[len(due) :]
        if due and rest:
            self.held.put(rest)
        elif due:
            self.held.clear()
        full = None if at is None else -(-at // 1000) + int((self.burst - tokens) / self.per_second * 1000) + 1
        wanted = -(-rest[0][0] // 1000) if rest else full
        if not rest and (full is None or full <= watermark):
            self.bucket.clear()
            wanted = None
        if timer != wanted:
            if timer is not None and timer > watermark:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        if wanted is not None:
            self.bucket.update((float(tokens), at, wanted))
        return pd.DataFrame(out, columns=["user_id", "event_id", "ts", "admitted", "wait"]) if out else pd.DataFrame()

    def close(self) -> None:
        pass


def token_bucket_stream(requests: DataFrame, burst: float, per_second: float, delay: str = DELAY) -> DataFrame:
    """``user_id, event_id, ts, admitted, wait`` of each request of a stream ``user_id, event_id, ts``, once the watermark has passed it: what
    the batch fold decides for the same requests, in whatever order they come within ``delay``."""
    watched = requests.select("user_id", "event_id", "ts").withWatermark("ts", delay).groupBy("user_id")
    return watched.transformWithStateInPandas(OrderedBucket(burst, per_second), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def bucket_totals(decisions: DataFrame) -> DataFrame:
    """``user_id, n_requests, n_admitted, longest_wait``, as the batch fold gives them."""
    return decisions.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_requests"), F.count_if("admitted").alias("n_admitted"), F.max("wait").alias("longest_wait"))
