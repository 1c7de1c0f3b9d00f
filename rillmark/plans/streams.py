"""Batch twins of the stream operators (L of the inventory), over the event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.operators import events as E
from rillmark.plans.base import query, rounded
from rillmark.scratch import materialize
from rillmark.sources import tables as T


def raw_events(s, d, *carry: str) -> DataFrame:
    """The log as raw JSON texts, with one row in two broken in one way or another."""
    id_, user, item, kind = (F.col(c).cast("string") for c in ("event_id", "user_id", "item_id", "event_type"))

    def event(u: Column, i: Column, t: Column) -> Column:
        return F.concat(F.lit('{"user_id":'), u, F.lit(',"item_id":'), i, F.lit(',"event_type":'), t, F.lit(',"event_id":"e'), id_, F.lit('"}'))

    quoted = F.concat(F.lit('"'), kind, F.lit('"'))
    m = F.col("event_id") % 20
    cases = [
        F.lit("not-json"), F.lit("[1]"), F.lit("null"), F.concat(F.lit('{"user_id":'), user, F.lit(',"event_type":"click"}')), event(F.concat(F.lit('"'), user, F.lit('"')), item, quoted),
        event(F.lit("true"), item, quoted), event(F.lit("1.0"), item, quoted), event(F.lit("null"), item, quoted), event(user, F.lit("1180591620717411303424"), quoted), event(user, item, F.lit("5")),
    ]
    raw = event(user, item, quoted)
    for i, c in enumerate(cases):
        raw = F.when(m == i, c).otherwise(raw)
    return T.clicks(s, d).select(F.col("event_id").alias("seq"), raw.alias("raw"), *carry)


_RAW = """cl AS (SELECT event_id, user_id, event_type, json_extract_string(props, '$.k')::BIGINT AS item_id FROM events),
raw AS (SELECT event_id AS seq, CASE event_id % 20 WHEN 0 THEN 'not-json' WHEN 1 THEN '[1]' WHEN 2 THEN 'null' WHEN 3 THEN '{"user_id":' || user_id || ',"event_type":"click"}'
  WHEN 4 THEN '{"user_id":"' || user_id || '"' || r WHEN 5 THEN '{"user_id":true' || r WHEN 6 THEN '{"user_id":1.0' || r WHEN 7 THEN '{"user_id":null' || r
  WHEN 8 THEN '{"user_id":' || user_id || ',"item_id":1180591620717411303424,"event_type":"' || event_type || '","event_id":"e' || event_id || '"}'
  WHEN 9 THEN '{"user_id":' || user_id || ',"item_id":' || item_id || ',"event_type":5,"event_id":"e' || event_id || '"}' ELSE '{"user_id":' || user_id || r END AS raw
  FROM (SELECT *, ',"item_id":' || item_id || ',"event_type":"' || event_type || '","event_id":"e' || event_id || '"}' AS r FROM cl)),
chk AS (SELECT seq, raw, CASE WHEN NOT json_valid(raw) THEN 'decode' WHEN coalesce(json_type(raw) = 'OBJECT' AND json_type(raw, '$.user_id') IN ('UBIGINT', 'BIGINT') AND json_type(raw, '$.item_id') IN ('UBIGINT', 'BIGINT')
  AND json_type(raw, '$.event_type') = 'VARCHAR', false) THEN NULL ELSE 'schema' END AS reason FROM raw)"""


@query("decode_events", f"WITH {_RAW} SELECT seq, coalesce(reason = 'decode', false) AS undecodable FROM chk")
def decode_events(s, d):
    return E.validate(raw_events(s, d)).select("seq", F.coalesce(F.col("reason") == "decode", F.lit(False)).alias("undecodable"))


@query("validate_events", f"""WITH {_RAW} SELECT seq, reason, CASE WHEN reason IS NULL THEN json_extract_string(raw, '$.user_id')::BIGINT END AS user_id, CASE WHEN reason IS NULL THEN json_extract_string(raw, '$.item_id')::BIGINT END AS item_id,
  CASE WHEN reason IS NULL THEN json_extract_string(raw, '$.event_type') END AS event_type, CASE WHEN reason IS NULL THEN json_extract_string(raw, '$.event_id') END AS event_id FROM chk""")
def validate_events(s, d):
    return E.validate(raw_events(s, d)).drop("raw")


@query("event_schema_check", f"WITH {_RAW} SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM chk GROUP BY 1")
def event_schema_check(s, d):
    return E.validate(raw_events(s, d)).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("route_dlq", f"WITH {_RAW} SELECT reason, 'refused: ' || reason AS error, raw FROM chk WHERE reason IS NOT NULL")
def route_dlq(s, d):
    from rillmark.streaming.ingest import dead_letters

    return dead_letters(E.validate(raw_events(s, d)))


@query("default_event_id", "SELECT event_id AS seq, coalesce(CASE WHEN event_id % 2 = 0 THEN event_id::VARCHAR END, concat_ws(':', user_id, json_extract_string(props, '$.k'), event_type, floor(epoch_us(ts) / 60000000)::BIGINT)) AS event_id FROM events")
def default_event_id(s, d):
    log = T.clicks(s, d).withColumn("seq", F.col("event_id")).withColumn("event_id", F.when(F.col("seq") % 2 == 0, F.col("seq")))
    return log.select("seq", E.default_event_id().alias("event_id"))


TTL = 86_400 * 3
_REPEATED = "e AS (SELECT event_id AS arrival, ts, CASE WHEN event_id % 7 > 0 THEN event_id % 500 END AS event_id, epoch_us(ts) AS t FROM events)"
_FOLD = f"""a AS (SELECT event_id, min(t) AS t FROM e WHERE event_id IS NOT NULL GROUP BY 1 UNION ALL SELECT e.event_id, min(e.t) FROM a JOIN e ON e.event_id = a.event_id AND e.t >= a.t + {TTL}000000 GROUP BY e.event_id, a.t),
  j AS (SELECT e.arrival, e.ts, e.event_id, e.event_id IS NULL OR (a.t IS NOT NULL AND row_number() OVER (PARTITION BY e.event_id, e.t ORDER BY e.arrival) = 1) AS accepted FROM e LEFT JOIN (SELECT DISTINCT * FROM a) a ON a.event_id = e.event_id AND a.t = e.t)"""
_DEDUP = f"WITH RECURSIVE {_REPEATED}, {_FOLD}"


def _deduped(s, d):
    log = T.clicks(s, d).select(F.col("event_id").alias("arrival"), "ts", F.when(F.col("event_id") % 7 > 0, F.col("event_id") % 500).alias("event_id"))
    return E.dedup(log, TTL)


@query("dedup_events", _DEDUP + " SELECT arrival, event_id, accepted FROM j")
def dedup_events(s, d):
    return _deduped(s, d).select("arrival", "event_id", "accepted")


@query("ingest_counts", f"""WITH RECURSIVE {_RAW}, m AS (SELECT event_id AS arrival, ts, coalesce(reason, CASE WHEN user_id % 50 = 3 THEN 'store' END) AS reason FROM events JOIN chk ON seq = event_id),
  e AS (SELECT arrival, ts, CASE WHEN arrival % 7 > 0 THEN arrival % 500 END AS event_id, epoch_us(ts) AS t FROM m WHERE reason IS NULL), {_FOLD}
  SELECT date_trunc('day', ts)::TIMESTAMP AS day, CASE WHEN reason IN ('decode', 'schema') THEN 'rejected' WHEN reason IS NOT NULL THEN 'failed' WHEN accepted THEN 'accepted' ELSE 'duplicate' END AS result, reason, count(*) AS n
  FROM (SELECT ts, reason, false AS accepted FROM m WHERE reason IS NOT NULL UNION ALL SELECT ts, NULL, accepted FROM j) GROUP BY 1, 2, 3""")
def ingest_counts(s, d):
    """Every message: what the decoder and the schema refuse, what a store without one shard of users can't keep, and of the rest what
    is new and what is a repeat."""
    checked = E.validate(raw_events(s, d, "ts", F.col("user_id").alias("owner"))).select("seq", "ts", F.coalesce("reason", F.when(F.col("owner") % 50 == 3, "store")).alias("reason"))
    checked = materialize(checked, "checked")  # parsed once: what is refused, what has an id and what has none are read apart
    kept = checked.where("reason is null").select(F.col("seq").alias("arrival"), "ts", "reason", F.when(F.col("seq") % 7 > 0, F.col("seq") % 500).alias("event_id"))
    judged = E.dedup(kept, TTL).select("ts", "reason", "accepted")
    return E.ingest_counts(judged.unionByName(checked.where("reason is not null").select("ts", "reason", F.lit(False).alias("accepted"))))


@query("tumbling_windows", """SELECT date_trunc('day', ts)::TIMESTAMP AS "start", date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3""")
def tumbling_windows(s, d):
    return rounded(E.windows(T.load(s, d, "events"), "1 day"), 4)


@query("sliding_windows", """SELECT w AS "start", w + INTERVAL 1 DAY AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total
  FROM (SELECT *, unnest([time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR * i FOR i IN range(4)]) AS w FROM events) GROUP BY 1, 2, 3""")
def sliding_windows(s, d):
    return rounded(E.windows(T.load(s, d, "events"), "1 day", "6 hours"), 4)


@query("session_windows", """WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 43200000000 THEN 0 ELSE 1 END AS f FROM events),
  n AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM g) SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 12 HOUR AS "end", count(*) AS n FROM n GROUP BY user_id, no""")
def session_windows(s, d):
    return E.session_windows(T.load(s, d, "events", "user_id", "ts"), "12 hours")


@query("late_events", """WITH a AS (SELECT user_id % 10 AS source, epoch_us(ts) - max(epoch_us(ts)) OVER (PARTITION BY user_id % 10 ORDER BY event_id + (event_id * 7919) % 400, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS d FROM events)
  SELECT source, count(*) AS n, count(*) FILTER (WHERE d < 0) AS n_out_of_order, count(*) FILTER (WHERE d < -21600000000) AS n_late FROM a GROUP BY 1""")
def late_events(s, d):
    log = T.load(s, d, "events", "event_id", "user_id", "ts")
    arrival = F.col("event_id") + (F.col("event_id") * 7919) % 400
    return E.late_events(log.select((F.col("user_id") % 10).alias("source"), "ts", "event_id", arrival.alias("arrival")), 21_600, "arrival", "source", "event_id")


@query("token_bucket", """WITH RECURSIVE q AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
  b AS (SELECT user_id, i, t, 4.0::DOUBLE - 1 AS tokens, 1::BIGINT AS ok, 0.0::DOUBLE AS wait FROM q WHERE i = 1 UNION ALL
  SELECT q.user_id, q.i, q.t, CASE WHEN now >= 1 THEN now - 1 ELSE now END, ok + (now >= 1)::BIGINT, CASE WHEN now >= 1 THEN wait ELSE greatest(wait, (1 - now) / 1e-5::DOUBLE) END
  FROM (SELECT q.*, b.ok, b.wait, least(4.0::DOUBLE, b.tokens + greatest(0, q.t - b.t) / 1e6::DOUBLE * 1e-5::DOUBLE) AS now FROM b JOIN q ON q.user_id = b.user_id AND q.i = b.i + 1) q)
  SELECT user_id, max(i) AS n_requests, max(ok) AS n_admitted, round(max(wait), 3) AS longest_wait FROM b GROUP BY 1""")
def token_bucket(s, d):
    return rounded(E.token_bucket(T.load(s, d, "events", "user_id", "ts", "event_id"), 4, 1e-5), 3)


@query("publish_order", """WITH l AS (SELECT user_id, event_id < lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id + (event_id * 37) % 1100, event_id) AS bad FROM events)
  SELECT count(DISTINCT user_id) AS n_keys, count(*) AS n_events, count(*) FILTER (WHERE bad) AS n_inversions FROM l""")
def publish_order(s, d):
    log = T.load(s, d, "events", "event_id", "user_id")
    place = F.struct((F.col("event_id") + (F.col("event_id") * 37) % 1100).alias("a"), F.col("event_id").alias("b"))
    return E.publish_order(log.withColumn("position", place), "user_id", "event_id", "position")


@query("event_sink", """SELECT user_id::VARCHAR AS key, '{"user_id":' || user_id || ',"item_id":' || json_extract_string(props, '$.k') || ',"event_type":"' || event_type || '"}' AS value FROM events""")
def event_sink(s, d):
    from rillmark.sources.io import keyed_json

    return keyed_json(T.clicks(s, d).select("user_id", "item_id", "event_type"))
