"""The stream operators over file sources, restarted and replayed."""

from __future__ import annotations

import json
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rillmark.operators import events as E
from rillmark.operators import sequences
from rillmark.streaming import ingest, ledger, limits, replay

T0 = datetime(2024, 1, 1)
SCHEMA = "user_id long, item_id long, event_id string, ts timestamp"


def put(spark, folder, rows, name):
    spark.createDataFrame([(u, i, e, T0 + timedelta(seconds=t)) for u, i, e, t in rows], SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")


def run(spark, source, build, out, checkpoint, mode="append", schema=SCHEMA, states=None):
    stream = build(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(source))
    mode = "update" if "session" in stream.columns else mode

    def each(batch, _):
        batch.write.mode("append").parquet(out)

    query = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if states is not None:
        states.append(sum(o["numRowsTotal"] for o in query.lastProgress["stateOperators"]))
    return spark.read.parquet(out)


def test_dedup_survives_restart_and_equals_the_batch_twin(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    first = [(1, 10, "a", 0), (2, 20, None, 1), (2, 20, None, 1), (1, 11, "b", 2)]
    again = [(5, 10, "a", 100), (1, 12, "c", 101), (1, 13, "a", 4000)]
    put(spark, src, first, "1")
    assert run(spark, src, ingest.dedup_stream, out, check).count() == 4
    put(spark, src, again, "2")
    got = run(spark, src, ingest.dedup_stream, out, check)
    assert sorted(r["item_id"] for r in got.collect()) == [10, 11, 12, 13, 20, 20]
    log = spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(src).withColumn("arrival", F.unix_seconds("ts"))
    twin = E.dedup(log.where("event_id is not null"), ingest.TTL_SECONDS).where("accepted")
    assert sorted(r["item_id"] for r in twin.collect()) == [10, 11, 12, 13]


def test_sessions_keep_state_over_batches(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    put(spark, src, [(7, 100, "a", 0), (7, 101, "b", 1), (8, 5, "c", 1)], "1")
    run(spark, src, ingest.session_stream, out, check)
    put(spark, src, [(7, 102, "d", 2), (8, 6, "e", 9000)], "2")
    got = run(spark, src, ingest.session_stream, out, check)
    last = {r["user_id"]: r["s"] for r in got.groupBy("user_id").agg(F.max_by("session", "updated").alias("s")).collect()}
    assert last == {7: [102, 101, 100], 8: [6]}


@pytest.mark.parametrize("build", [ingest.dedup_stream, ingest.session_stream])
def test_old_keys_leave_the_state_after_a_restart(spark, tmp_path, build):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    states: list = []
    put(spark, src, [(u, u, f"e{u}", u) for u in range(50)], "1")
    run(spark, src, build, out, check, states=states)
    put(spark, src, [(99, 1, "late", 20_000)], "2")
    run(spark, src, build, out, check, states=states)
    put(spark, src, [(99, 2, "later", 20_001)], "3")
    run(spark, src, build, out, check, states=states)
    assert states[0] >= 50 and states[-1] < 10


def test_sessions_end_at_a_pause_and_keep_the_newest(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    put(spark, src, [(1, i, f"a{i}", i) for i in range(65)] + [(2, 5, "x", 0), (2, 6, "y", 4000), (2, 7, "z", 4001)], "1")
    got = {r["user_id"]: r["session"] for r in run(spark, src, ingest.session_stream, out, check).collect()}
    assert got == {1: list(range(64, 14, -1)), 2: [7, 6]}


def test_windows_of_a_stream_equal_the_batch_twin(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "event_type string, value double, ts timestamp, user_id long"
    make = lambda rows: spark.createDataFrame([("v", float(n), T0 + timedelta(minutes=m), n % 3) for n, m in enumerate(rows)], schema)
    make(range(0, 600, 7)).coalesce(1).write.parquet(f"{src}/1")
    run(spark, src, lambda s: ingest.window_stream(s, "1 hour"), out, check, schema=schema)
    make([900, 5]).coalesce(1).write.parquet(f"{src}/2")  # the second is behind the watermark: its window has been given out
    got = run(spark, src, lambda s: ingest.window_stream(s, "1 hour"), out, check, schema=schema)
    twin = E.windows(spark.read.schema(schema).parquet(f"{src}/1"), "1 hour")
    key = lambda r: (r["start"], r["event_type"], r["n"], r["total"])
    assert sorted(map(key, got.collect())) == sorted(map(key, twin.collect()))
    out2, check2 = str(tmp_path / "out2"), str(tmp_path / "check2")
    sessions = run(spark, src, lambda s: ingest.session_window_stream(s, "2 hours"), out2, check2, schema=schema)
    assert sum(r["n"] for r in sessions.collect()) >= len(range(0, 600, 7))


def test_late_events_of_a_stream_equal_the_batch_twin(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "source string, ts timestamp, arrival long"
    rows = [("ab"[n % 2], T0 + timedelta(seconds=(n * 7919) % 5000), n) for n in range(400)]
    for i in range(2):
        spark.createDataFrame(rows[i * 200 : i * 200 + 200], schema).coalesce(1).write.parquet(f"{src}/{i}")
        got = run(spark, src, lambda s: ingest.late_stream(s, 600), out, check, "update", schema)
    last = {r["source"]: (r["n"], r["o"], r["l"]) for r in got.groupBy("source").agg(F.max("n").alias("n"), F.max("n_out_of_order").alias("o"), F.max("n_late").alias("l")).collect()}
    twin = E.late_events(spark.createDataFrame(rows, schema), 600, "arrival", "source")
    assert last == {r["source"]: (r["n"], r["n_out_of_order"], r["n_late"]) for r in twin.collect()}


def test_poison_goes_to_dead_letters(spark, tmp_path):
    lines = ['{"user_id":777,"item_id":555,"event_type":"click","event_id":"e-1"}', '{"user_id":777,"item_id":9,"event_type":"click"}']
    rows = [(x.encode(),) for x in lines] + [(b"\xff\xfe not json",)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "raw binary").write.parquet(src)
    good, bad = [], []
    each = ingest.route(lambda df: good.extend(df.collect()), lambda df: bad.extend(df.collect()))
    stream = ingest.observed_counts(ingest.parsed_stream(spark.readStream.schema("raw binary").parquet(src)))
    stream.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["item_id"] for r in good) == [9, 555]
    assert [(r["reason"], bytes(r["raw"])) for r in bad] == [("decode", b"\xff\xfe not json")]


def test_failing_sink_ends_in_dead_letters(spark):
    tries, letters = [], []

    def fail(df, batch_id):
        tries.append(batch_id)
        raise RuntimeError("store is down")

    ingest.write_with_retry(fail, lambda df: letters.extend(df.collect()), 3)(spark.range(2), 5)
    assert tries == [5, 5, 5]
    assert [(r["reason"], r["error"]) for r in letters] == [("store", "store is down")] * 2


def test_recommendations_for_touched_users(spark):
    out = []
    each = ingest.recommend_touched(lambda df: df.select("user_id", F.get("session", 0).alias("item_id")), lambda df, n: out.extend(map(tuple, df.collect())))
    each(spark.createDataFrame([(1, [3, 2], T0), (1, [4, 3, 2], T0 + timedelta(seconds=1))], "user_id long, session array<long>, updated timestamp"), 0)
    assert out == [(1, 4)]


def test_replay_keeps_order_of_time(spark, tmp_path):
    df = spark.range(100).select("id", F.timestamp_seconds(100 - F.col("id")).alias("ts"))
    ingest.replay(df, str(tmp_path / "r"), 5)
    files = sorted((tmp_path / "r").glob("*.json"))
    spans = [spark.read.json(str(f)).agg(F.min("ts"), F.max("ts")).first() for f in files]
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_token_bucket_of_a_stream_out_of_order_and_restarted(spark, tmp_path):
    """Requests come out of order in three runs; what comes out is what the batch fold decides for them in order."""
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "user_id long, event_id long, ts timestamp"
    rng = random.Random(3)
    rows = [(n % 5, n, T0 + timedelta(seconds=n * 3 + rng.random(), microseconds=rng.randrange(999))) for n in range(600)]
    rows += [(n % 5, 1000 + n, T0 + timedelta(seconds=n * 30)) for n in range(60)]  # equal times
    arrival = sorted(rows, key=lambda r: (r[2] + timedelta(seconds=rng.randrange(500)), r[1]))
    states: list = []
    for i in range(3):
        part = arrival[i * 220 : i * 220 + 220]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{src}/{i}")
        run(spark, src, lambda s: limits.token_bucket_stream(s, 4, 0.03, "10 minutes"), out, check, schema=schema, states=states)
    spark.createDataFrame([(99, 1, T0 + timedelta(days=2))], schema).write.parquet(f"{src}/end")
    got = run(spark, src, lambda s: limits.token_bucket_stream(s, 4, 0.03, "10 minutes"), out, check, schema=schema, states=states)
    twin = {r["user_id"]: tuple(r)[1:] for r in E.token_bucket(spark.createDataFrame(rows, schema), 4, 0.03).collect()}
    totals = {r["user_id"]: tuple(r)[1:] for r in limits.bucket_totals(got).collect()}
    assert totals.keys() == twin.keys()
    for u, (n, ok, wait) in twin.items():
        assert totals[u][:2] == (n, ok) and abs(totals[u][2] - wait) < 1e-6
    assert sum(ok < n for n, ok, _ in twin.values()) == 5  # every bucket ran dry
    spark.createDataFrame([(99, 2, T0 + timedelta(days=3))], schema).write.parquet(f"{src}/end2")
    run(spark, src, lambda s: limits.token_bucket_stream(s, 4, 0.03, "10 minutes"), out, check, schema=schema, states=states)
    assert states[-1] < states[0]  # full buckets are forgotten


def test_counts_of_every_batch_over_restarts(spark, tmp_path):
    """A listener's table holds results and reasons of all batches once, also of a batch that failed and was repeated."""
    src, out, check, table = (str(tmp_path / x) for x in ("in", "out", "check", "table"))
    good = '{{"user_id":1,"item_id":2,"event_type":"click","event_id":"{}"}}'
    broken: list = [True]

    def build(raw):
        parsed = ingest.observed_counts(ingest.parsed_stream(raw.select("raw")).withColumn("ts", F.lit(T0).cast("timestamp")))
        kept = parsed.where("reason is null").select("user_id", "item_id", "event_id", "ts")
        return ingest.observed_accepted(ingest.dedup_stream(kept))

    def each(batch, batch_id):
        if batch_id == 1 and broken.pop() if broken else False:
            raise RuntimeError("killed")
        batch.write.mode("append").parquet(out)

    listener = ledger.ProgressTable(spark, table)
    spark.streams.addListener(listener)
    try:
        for i, lines in enumerate(([good.format("a"), good.format("b"), "no json", "[1]"], [good.format("a"), good.format("c"), "{}", "{}", "\\"], [good.format("d")])):
            spark.createDataFrame([(x.encode(),) for x in lines], "raw binary").coalesce(1).write.parquet(f"{src}/{i}")
            stream = build(spark.readStream.schema("raw binary").option("recursiveFileLookup", "true").parquet(src))
            for _ in range(2):
                query = stream.writeStream.foreachBatch(each).option("checkpointLocation", check).trigger(availableNow=True).start()
                try:
                    query.awaitTermination()
                    break
                except Exception as e:  # noqa: BLE001 - the batch that is killed once
                    assert "killed" in str(e)
        deadline = time.time() + 30
        want = {("ingest", "received"): 10, ("ingest", "valid"): 5, ("ingest", "rejected"): 5, ("ingest", "decode"): 2, ("ingest", "schema"): 3, ("ingest", "store"): 0, ("accepted", "accepted"): 4}
        got: dict = {}
        while got != want and time.time() < deadline:  # listeners are called later
            time.sleep(0.5)
            got = {(r["metric"], r["name"]): r["n"] for r in ledger.progress_totals(ledger.progress(spark, table)).collect()}
        assert got == want
    finally:
        spark.streams.removeListener(listener)


def test_counts_by_window_equal_the_batch_twin(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "ts timestamp, reason string, accepted boolean"
    rows = [(T0 + timedelta(hours=n), [None, "decode", "schema", "store", None][n % 5], n % 2 == 0) for n in range(90)]
    spark.createDataFrame([*rows, (T0 + timedelta(days=30), None, True)], schema).coalesce(1).write.parquet(f"{src}/1")
    got = run(spark, src, ingest.ingest_count_stream, out, check, schema=schema).collect()
    twin = E.ingest_counts(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["start"], r["result"], str(r["reason"]), r["n"]) for r in got) == sorted((r["day"], r["result"], str(r["reason"]), r["n"]) for r in twin)
    assert {r["result"] for r in twin} == {"accepted", "duplicate", "rejected", "failed"}


def test_sessions_are_written_exactly_once(spark, tmp_path):
    """Replayed rows, a sink killed between its rows and its ledger, a restart: the stored state equals the batch twin, row by row, and so
    does the last session that the sink has of each user."""
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    rng = random.Random(5)
    log = [(u, rng.randrange(100), f"e{n}", n * 7) for n, u in enumerate(rng.choices(range(12), k=400))]
    kill = {1}

    def done(batch_id):
        if batch_id in kill:
            kill.remove(batch_id)
            raise RuntimeError("killed")

    for i in range(4):
        put(spark, src, log[i * 100 : i * 100 + 100] + (log[i * 100 - 30 : i * 100] if i else []), str(i))  # the last rows come again
        events = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(src)
        for _ in range(2):
            query = ingest.first_sessions(events).writeStream.outputMode("append").foreachBatch(ledger.write_once(out, done)).option("checkpointLocation", check).trigger(availableNow=True).start()
            try:
                query.awaitTermination()
                break
            except Exception as e:  # noqa: BLE001
                assert "killed" in str(e)
    assert not kill
    batch = spark.createDataFrame([(u, i, e, T0 + timedelta(seconds=t)) for u, i, e, t in log], SCHEMA)
    twin = sorted((r["user_id"], r["session"]) for r in sequences.session_snapshot(batch).collect())
    assert sorted((r["user_id"], r["session"]) for r in ledger.stored_sessions(spark, check).collect()) == twin
    rows = ledger.written(spark, out)
    last = rows.groupBy("user_id").agg(F.max_by("session", F.struct("updated", "batch")).alias("session"))
    assert sorted((r["user_id"], r["session"]) for r in last.collect()) == twin
    assert rows.groupBy("batch", "user_id").count().where("count > 1").count() == 0


def test_a_broken_batch_does_not_count(spark, tmp_path):
    out = str(tmp_path / "out")

    def fail(_):
        raise RuntimeError("killed")

    ledger.write_once(out)(spark.range(3), 0)
    with pytest.raises(RuntimeError):
        ledger.write_once(out, fail)(spark.range(5), 1)
    assert ledger.written(spark, out).count() == 3
    ledger.write_once(out)(spark.range(4), 1)
    ledger.write_once(out)(spark.range(9), 1)  # it is there already
    assert ledger.written(spark, out).count() == 7


def test_replay_at_two_speeds(spark, tmp_path):
    """Both give all rows with their own times, the slower one over a restart; no row comes before its time, and the log takes its span over the
    speed."""
    log = str(tmp_path / "log")
    rows = [(n, f"v{n}", T0 + timedelta(seconds=n * 2, microseconds=n)) for n in range(200)]
    spark.createDataFrame([*rows, (999, "no time", None)], "n long, v string, ts timestamp").repartitionByRange(4, "ts").write.parquet(log)
    for speed, restart in ((50.0, True), (200.0, False)):
        out, check, anchor = (str(tmp_path / f"{x}{speed}") for x in ("out", "check", "anchor/a"))
        seen: list = []

        def each(batch, batch_id, out=out, seen=seen):
            batch.write.mode("append").parquet(out)
            seen.append((time.time(), batch.agg(F.max("ts").alias("t")).first()["t"], batch.count()))

        start = lambda: replay.replay_stream(spark, log, "n long, v string, ts timestamp", speed, anchor).writeStream.foreachBatch(each).option("checkpointLocation", check).trigger(processingTime="200 milliseconds").start()  # noqa: B023, E731
        began = time.time()
        query = start()
        deadline = began + 90
        while sum(x[2] for x in seen) < 200 and time.time() < deadline:
            time.sleep(0.2)
            if restart and seen and sum(x[2] for x in seen) > 20:
                query.stop()
                query, restart = start(), False
        query.stop()
        assert sorted((r["n"], r["v"], r["ts"]) for r in spark.read.parquet(out).collect()) == rows
        begun = json.loads(open(anchor).read())["begun"]
        assert all(t is None or (t - T0).total_seconds() / speed <= at - begun + 0.05 for at, t, _ in seen)
        assert seen[-1][0] - begun >= 398 / speed
        assert len([x for x in seen if x[2]]) > 1
