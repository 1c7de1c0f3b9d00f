"""Work that has to grow no faster than the input: what leaves the tasks, and whom they work for."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rillmark.functions import expr, prefix
from rillmark.operators import events, indices, metrics, retrieval, scorers, sequences, towers, training
from rillmark.plans import learning, registry
from rillmark.sources import tables
from tests.compare import connection
from tests.test_operators import unit_vectors

FOLDER = "/root/testdata/sf0.001"


def test_exact_lists_leave_their_task_once(spark):
    """Nothing is shuffled behind the products: a block of users meets all items in one task."""
    users, items = (spark.createDataFrame(*unit_vectors(n, 8, seed, key)) for n, seed, key in ((40, 3, "user_id"), (90, 4, "item_id")))
    found = retrieval.exact_topk(users, items, 4, 7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("MapInPandas")]
    assert "Exchange" not in above and "Window" not in above
    assert found.count() == 160


def frames_of(users, vecs, items, ivecs, block):
    """A block of users with one block of items after another, as tasks of exact search get them."""
    for s in range(0, len(items), block):
        yield pd.DataFrame({"part": [0], "users": [users], "uvecs": [vecs.ravel()], "items": [items[s : s + block]], "ivecs": [ivecs[s : s + block].ravel()]})


def test_few_pairs_are_multiplied_twice(monkeypatch):
    """Single precision leaves out all but a few pairs; double precision decides between these, also where single precision can't tell items apart."""
    rng, again = np.random.default_rng(5), []
    users, items = rng.normal(size=(100, 16)), np.repeat(rng.normal(size=(5000, 16)), 2, axis=0)
    items *= 1 + 3e-9 * rng.integers(0, 3, len(items))[:, None]
    made = scorers.pair_products
    monkeypatch.setattr(scorers, "pair_products", lambda u, v, row, at: again.append(len(row)) or made(u, v, row, at))
    ids = rng.permutation(len(items))
    got = pd.concat(scorers.merged_topk(frames_of(np.arange(100), users, ids, items, 1000), 10, 30))
    scores = (users @ items.T).round(9)
    wanted = [ids[np.lexsort((ids, -s))[:10]].tolist() for s in scores]
    assert got.sort_values(["user_id", "rank"])["item_id"].to_numpy().reshape(100, 10).tolist() == wanted
    assert sum(again) < 0.05 * scores.size


def test_vectors_beyond_single_precision(monkeypatch):
    """Lengths that single precision can't hold, or products of them, are multiplied in double precision only."""
    rng = np.random.default_rng(6)
    for scale in (1e-30, 1e15, 1e30):
        users, items = rng.normal(size=(7, 4)) * 1e12, rng.normal(size=(300, 4)) * scale
        got = pd.concat(scorers.merged_topk(frames_of(np.arange(7), users, np.arange(300), items, 64), 5))
        exact = np.array([[-s.round(9)[i] for i in np.lexsort((np.arange(300), -s.round(9)))[:5]] for s in users @ items.T])
        assert np.allclose(-got["score"].to_numpy().reshape(7, 5), exact, rtol=1e-9)


def test_lists_of_a_user_are_sorted_without_comparisons_in_lambdas(spark):
    rows = spark.createDataFrame([(1, 5, 3), (1, 6, 9), (1, 7, 4), (2, 8, 1)], "user_id long, item_id long, ts int")
    found = sequences.user_history(rows, ["ts"], 2)
    assert {r["user_id"]: r["history"] for r in found.collect()} == {1: [7, 6], 2: [8]}
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_directions_are_made_without_lists(spark, monkeypatch):
    """What pooling a user's list gives, from its rows; large catalogues take another join."""
    items = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [-1.0, 0.0])], "item_id long, vec array<double>")
    rows = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 9, 3), (1, 1, 4), (2, 9, 1), (3, 0, 1), (3, 2, 2)], "user_id long, item_id long, ts int")
    wanted = {r["user_id"]: np.round(r["vec"], 9).tolist() for r in sequences.unit_pooled(sequences.user_history(rows, ["ts"]), items).collect()}
    for bytes_ in (64 << 20, 0):
        monkeypatch.setattr(sequences, "BROADCAST_BYTES", bytes_)
        found = sequences.unit_directions(sequences.newest_rows(rows, ["ts"]), items)
        assert {r["user_id"]: np.round(r["vec"], 9).tolist() for r in found.collect()} == wanted and set(wanted) == {1, 3}
        assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("index", ["ivf", "lsh"])
def test_index_lists_leave_their_task_once(spark, index, monkeypatch):
    """A block of users meets all items in one task, so no user's vector goes to each cell; slabs and blocks of any size give the same lists."""
    users, items = (spark.createDataFrame(*unit_vectors(n, 8, seed, key)).persist() for n, seed, key in ((40, 3, "user_id"), (90, 4, "item_id")))
    built = indices.build_product_index(items, cells=4, parts=4, words=8)
    ask = (lambda: indices.ivf_topk(users, items, 4, nprobe=3, short=9, index=built)) if index == "ivf" else (lambda: indices.lsh_topk(users, items, 4, 8, 6))
    found = ask()
    plan = found._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("MapInPandas")]
    assert "Exchange" not in above and "Window" not in above and "Join" not in above
    key = lambda df: sorted((r["user_id"], r["rank"], r["item_id"], round(r["score"], 9)) for r in df.collect())
    once = key(found)
    for items_, bytes_ in ((7, 64 << 20), (30, 1)):
        monkeypatch.setattr(indices, "ITEMS", items_)
        monkeypatch.setattr(indices, "BLOCK", 11)
        monkeypatch.setattr(retrieval, "BROADCAST_BYTES", bytes_)
        assert key(ask()) == once


def test_short_lists_alone_are_multiplied(spark, monkeypatch):
    """However many blocks the items come in, a user's whole products are those of the short list."""
    monkeypatch.setattr(indices, "ITEMS", 20)
    users, items = (spark.createDataFrame(*unit_vectors(n, 8, seed, key)).persist() for n, seed, key in ((40, 3, "user_id"), (200, 4, "item_id")))
    built = indices.build_product_index(items, cells=4, parts=4, words=8)
    for nprobe in (1, 4):
        assert indices.ivf_lists(users, built, 4, nprobe, 9).agg(F.sum("n_scored")).first()[0] == 40 * 9


def test_sweep_is_one_pass(spark, monkeypatch):
    """Exact search and all indices share their blocks where items are one slab; slabs give the same recall, and no list is written in one pass."""
    users, items = (spark.createDataFrame(*unit_vectors(n, 8, seed, key)).persist() for n, seed, key in ((40, 3, "user_id"), (300, 4, "item_id")))
    built, ivf, lsh, written, keep = indices.build_product_index(items, cells=4, parts=4, words=8), [(1, 9), (3, 5), (3, 9)], [(2, 2), (6, 3)], [], indices.materialize
    monkeypatch.setattr(indices, "materialize", lambda df, name: written.append(name) or keep(df, name))
    monkeypatch.setattr(indices, "ITEMS", 70)
    monkeypatch.setattr(indices, "CHUNK", 16)
    found = []
    for bytes_ in (64 << 20, 1):
        monkeypatch.setattr(retrieval, "BROADCAST_BYTES", bytes_)
        found.append({r["at"]: (round(r["recall"], 9), r["n_scored"]) for r in indices.recall_sweep(users, items, built, 4, 8, ivf, lsh).collect()})
        if len(found) == 1:
            assert written == ["placed"]
    assert [found[0][i][0] for i in range(5)] == [found[1][i][0] for i in range(5)]
    assert [found[0][i][1] for i in range(3)] == [360, 200, 360] and [found[0][i][1] for i in (3, 4)] == [found[1][i][1] for i in (3, 4)]


@pytest.mark.parametrize("joined", [1, 2])
def test_meetings_as_bits(joined):
    """Bits and comparisons of hashes name the same pairs, and lists are the same either way."""
    rng, hashed = np.random.default_rng(4), indices.fit_polytopes(8, 5, joined)
    u, v = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (rng.normal(size=(30, 8)), rng.normal(size=(150, 8))))
    own, asked = hashed.hashes(v), hashed.probes(u, 3)
    meets = (asked[:, None] == own[None, :, :, None]).any((2, 3))
    met = indices._with_hashes(np.arange(150), v, pd.DataFrame({"hashes": [list(own)]}).iloc[0])
    bits = np.unpackbits(indices._meets(asked, met).view(np.uint8), axis=1, count=150, bitorder="little").astype(bool)
    assert (bits == meets).all()
    frame = lambda: iter([pd.DataFrame({"part": [0], "users": [np.arange(30)], "uvecs": [u.ravel()], "items": [np.arange(s, s + 50)], "ivecs": [v[s : s + 50].ravel()], "hashes": [list(own[s : s + 50])]}) for s in (0, 50, 100)])
    both = [pd.concat(indices._under_hashes(frame(), hashed, 3, 6, counted)) for counted in (True, False)]
    assert both[0]["n_scored"].sum() == meets.sum() and both[1]["n_scored"].sum() == 0
    assert both[0].drop(columns="n_scored").equals(both[1].drop(columns="n_scored"))
    scores = np.where(meets, u @ v.T, -np.inf)
    wanted = [i for r in range(30) for i in np.argsort(-scores[r])[: min(6, meets[r].sum())].tolist()]
    assert both[0]["item_id"].tolist() == wanted


@pytest.mark.parametrize("name", ["heldout_hits", "recall_full_matrix", "full_catalogue_recall", "recall_from_topk", "retrieval_ablation"])
def test_lists_are_made_for_users_with_a_target(spark, name, monkeypatch):
    """Every list that the metric doesn't read is left out; the metric stays as it was."""
    three, exact, met = learning._targets, retrieval.exact_topk, []
    monkeypatch.setattr(learning, "_targets", lambda s, d: three(s, d).orderBy("user_id", "target").limit(3))

    def watched(users, items, k, *rest):
        met.append({r["user_id"] for r in users.select("user_id").collect()})
        return exact(users, items, k, *rest)

    monkeypatch.setattr(retrieval, "exact_topk", watched)
    rows = registry.queries()[name](spark, FOLDER).collect()
    wanted = {r["user_id"] for r in learning._targets(spark, FOLDER).collect()}
    assert met and all(m <= wanted for m in met) and all(r["n_targets"] == 3 for r in rows)


@pytest.mark.parametrize("name", ["heldout_hits", "retrieval_ablation"])
def test_every_clicked_test_row_is_a_target(spark, name):
    """No sample stands for the clicks: sf0.01 has more than the 500 that other queries draw."""
    folder = FOLDER.replace("0.001", "0.01")
    clicked = tables.interactions(spark, folder).where("split = 'test' AND label = 1").count()
    assert clicked > 500 and {r["n_targets"] for r in registry.queries()[name](spark, folder).collect()} == {clicked}


def test_further_draws_only_where_the_first_is_seen(spark, monkeypatch):
    """One draw a positive and stratum is looked up, not all of them."""
    written, keep = {}, training.materialize

    def counted(df, name):
        kept = keep(df, name)
        written[name] = kept.count()
        return kept

    monkeypatch.setattr(training, "materialize", counted)
    counts = spark.range(500).select(F.col("id").alias("item_id"), (1000 - F.col("id")).alias("n"))
    seen = spark.range(40).select((F.col("id") % 4).alias("user_id"), (F.col("id") * 12).alias("item_id"))
    got = training.stratified_negatives(seen, counts, seen).collect()
    assert len(got) == 40 * 5 == written["draws"] and written["asked"] < 20


def test_one_frame_a_batch_of_user_streams():
    """However many users a batch holds, their candidates leave it in one frame; a history lasts over batches."""
    rows = [(u, 0, p, 10 * u + p, [1.0, float(u)] if u else None, 1.0 if u else None) for u in range(50) for p in (0, scorers.CANDIDATE)]
    frame = pd.DataFrame(rows, columns=["user_id", "salt", "place", "item_id", "vec", "length"])
    emit = lambda cand, vecs, history: {"score": (vecs @ history["matrix"].T).sum(1)}
    got = list(scorers._scored_streams(iter([frame[:51], frame[51:]]), emit))
    assert len(got) == 2
    assert pd.concat(got)["score"].tolist() == [0.0, *[1.0 + u * u for u in range(1, 50)]]


def test_streams_shuffle_keys_and_not_vectors(spark, monkeypatch):
    """Small catalogues meet the sorted stream, large ones go through the shuffle; the scores are the same."""
    items = spark.createDataFrame(*unit_vectors(60, 8, 4, "item_id"))
    rows = spark.range(400).select((F.col("id") % 20).alias("user_id"), (F.col("id") * 7 % 70).alias("item_id")).distinct()
    past = spark.range(1, 20).select(F.col("id").alias("user_id"), F.array(F.col("id"), F.col("id") + 9, F.col("id") + 48).alias("history"))
    found, key = [], lambda df: sorted((r["user_id"], r["item_id"], round(r["score"], 9)) for r in df.collect())
    monkeypatch.setattr(scorers, "MANY", 6)
    for bytes_ in (64 << 20, 0):
        monkeypatch.setattr(scorers, "BROADCAST_BYTES", bytes_, raising=False)
        got = scorers.score_content_knn(rows, past, items)
        found.append((key(got), got._jdf.queryExecution().optimizedPlan().toString()))
    assert found[0][0] == found[1][0] and len(found[0][0]) == rows.count()
    plan = found[0][1]
    assert plan.index("LeftOuter") < plan.index("Sort [") < plan.index("RepartitionByExpression") and "vec" not in plan[plan.index("Sort [") : plan.index("RepartitionByExpression")]
    streams = plan[plan.index("RepartitionByExpression") :]
    assert "AS vec" not in streams[: streams.index("Union")]


@pytest.mark.parametrize("name", ["masked_mean_pool", "padded_mean_pool", "target_attention"])
def test_sql_rounds_to_plain_zeros(name):
    """Spark's rounding has no negative zero; the SQL states the same."""
    signed = f"SELECT count(*) FROM ({registry.oracle_sql()[name]}) WHERE list_contains(list_transform(vec, lambda x: x = 0 AND x::VARCHAR LIKE '-%'), true)"
    assert connection("/root/testdata/sf0.1").sql(signed).fetchall() == [(0,)]


def test_products_with_known_items_only():
    """Unknown history items are counted, never multiplied; scores are those of zero vectors in their places."""
    rng = np.random.default_rng(3)
    known, vecs, length = np.array([True, False, True, False]), rng.normal(size=(5, 8)), np.array([2.0, 0.0, 0.5, 0.0])
    matrix = rng.normal(size=(4, 8)) * known[:, None]
    got = scorers._likeness({}, vecs, {"known": known, "length": length, "matrix": np.where(known[:, None], matrix, np.nan)})
    sims, pooled = vecs @ matrix.T, length @ matrix
    w = np.exp(sims[:, known] * np.sqrt(8))
    wanted = {"content_knn": sims.max(1), "content_knn_mean": sims.mean(1), "pooled_cosine": vecs @ pooled / np.linalg.norm(pooled), "attention": (w * sims[:, known]).sum(1) / w.sum(1)}
    assert set(got) == set(wanted) and all(np.allclose(got[c], wanted[c]) for c in wanted)


def test_a_length_is_worked_out_once_a_vector(spark):
    """Dividing by the length costs the dimension, not its square: no element's lambda goes through the whole vector again."""
    vectors = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [])], "id long, vec array<double>")
    found = vectors.select("id", expr.l2_normalise(F.col("vec")).alias("vec"))
    assert {r["id"]: r["vec"] for r in found.collect()} == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: None, 4: []}
    assert "/ sqrt(" not in found._jdf.queryExecution().optimizedPlan().toString().lower()


@pytest.mark.parametrize("rows", [scorers.BROADCAST_ROWS, 0])
def test_unknown_history_is_one_row(spark, rows, monkeypatch):
    """Items without a vector are counted before the stream is shuffled; both scores stay those of zero vectors in their places."""
    monkeypatch.setattr(scorers, "BROADCAST_ROWS", rows)
    items = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(3)], "item_id long, vec array<double>")
    past = spark.createDataFrame([(1, [0, 1, 0, *range(100, 150)]), (2, list(range(100, 120))), (3, [2, 1])], "user_id long, history array<long>")
    asked = spark.createDataFrame([(u, i) for u in (1, 2, 3, 4) for i in (2, 500)], "user_id long, item_id long")
    stream = scorers._user_streams(asked, past, items, 200).where(F.col("place") < scorers.CANDIDATE)
    assert sorted((r["user_id"], r["times"]) for r in stream.collect()) == [(1, 1), (1, 1), (1, 1), (1, 50), (2, 20), (3, 1), (3, 1)]
    c0, c1 = 1 / np.sqrt(5), 3 / np.sqrt(10)
    wanted = {"max": {(1, 2): c1, (1, 500): 0, (2, 2): 0, (2, 500): 0, (3, 2): 1, (3, 500): 0}, "mean": {(1, 2): (2 * c0 + c1) / 53, (1, 500): 0, (2, 2): 0, (2, 500): 0, (3, 2): (1 + c1) / 2, (3, 500): 0}}
    for how, scores in wanted.items():
        got = {(r["user_id"], r["item_id"]): r["score"] for r in scorers.score_content_knn(asked, past, items, how=how).collect()}
        assert got.pop((4, 2)) == got.pop((4, 500)) == scorers.NO_HISTORY
        assert got.keys() == scores.keys() and all(abs(got[k] - v) < 1e-12 for k, v in scores.items())


def test_messages_are_parsed_once(spark):
    """One parse gives the reason and all fields; whoever reads the checked messages several times reads them written."""
    raw = spark.createDataFrame([('{"user_id":1,"item_id":2,"event_type":"click","event_id":"e"}',), ("null",), ("}",)], "raw string")
    plan = events.validate(raw)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1
    counted = registry.queries()["ingest_counts"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "json" not in counted


def test_pairs_of_towers_are_shuffled_once_an_epoch(spark, monkeypatch):
    """Vectors go from the written pairs to the tasks that learn by one exchange, without a join, in single precision."""
    kind = type(spark.range(1))
    plans, step = [], kind.mapInPandas

    def watched(df, *rest):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return step(df, *rest)

    monkeypatch.setattr(kind, "mapInPandas", watched)
    rows = [(i, i % 7, [1.0, float(i)], [float(i % 7), 1.0], -1.0) for i in range(40)]
    towers.fit_towers(spark.createDataFrame(rows, "user_id long, item_id long, u array<double>, v array<double>, log_q double"), epochs=2, batch=8, tasks=3)
    assert len(plans) == 2
    for plan in plans:
        assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1 and "array<float>" in plan


def test_pairs_of_towers_leave_their_own_item_out(spark):
    """A user's direction is that of their other known items, zero if there are none; users without any have no pairs."""
    items = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [3.0, 4.0])], "item_id long, vec array<double>")
    past = spark.createDataFrame([(1, [0, 1, 0, 9]), (2, [2, 2, 2]), (3, [9])], "user_id long, history array<long>")
    asked = spark.createDataFrame([(1, 0, -1.0), (1, 1, -2.0), (1, 2, -3.0), (2, 2, -3.0), (3, 0, -1.0), (4, 0, -1.0)], "user_id long, item_id long, log_q double")
    got = {(r["user_id"], r["item_id"]): (r["log_q"], *np.round(r["u"], 5).tolist(), *np.round(r["v"], 5).tolist()) for r in scorers.leave_one_out_means(asked, past, items).collect()}
    c, s = 2 / np.sqrt(5), 1 / np.sqrt(5)
    wanted = {(1, 0): (-1.0, 0, 1, 1, 0), (1, 1): (-2.0, 1, 0, 0, 1), (1, 2): (-3.0, c, s, 0.6, 0.8), (2, 2): (-3.0, 0, 0, 0.6, 0.8)}
    assert got.keys() == wanted.keys() and all(np.allclose(got[k], wanted[k], atol=1e-4) for k in wanted)


def test_features_are_not_joined_to_their_rows(spark, monkeypatch):
    """Interactions are joined from the tables once, histories once more; counts come along with the rows through the stream."""
    read, load = [], tables.load
    monkeypatch.setattr(tables, "load", lambda s, d, name, *columns: read.append(name) or load(s, d, name, *columns))
    plan = registry.queries()["ranking_features"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert read.count("lineitem") == 2
    above = plan[: plan.index("MapInPandas")]
    assert above.count("Join") == 1  # what is known of the user


def test_ranker_writes_no_keys_of_train_rows(spark, monkeypatch):
    written, keep = {}, learning.materialize
    monkeypatch.setattr(learning, "materialize", lambda df, name: written.setdefault(name, keep(df, name)))
    registry.queries()["pointwise_ranker"](spark, FOLDER)
    kept = written["features"]
    assert "nation" not in kept.columns and kept.where("split = 'train' AND (user_id IS NOT NULL OR item_id IS NOT NULL)").count() == 0


def test_scores_are_shuffled_by_user_as_one_row(spark):
    """Metrics by user shuffle a row a candidate, not one a model; they are those of the long table."""
    wide = spark.range(60).select((F.col("id") % 7).alias("user_id"), F.col("id").alias("item_id"), (F.col("id") % 3 == 0).cast("int").alias("label"), F.sin("id").alias("a"), F.cos("id").alias("b"))
    long = scorers.long_scores(wide, ("a", "b"))
    by_user = scorers.long_scores(wide.repartition("user_id"), ("a", "b"))
    plan = metrics._users(by_user, (1, 3))._jdf.queryExecution().executedPlan().toString()
    assert plan[: plan.index("Generate")].count("Exchange") == 1  # the last, by model
    key = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert key(metrics.evaluate_table(long, by_user=by_user)) == key(metrics.evaluate_table(long))


def test_seen_items_without_a_vector_are_left_out(spark):
    """They can't be recommended, so they aren't shuffled to be held against what was found."""
    users, items = (spark.createDataFrame(*unit_vectors(n, 8, seed, key)) for n, seed, key in ((5, 3, "user_id"), (90, 4, "item_id")))
    seen = spark.createDataFrame([(u, i) for u in range(5) for i in (*range(40), 7, *range(500, 700))], "user_id long, item_id long")
    found = retrieval.recommend(users, items, seen, 4)
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
    rows = found.collect()
    assert len(rows) == 20 and all(r["item_id"] >= 40 for r in rows)


def test_report_reads_the_lines_twice(spark, monkeypatch):
    """Sections share interactions, clicks and lengths of histories: tables aren't joined anew for each; outside the report nothing is shared."""
    read, load = [], tables.load
    monkeypatch.setattr(tables, "load", lambda s, d, name, *columns: read.append(name) or load(s, d, name, *columns))
    registry.queries()["profile_report"](spark, FOLDER)
    assert read.count("lineitem") == 2
    assert tables._shared is None and tables.interactions(spark, FOLDER) is not tables.interactions(spark, FOLDER)


def test_buckets_of_prefix_sums_are_searched(spark):
    """A row's bucket is found by a binary search, not by holding the row against all bounds; missing values come first, as they are sorted."""
    rows = [(i, float(v) if v is not None else None) for i, v in enumerate([5, None, 3, 3, float("inf"), -2, 8, None, float("nan"), float("-inf"), *range(10, 60)])]
    found = prefix.dense_rank_index(spark.createDataFrame(rows, "id long, x double"), "x", [F.col("id")])
    assert "filter(" not in found._jdf.queryExecution().analyzed().toString().lower()
    place = lambda v: (-1, 0.0) if v is None else (2, 0.0) if v != v else (1, v)
    assert [r["id"] for r in sorted(found.collect(), key=lambda r: r["idx"])] == [i for i, _ in sorted(rows, key=lambda r: (*place(r[1]), r[0]))]
