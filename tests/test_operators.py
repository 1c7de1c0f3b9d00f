"""Small cases with known results."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillmark.functions import expr
from rillmark.functions.prefix import dense_rank_index, prefix_sum
from rillmark.operators import events, indices, joins, metrics, profile, retrieval, scorers, sequences, sketches, towers, training, vectors, vocab
from rillmark.plans import learning
from rillmark.sources import io

T0 = datetime(2024, 1, 1)


def one(df):
    return df.first().asDict()


def scored(spark, rows):
    return spark.createDataFrame(rows, "user_id long, item_id long, label int, score double")


def test_ranking_macro_average(spark):
    rows = [(0, i, y, float(9 - i)) for i, y in enumerate((1, 0, 0, 0, 0))] + [(1, i, y, float(10 - i)) for i, y in enumerate((0, 0, 0, 1, 0))]
    got = one(metrics.per_user_ranking(scored(spark, rows)))
    assert (got["hr_1"], got["hr_5"], got["mrr"], got["n_users"]) == (0.5, 1.0, 0.625, 2)


def test_ranking_perfect(spark):
    got = one(metrics.per_user_ranking(scored(spark, [(0, i, y, float(4 - i)) for i, y in enumerate((1, 1, 0, 0))])))
    assert got["ndcg_1"] == got["ndcg_3"] == 1


def test_ties_are_fair(spark):
    rows = [(u, i, int(i == 0), 0.0) for u in range(3000) for i in range(3)]
    assert abs(one(metrics.per_user_ranking(scored(spark, rows)))["hr_1"] - 1 / 3) < 0.03


def test_users_without_positive_are_left_out(spark):
    rows = [(0, 0, 1, 2.0), (0, 1, 0, 1.0), (1, 0, 0, 2.0), (1, 1, 0, 1.0)]
    got = one(metrics.per_user_ranking(scored(spark, rows)))
    assert (got["n_users"], got["hr_1"]) == (1, 1.0)
    assert one(metrics.candidate_set_size(scored(spark, rows)))["n_scored"] == 1


@pytest.mark.parametrize(("sign", "expected"), [(1, 1.0), (-1, 0.0)])
def test_auc(spark, sign, expected):
    rows = [(0, i, y, sign * x) for i, (y, x) in enumerate(((0, -2.0), (0, -1.0), (1, 1.0), (1, 2.0)))]
    assert one(metrics.auc(scored(spark, rows)))["auc"] == expected


def test_auc_of_one_class_is_nan(spark):
    got = one(metrics.auc(scored(spark, [(0, 0, 1, 1.0), (0, 1, 1, 2.0)])))["auc"]
    assert got != got


@pytest.mark.parametrize(("sizes", "expected"), [((11.0, 500.0), False), ((11.0, 11.0), True)])
def test_compare_guard(spark, sizes, expected):
    table = spark.createDataFrame([("a", 0.5, sizes[0]), ("b", None, sizes[1])], "model string, auc double, rows_per_user double")
    got = metrics.compare_guard(table, "auc").orderBy("place").collect()
    assert [r["model"] for r in got] == ["a", "b"]
    assert got[0]["comparable"] is expected


def test_auc_handles_infinite_scores(spark):
    rows = [(0, 0, 0, float("-inf")), (0, 1, 1, 0.0), (0, 2, 1, 1.0)]
    assert one(metrics.auc(scored(spark, rows)))["auc"] == 1.0


def test_quantise(spark):
    df = spark.createDataFrame([([1.5, -1.0, 0.999, -0.009],)], "v array<double>")
    assert list(df.select(expr.quantise_int8(F.col("v"))).first()[0]) == [127, -127, 126, -1]


def test_missing_vector_is_masked(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0])], "item_id long, vec array<double>")
    got = {r["item_id"]: r for r in vectors.lookup_masked(spark.createDataFrame([(1,), (2,)], "item_id long"), v, 2).collect()}
    assert got[1]["known"] and not got[2]["known"] and got[2]["vec"] == [0.0, 0.0]


def test_vocabulary_round_trip(spark):
    voc = vocab.build_vocab(spark.createDataFrame([(7,), (-3,), (7,), (None,)], "id0 long"), "id0")
    assert sorted(map(tuple, voc.collect())) == [(-3, 0), (7, 1)]
    coded = vocab.encode_ids(spark.createDataFrame([(7,), (5,)], "x long"), voc, "x", "idx")
    assert {r["x"]: r["idx"] for r in coded.collect()} == {7: 1, 5: 2}
    back = vocab.decode_ids(spark.createDataFrame([(0,), (2,)], "i long"), voc, "i", "id")
    assert {r["i"]: r["id"] for r in back.collect()} == {0: -3, 2: -1}


def test_pad_left(spark):
    df = spark.createDataFrame([(1, [5, 6]), (2, []), (3, list(range(7)))], "user_id long, history array<long>")
    got = {r["user_id"]: r["history"] for r in sequences.padded(df, 5).collect()}
    assert got == {1: [-1, -1, -1, 5, 6], 2: [-1] * 5, 3: [2, 3, 4, 5, 6]}


@pytest.mark.parametrize("partitions", [1, 4, 13])
def test_prefix_sums_do_not_depend_on_partitions(spark, partitions):
    df = spark.range(1000).select((F.col("id") % 37).alias("k"), "id").repartition(partitions)
    got = prefix_sum(df, "k", {"cum": F.lit(1)}, [F.col("id")]).orderBy("k", "id").select("cum").collect()
    assert [r[0] for r in got] == list(range(1, 1001))
    assert dense_rank_index(df, "k", [F.col("id")]).agg(F.count_distinct("idx"), F.max("idx")).first() == (1000, 999)


def test_top_share_beyond_the_items(spark):
    counts = spark.createDataFrame([(1, 3), (2, 1)], "item_id long, n long")
    assert {r["k"]: r["share"] for r in profile.top_share(counts, (1, 10)).collect()} == {1: 0.75, 10: 1.0}


def test_gini_of_equal_counts(spark):
    assert one(profile.gini(spark.createDataFrame([(i, 5) for i in range(9)], "item_id long, n long")))["gini"] == 0


def test_uniform_sample_by_threshold(spark, monkeypatch):
    monkeypatch.setattr(io, "TOP_N", 10)
    df = spark.range(5000)
    exact = {r[0] for r in df.orderBy(expr.seeded_md5(42, F.col("id")), "id").limit(500).collect()}
    assert {r[0] for r in io.uniform_sample(df, 500, F.col("id")).collect()} == exact


def raw(spark, *texts):
    return {r["raw"]: r["reason"] for r in events.validate(spark.createDataFrame([(t,) for t in texts], "raw string")).collect()}


def test_event_validation(spark):
    good = '{"user_id":1,"item_id":10,"event_type":"click","event_id":"e1"}'
    decode = ["not-json", "}"]
    schema = [
        "[1]", "null", '{"user_id":1,"event_type":"click"}', '{"user_id":"1","item_id":1,"event_type":"c"}', '{"user_id":true,"item_id":1,"event_type":"c"}',
        '{"user_id":1.0,"item_id":1,"event_type":"c"}', '{"user_id":null,"item_id":1,"event_type":"c"}', f'{{"user_id":1,"item_id":{2**70},"event_type":"c"}}', '{"user_id":1,"item_id":1,"event_type":5}',
    ]
    got = raw(spark, good, *decode, *schema)
    assert got == {good: None} | dict.fromkeys(decode, "decode") | dict.fromkeys(schema, "schema")


def log(spark, rows):
    return spark.createDataFrame([(a, T0 + timedelta(seconds=t), i) for a, t, i in rows], "arrival long, ts timestamp, event_id string")


def test_dedup_ttl_is_not_renewed(spark):
    got = events.dedup(log(spark, [(0, 0, "e"), (1, 0, "e"), (2, 9, "e"), (3, 11, "e"), (4, 12, None), (5, 12, None)]), 10)
    assert {r["arrival"]: r["accepted"] for r in got.collect()} == {0: True, 1: False, 2: False, 3: True, 4: True, 5: True}


def test_sessions_newest_first_and_capped(spark):
    rows = [(i, T0 + timedelta(seconds=i), 7, i) for i in range(65)]
    got = sequences.session_snapshot(spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, item_id long")).first()["session"]
    assert len(got) == 50 and got[0] == 64 and 0 not in got


def test_token_bucket(spark):
    rows = [(1, T0, i) for i in range(5)]
    got = events.token_bucket(spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long"), 4, 1e-9).first()
    assert got["n_admitted"] == 4 and got["longest_wait"] > 0
    rows = [(1, T0, 0), (1, T0, 1), (1, T0, 2), (1, T0 + timedelta(seconds=0.1), 3)]
    assert events.token_bucket(spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long"), 2, 50).first()["n_admitted"] == 3


def test_redaction(spark):
    df = spark.createDataFrame([("a", "b", {"Auth-Token": "x", "plain": "y"})], "my_password string, name string, m map<string,string>")
    assert events.redact_columns(df).first()[:2] == ("***", "b")
    assert df.select(events.redact_map(F.col("m"))).first()[0] == {"Auth-Token": "***", "plain": "y"}


def test_bucketed_join_has_no_exchange(spark):
    df = spark.range(1000).select("id", (F.col("id") * 2).alias("x"))
    io.write_bucketed(df, "left_side", "id", 4)
    io.write_bucketed(df, "right_side", "id", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spark.table("left_side").join(spark.table("right_side"), "id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan


def test_write_zstd(spark, tmp_path):
    io.write_zstd(spark.range(10), str(tmp_path / "z"), 4)
    assert spark.read.parquet(str(tmp_path / "z")).count() == 10
    assert len(list((tmp_path / "z").glob("*.zstd.parquet"))) >= 3


def test_behaviour_csv(spark, tmp_path):
    (tmp_path / "log.csv").write_text("1,2,3,pv,1511544070\n")
    got = io.behaviour_csv(spark, str(tmp_path / "log.csv")).first()
    assert (got["user_id"], got["behavior_type"], got["ts"]) == (1, "pv", datetime(2017, 11, 24, 17, 21, 10))


def test_blocked_topk_over_many_blocks(spark):
    items = spark.range(50).select(F.col("id").alias("item_id"), F.array(F.cos("id"), F.sin("id")).alias("vec"))
    users = spark.range(20).select(F.col("id").alias("user_id"), F.array(F.cos(F.col("id") * 3), F.sin(F.col("id") * 3)).alias("vec"))
    key = lambda df: sorted((r["user_id"], r["rank"], r["item_id"]) for r in df.collect())
    assert key(retrieval.exact_topk(users, items, 5, 7)) == key(retrieval.exact_topk(users, items, 5, 1000))


def test_recall_grows_with_probes(spark):
    items = spark.range(200).select(F.col("id").alias("item_id"), F.array(*[F.sin(F.col("id") * (i + 1)) for i in range(8)]).alias("vec"))
    users = items.select(F.col("item_id").alias("user_id"), "vec").where("user_id < 40")
    exact = retrieval.exact_topk(users, items, 5)
    index = indices.build_product_index(items, cells=8)
    recall = [one(retrieval.ann_recall(exact, indices.ivf_topk(users, items, 5, nprobe=n, index=index)))["recall"] for n in (1, 8)]
    assert recall[0] <= recall[1] and recall[1] >= 0.95
    everything = indices.ivf_topk(users, items, 5, nprobe=8, short=200, index=index)
    assert one(retrieval.ann_recall(exact, everything))["recall"] == 1.0


def test_codebooks_are_means_of_what_is_nearest(spark):
    rows, ddl = unit_vectors(300, 8, 5, "item_id")
    books = indices.learn_words(spark.createDataFrame(rows, ddl), 2, 6, rounds=3)
    x = np.array([v for _, v in rows]).reshape(300, 2, 4)
    again = indices.learn_words(spark.createDataFrame(rows, ddl), 2, 6, rounds=4)
    for p in range(2):
        at = ((x[:, p, None] - books[p][None]) ** 2).sum(2).argmin(1)
        for w in set(at.tolist()):
            assert np.allclose(again[p, w], x[at == w, p].mean(0))


def test_table_scores_are_products_with_what_codes_stand_for(spark):
    users, items = (spark.createDataFrame(*unit_vectors(n, 16, seed, key)) for n, seed, key in ((7, 1, "user_id"), (90, 2, "item_id")))
    index = indices.build_product_index(items, cells=3, parts=4, words=16)
    near = {r["item_id"]: index.cells[r["cell"]] + np.concatenate([index.books[p, c] for p, c in enumerate(r["code"])]) for r in index.codes.collect()}
    for r in users.collect():
        ranked = sorted(near, key=lambda i: (-round(float(near[i] @ np.array(r["vec"])), 9), i))
        got = indices.short_lists(users, index, 5, nprobe=3, short=9).where(F.col("user_id") == r["user_id"]).collect()
        assert {x["item_id"] for x in got} == set(ranked[:9])


def test_hadamard_and_its_probes():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(5, 16))
    h = np.array([[(-1) ** (bin(i & j).count("1")) for j in range(16)] for i in range(16)]) / 4
    assert np.allclose(indices.hadamard(x), x @ h)
    lists = [np.sort(rng.random(6)) for _ in range(3)]
    sums = sorted((lists[0][a] + lists[1][b] + lists[2][c], (a, b, c)) for a in range(6) for b in range(6) for c in range(6))
    got = indices.least_sums(lists, 216)
    assert len(set(got)) == 216 and [round(sum(x[i] for x, i in zip(lists, g, strict=True)), 12) for g in got] == [round(s, 12) for s, _ in sums]
    for joined in (1, 2):
        hashed = indices.fit_polytopes(12, 3, joined)
        v = rng.normal(size=(40, 12))
        assert (hashed.probes(v, 6)[:, :, 0] == hashed.hashes(v)).all()
        assert all(len(set(p)) == 6 for row in hashed.probes(v, 6).tolist() for p in row)


def test_pairs_are_scored_once(spark):
    users, items = (spark.createDataFrame(*unit_vectors(n, 8, seed, key)).persist() for n, seed, key in ((40, 1, "user_id"), (120, 2, "item_id")))
    hashed = indices.fit_polytopes(8, 4)
    u, i = (np.array([r["vec"] for r in df.orderBy(key).collect()]) for df, key in ((users, "user_id"), (items, "item_id")))
    meets = (hashed.probes(u, 3)[:, None, :, :] == hashed.hashes(i)[None, :, :, None]).any((2, 3))
    met = indices.lsh_meetings(users, items, 120, 8, 4, 3).collect()
    assert sorted((r["user_id"], r["item_id"]) for r in met) == [(int(a), int(b)) for a, b in zip(*np.nonzero(meets), strict=True)]
    assert sum(r["n_scored"] for r in met) == len(met)
    joined = indices.lsh_topk(users, items, 10, 8, 12, 30, joined=2)
    assert one(retrieval.ann_recall(retrieval.exact_topk(users, items, 10), joined))["recall"] > 0.7


def test_registered_indices_save_work(spark):
    """Recall and the share of pairs whose vectors are multiplied, as the query gives them."""
    got = {(r["index"], r["effort"], r["probes"]): r for r in learning.ann_recall_sweep(spark, "/root/testdata/sf0.01").collect()}
    ivf, lsh = got["ivf", learning.IVF[1], learning.IVF[0]], got["lsh", *learning.LSH]
    assert ivf["recall"] >= 0.9 and ivf["scored_share"] <= 0.25
    assert lsh["recall"] >= 0.9 and lsh["scored_share"] < 0.5


def unit_vectors(n, dim, seed, key):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim))
    return [(i, (x / np.linalg.norm(x)).tolist()) for i, x in enumerate(v)], f"{key} long, vec array<double>"


@pytest.mark.parametrize("index", ["ivf", "lsh"])
def test_registered_indices_reach_nine_tenths(spark, index):
    users, items = (spark.createDataFrame(*unit_vectors(n, 64, seed, key)).persist() for n, seed, key in ((150, 1, "user_id"), (600, 2, "item_id")))
    got = indices.ivf_topk(users, items, 10, *[16, *learning.IVF]) if index == "ivf" else indices.lsh_topk(users, items, 10, 64, *learning.LSH)
    assert one(retrieval.ann_recall(retrieval.exact_topk(users, items, 10), got))["recall"] >= 0.9
    assert got.groupBy("user_id").count().where("count < 10").count() == 0


@pytest.mark.parametrize("bytes_", [64 << 20, 0])
def test_cells_with_and_without_broadcast(spark, bytes_, monkeypatch):
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", bytes_)
    users, items = (spark.createDataFrame(*unit_vectors(n, 8, seed, key)) for n, seed, key in ((40, 3, "user_id"), (90, 4, "item_id")))
    got = retrieval.exact_topk(users, items, 4, 7)
    u, i = (np.array([r["vec"] for r in df.orderBy(df.columns[0]).collect()]) for df in (users, items))
    best = np.argsort(-(u @ i.T), axis=1)[:, :4]
    assert sorted((r["user_id"], r["rank"], r["item_id"]) for r in got.collect()) == sorted((a, b + 1, int(best[a, b])) for a in range(40) for b in range(4))


def test_equal_vectors_are_cut_by_item(spark):
    items = spark.range(300).select(F.col("id").alias("item_id"), F.array(F.lit(0.0), F.lit(0.0)).alias("vec"))
    users = spark.range(3).select(F.col("id").alias("user_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("vec"))
    assert {(r["user_id"], r["item_id"]) for r in retrieval.exact_topk(users, items, 5, 50).collect()} == {(u, i) for u in range(3) for i in range(5)}


def histories_of(spark, rows):
    return spark.createDataFrame(rows, "user_id long, history array<long>")


VECTORS = {1: [1.0, 0.0], 2: [0.0, 1.0], 3: [-1.0, 0.0]}


def test_unknown_history_items(spark):
    """They count as zero for the greatest similarity, and are masked for search and attention."""
    v = spark.createDataFrame(list(VECTORS.items()), "item_id long, vec array<double>")
    rows = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 99, 0), (4, 1, 0)], "user_id long, item_id long, label int")
    h = histories_of(spark, [(1, [3, 99]), (2, [3, 2]), (3, [1, 2]), (4, [99])])
    knn = {r["user_id"]: r["score"] for r in scorers.score_content_knn(rows, h, v).collect()}
    assert knn == {1: 0.0, 2: 0.0, 3: 0.0, 4: 0.0}
    found = {(r["user_id"], r["rank"]): (r["history_item"], r["sim"]) for r in scorers.history_search(rows, h, v, 2).collect()}
    assert found == {(1, 1): (3, -1.0), (2, 1): (2, 0.0), (2, 2): (3, -1.0), (3, 1): (1, 0.0), (3, 2): (2, 0.0)}
    att = {r["user_id"]: [round(x, 6) for x in r["vec"]] for r in scorers.target_attention(rows, h, v).collect()}
    assert att[1] == [-1.0, 0.0] and att[3] == [0.5, 0.5] and att[4] == [0.0, 0.0]


def test_own_item_is_left_out_of_the_history(spark):
    v = spark.createDataFrame(list(VECTORS.items()), "item_id long, vec array<double>")
    rows = spark.createDataFrame([(1, 1, True), (1, 1, False)], "user_id long, item_id long, own boolean")
    got = [(round(r["max_similarity"], 6), round(r["attention"], 6), round(r["pooled_cosine"], 6)) for r in scorers.history_features(rows, histories_of(spark, [(1, [1, 2])]), v).collect()]
    assert sorted(got)[0] == (0.0, 0.0, 0.0) and sorted(got)[1][0] == 1.0


@pytest.mark.parametrize("many", [10_000, 3])
def test_candidates_of_a_user_are_spread(spark, many, monkeypatch):
    monkeypatch.setattr(scorers, "MANY", many)
    rows, schema = unit_vectors(60, 4, 5, "item_id")
    v = spark.createDataFrame(rows, schema)
    cand = spark.createDataFrame([(u, i) for u in (1, 2) for i in range(40)] + [(3, 5)], "user_id long, item_id long")
    h = histories_of(spark, [(1, list(range(50, 60))), (2, [7])])
    got = {(r["user_id"], r["item_id"]): r["score"] for r in scorers.score_content_knn(cand, h, v).collect()}
    m = np.array([x for _, x in rows])
    assert len(got) == 81 and got[3, 5] == float("-inf")
    assert all(abs(got[1, i] - (m[50:] @ m[i]).max()) < 1e-9 and abs(got[2, i] - m[7] @ m[i]) < 1e-9 for i in range(40))


def test_ranker_learns_from_likeness(spark):
    """Users click what is like their history: the ranker finds it on users that it hasn't seen, popularity doesn't."""
    rng = np.random.default_rng(9)
    rows, schema = unit_vectors(200, 8, 6, "item_id")
    m, cand, hist = np.array([x for _, x in rows]), [], []
    for u in range(120):
        taste = rng.normal(size=8)
        order = np.argsort(-(m @ taste))
        hist.append((u, [int(i) for i in order[:10]]))
        picks = [int(i) for i in np.concatenate([order[10:15], rng.choice(order[40:], 15, replace=False)])]
        cand += [(u, i, int(n < 5), False) for n, i in enumerate(picks)]
    df = spark.createDataFrame(cand, "user_id long, item_id long, label int, own boolean")
    features = df.join(scorers.history_features(df.select("user_id", "item_id", "own"), histories_of(spark, hist), spark.createDataFrame(rows, schema)), ["user_id", "item_id"]).persist()
    model = scorers.fit_pointwise_ranker(features.where("user_id < 60"), ["pooled_cosine", "max_similarity", "attention"])
    test = features.where("user_id >= 60")
    pop = scorers.score_positive_pop(test.select("user_id", "item_id", "label"), df.where("user_id < 60"))
    assert one(metrics.auc(scorers.score_pointwise(model, test)))["auc"] > max(0.9, one(metrics.auc(pop))["auc"])


def test_cold_start_falls_back_to_a_sample(spark):
    popular = spark.createDataFrame([(5, 9), (6, 9)], "item_id long, n long")
    catalogue = spark.range(20).select(F.col("id").alias("item_id"))
    got = retrieval.cold_start(spark.range(2).select(F.col("id").alias("user_id")), popular, 6, catalogue=catalogue).collect()
    lists = {u: [r["item_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["user_id"] == u] for u in (0, 1)}
    assert lists[0] == lists[1] and lists[0][:2] == [5, 6] and len(set(lists[0])) == 6 and {r["cold"] for r in got} == {True}


def test_heldout_verdicts(spark):
    lists = lambda rows: spark.createDataFrame(rows, "user_id long, item_id long, rank int")
    targets = spark.createDataFrame([(u, 1) for u in range(10)], "user_id long, target long")
    good, half = lists([(u, 1, 1) for u in range(10)]), lists([(u, 1, 1) for u in range(5)])
    assert one(retrieval.heldout_hits(half, good, targets, 1000, 10)) == {"n_targets": 10, "hit_rate": 0.5, "baseline_rate": 1.0, "random_rate": 0.01, "beats_random": True, "holds_baseline": False}
    assert one(retrieval.heldout_hits(good, half, targets, 50, 10))["beats_random"] is False


def test_schema_contract_counts_every_rule(spark):
    rows = [(1, [0, 1], 1, [0.0, 0.0]), (None, [1], 2, [0.0]), (2, None, None, None), (3, [1, 0], 0, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "k long, label_0 array<int>, label int, vec array<double>")
    got = {r["rule"]: r["n_violations"] for r in profile.schema_contract(df, ["k"], "label_0", "label", "vec", 2, ["k", "city"]).collect()}
    assert got == {"null_key": 1, "onehot_length": 2, "label_range": 2, "vector_length": 2, "missing:city": 1}


def test_skewed_join_is_split_at_run_time(spark):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        a = spark.range(0, 60_000, 1, 8).select(F.when(F.col("id") % 10 < 9, 0).otherwise(F.col("id")).alias("k"), F.md5(F.col("id").cast("string")).alias("x"))
        joined = a.join(spark.range(60_000).select(F.col("id").alias("k")), "k")
        joined.collect()
        assert "AQEShuffleRead skewed" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_salted_join_equals_join(spark):
    a = spark.range(100).select("id", (F.col("id") % 2).alias("k"))
    b = spark.createDataFrame([(0, "x"), (1, "y")], "k long, v string")
    key = lambda df: sorted(map(tuple, df.select("id", "k", "v").collect()))
    assert key(joins.salted_join(a, b, "k", 5, "id")) == key(a.join(b, "k"))


def test_no_history_scores_minus_infinity(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0])], "item_id long, vec array<double>")
    rows = spark.createDataFrame([(9, 1, 0)], "user_id long, item_id long, label int")
    h = spark.createDataFrame([], "user_id long, history array<long>")
    assert scorers.score_content_knn(rows, h, v).first()["score"] == float("-inf")


def test_every_stratum_with_an_unseen_item_gives_a_negative(spark):
    counts = spark.range(500).select(F.col("id").alias("item_id"), (1000 - F.col("id")).alias("n"))
    unseen = {7, 199, 200, 350}
    seen = spark.createDataFrame([(1, i) for i in range(500) if i not in unseen], "user_id long, item_id long")
    got = training.stratified_negatives(seen.limit(40), counts, seen).collect()
    assert len(got) == len({(r["item_id"], r["stratum"]) for r in got}) == 40 * 4
    assert all(r["negative"] in unseen and r["negative"] // 100 == r["stratum"] for r in got)


@pytest.mark.parametrize("slots", [1, 2, 3, 20])
def test_negatives_fill_up_to_the_number_asked_for(spark, slots):
    """Two unseen items in a stratum give both, whatever the draws; a stratum with one gives one, one that is seen whole none, an untouched one two."""
    counts = spark.createDataFrame([(i, 400 - i) for i in range(400)], "item_id long, n long")
    unseen = {7, 60, 150, *range(300, 400)}
    seen = spark.createDataFrame([(1, i) for i in range(400) if i not in unseen] + [(2, 5)], "user_id long, item_id long")
    pairs = spark.createDataFrame([(1, 5), (1, 6), (2, 5), (3, 1)], "user_id long, item_id long")
    got = training.stratified_negatives(pairs, counts, seen, strata=4, per_stratum=2, slots=slots).collect()
    by: dict = {}
    for r in got:
        by.setdefault((r["user_id"], r["item_id"], r["stratum"]), []).append(r["negative"])
    assert all(len(v) == len(set(v)) <= 2 and all(x // 100 == k[2] for x in v) for k, v in by.items())
    for item in (5, 6):
        assert set(by[1, item, 0]) == {7, 60} and by[1, item, 1] == [150] and (1, item, 2) not in by and len(by[1, item, 3]) == 2 and set(by[1, item, 3]) <= unseen
    assert all(len(by[u, i, st]) == 2 for u, i in ((2, 5), (3, 1)) for st in range(4)) and all(5 not in v for k, v in by.items() if k[0] == 2)


def test_quantiles_equal_sorted_lists(spark):
    rng = np.random.default_rng(8)
    rows = [("a", float(x)) for x in rng.normal(size=500)] + [("b", float(x)) for x in rng.integers(0, 4, 700)] + [("c", 3.0), ("d", 1.0), ("d", 2.0), ("e", None)] + [("f", float(x)) for x in [5] * 900 + [6]]
    qs = {"lo": 0.0, "p10": 0.1, "mid": 0.5, "p99": 0.99, "hi": 1.0}
    got = {r["g"]: r for r in sketches.exact_quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", qs).collect()}
    lists = {g: [x for k, x in rows if k == g and x is not None] for g in "abcdf"}
    assert got.keys() == lists.keys()
    assert all(abs(got[g][n] - np.quantile(x, q)) < 1e-9 for g, x in lists.items() for n, q in qs.items())
    whole = one(sketches.exact_quantiles(spark.createDataFrame(rows, "g string, x double"), [], "x", qs))
    assert all(abs(whole[n] - np.quantile([x for _, x in rows if x is not None], q)) < 1e-9 for n, q in qs.items())


def test_sketches_of_parts_merge(spark):
    rng = np.random.default_rng(9)
    x = rng.gamma(2.0, size=20_000)
    df = spark.createDataFrame([(i % 7, int(i % 3), float(v), int(i * 7919 % 6000)) for i, v in enumerate(x)], "day int, g int, v double, u long")
    got = sketches.merged_quantiles(sketches.quantile_sketches(df, ["day", "g"], "v"), ["g"], {"p50": 0.5, "p99": 0.99}).collect()
    for r in got:
        own = np.sort(x[np.arange(len(x)) % 3 == r["g"]])
        assert r["n"] == len(own)
        assert all(abs(np.searchsorted(own, r[n]) / len(own) - q) < 0.02 for n, q in (("p50", 0.5), ("p99", 0.99)))
    n = sketches.merged_distinct(sketches.distinct_sketches(df, ["day", "g"], ["u"]), ["g"], ["u"]).collect()
    exact = {r["g"]: r["n"] for r in df.groupBy("g").agg(F.count_distinct("u").alias("n")).collect()}
    assert all(abs(r["n_u"] - exact[r["g"]]) <= 0.02 * exact[r["g"]] for r in n)


def test_hot_keys_are_found_and_only_they_are_spread(spark):
    rows = [(1, i) for i in range(6000)] + [(2, i) for i in range(2500)] + [(100 + i, i) for i in range(9000)] + [(None, 0)] * 500
    large = spark.createDataFrame(rows, "key long, row long").repartition(5).persist()
    hot = {r["key"]: r["n"] for r in sketches.hot_keys(large, "key", 0.1, size=64).collect()}
    assert hot == {1: 6000, 2: 2500}
    assert sketches.hot_keys(large, "key", 0.5, size=16).count() == 0
    small = spark.createDataFrame([(k, f"v{k}") for k in [1, 2, *range(100, 4000)]], "key long, name string")
    joined = joins.hot_key_join(large, small, "key", "row", rows_a_task=1000, share=0.1)
    assert joined.count() == 8500 + 3900 and joined.where("name != concat('v', key)").count() == 0
    assert sorted(r["n"] for r in sketches.salts_of(sketches.hot_keys(large, "key", 0.1), 1000).select(F.col("salts").alias("n")).collect()) == [3, 6]
    salted = large.join(F.broadcast(sketches.salts_of(sketches.hot_keys(large, "key", 0.1), 1000)), "key").groupBy("key", F.floor(expr.hash_unit(42, F.col("row")) * F.col("salts")).alias("s")).count()
    assert salted.agg(F.max("count")).first()[0] < 1300  # the hot key's largest share of a task
    left = joins.hot_key_join(large, small, "key", "row", rows_a_task=1000, share=0.1, how="left")
    assert left.count() == len(rows)
    with pytest.raises(ValueError, match="summary"):
        sketches.hot_keys(large, "key", 0.001, size=64)


def test_vocabularies_of_any_size_and_type(spark, monkeypatch):
    df = spark.createDataFrame([(i * 7919 % 1000, f"v{i % 300}", None if i % 2 else 1.5) for i in range(1500)], "a long, b string, c double").repartition(6)
    for c in ("a", "b", "c"):
        ids = sorted({r[0] for r in df.select(c).collect() if r[0] is not None})
        assert [(r["id"], r["idx"]) for r in vocab.small_vocab(df, c).orderBy("idx").collect()] == [(v, i) for i, v in enumerate(ids)]
    both = []
    for most in (100_000, 10):
        monkeypatch.setattr(vocab, "SMALL", most)
        got = vocab.encode_categoricals(df, vocab.small_vocabs(df, ["a", "b", "c"]))
        both.append(sorted(map(str, got.collect())))
    assert both[0] == both[1] and one(df.join(got, ["a", "b"]).agg(F.max("c_idx").alias("m")))["m"] == 1


def test_batch_loss_and_its_gradients():
    rng = np.random.default_rng(2)
    u, v, w = rng.normal(size=(7, 5)), rng.normal(size=(7, 5)), [rng.normal(size=(5, 3)) for _ in range(2)]
    users, items, log_q = np.array([1, 1, 2, 3, 4, 5, 6]), np.array([1, 2, 2, 3, 4, 5, 5]), np.log(rng.random(7))
    loss, grads = towers.batch_loss(u, v, users, items, log_q, w, 2.0)
    plain = 0.0
    for i in range(7):
        logits = {j: 2.0 * (u[i] @ w[0]) @ (v[j] @ w[1]) - log_q[j] for j in range(7) if j == i or (users[j] != users[i] and items[j] != items[i])}
        plain += np.log(sum(np.exp(x) for x in logits.values())) - logits[i]
    assert abs(loss - plain / 7) < 1e-9
    for side in range(2):
        for at in ((0, 0), (4, 2), (2, 1)):
            moved = [x.copy() for x in w]
            moved[side][at] += 1e-6
            assert abs((towers.batch_loss(u, v, users, items, log_q, moved, 2.0)[0] - loss) / 1e-6 - grads[side][at]) < 1e-4


def test_towers_find_planted_tastes(spark):
    """Users click items by a hidden turn of their content: towers find held-out clicks better than factors and than content alone."""
    rng = np.random.default_rng(4)
    turn = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    unit = lambda n: (x := rng.normal(size=(n, 12))) / np.linalg.norm(x, axis=1, keepdims=True)
    users, items = unit(300), unit(250)
    liked = np.argsort(-((users @ turn) @ items.T + 0.05 * rng.normal(size=(300, 250))), axis=1)[:, :8]
    train = [(u, int(i)) for u in range(300) for i in liked[u, 1::2]]
    held = spark.createDataFrame([(u, int(liked[u, 0])) for u in range(300)], "user_id long, target long")
    us, vs = (spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], f"{k} long, vec array<double>").persist() for m, k in ((users, "user_id"), (items, "item_id")))
    clicked = spark.createDataFrame([(u, i, 1) for u, i in train], "user_id long, item_id long, label int")
    pairs = clicked.join(us.withColumnRenamed("vec", "u"), "user_id").join(vs.withColumnRenamed("vec", "v"), "item_id").join(training.log_q(clicked), "item_id")
    losses: list = []
    model = towers.fit_towers(pairs, epochs=6, batch=64, rate=0.05, tasks=2, losses=losses)
    als = scorers.fit_retrieval_factors(clicked)
    factors = [f.select(F.col("id").cast("long").alias(k), F.col("features").cast("array<double>").alias("vec")) for f, k in ((als.userFactors, "user_id"), (als.itemFactors, "item_id"))]
    recall = {n: one(metrics.recall_from_topk(retrieval.exact_topk(u, i, 20), held, (20,), 20))["recall_20"] for n, (u, i) in {
        "towers": (model.project(us, "user_id", "user"), model.project(vs, "item_id", "item")), "factors": factors, "content": (us, vs),
    }.items()}
    assert losses[-1] < losses[0] - 0.3
    assert recall["towers"] > 0.6 and recall["towers"] > recall["factors"] + 0.1 and recall["towers"] > recall["content"] + 0.3
    again = towers.fit_towers(pairs, epochs=6, batch=64, rate=0.05, tasks=2)
    assert all(np.allclose(again.weights[s], model.weights[s]) for s in towers.SIDES)


def test_boosted_ranker_finds_what_a_line_cannot(spark):
    """Clicks where two features agree in sign: no line separates them, trees do."""
    rng = np.random.default_rng(6)
    rows = [(i, i, float(a), float(b), int(a * b > 0)) for i, (a, b) in enumerate(rng.normal(size=(1200, 2)))]
    df = spark.createDataFrame(rows, "user_id long, item_id long, a double, b double, label int")
    train, test = df.where("user_id < 900"), df.where("user_id >= 900")
    got = {trees: one(metrics.auc(scorers.score_pointwise(scorers.fit_pointwise_ranker(train, ["a", "b"], 2.0, trees=trees), test).select("label", "score")))["auc"] for trees in (0, 12)}
    assert got[0] < 0.65 and got[12] > 0.93


def test_late_events_over_many_ranges(spark):
    """A source with most of the rows, equal arrivals, and times that run far behind: as one pass over the sorted rows counts them."""
    rng = np.random.default_rng(7)
    rows = [(0 if i % 10 else 1, int(rng.integers(0, 400)), i, T0 + timedelta(seconds=int(rng.integers(0, 5000)))) for i in range(3000)] + [(2, 1, 1, T0)]
    got = {r["s"]: tuple(r)[1:] for r in events.late_events(spark.createDataFrame(rows, "s int, arrival int, tie long, ts timestamp"), 600, "arrival", "s", "tie").collect()}
    for source in (0, 1, 2):
        high, n, out, late = None, 0, 0, 0
        for _, _, t in sorted((a, k, t) for s, a, k, t in rows if s == source):
            n, out, late = n + 1, out + (high is not None and t < high), late + (high is not None and t < high - timedelta(seconds=600))
            high = t if high is None else max(high, t)
        assert got[source] == (n, out, late)


def test_scratch_is_cleared(spark):
    from rillmark import scratch

    kept = scratch.materialize(spark.range(5), "five")
    assert kept.count() == 5 and any(scratch.RUN in f for f in kept.inputFiles())
    with scratch.Scratch(spark, "block") as space:
        assert space.keep(spark.range(3), "three").count() == 3
    scratch.clear(spark)
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        spark.read.schema("id long").parquet(kept.inputFiles()[0]).collect()
