"""Sequences, training tables, scorers, metrics and retrieval (G to K of the inventory)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from rillmark.functions.expr import dot
from rillmark.operators import indices, joins, metrics, retrieval, scorers, sequences, towers, training, vocab
from rillmark.operators import profile as P
from rillmark.plans.base import CLICKS, IX, META, RANKED, UNIT, VEC, query, rounded
from rillmark.plans.profiles import histories, train_purchases
from rillmark.scratch import materialize
from rillmark.sources import io
from rillmark.sources import tables as T

DIM = 64
_HIST = "hist AS (SELECT user_id, list(item_id ORDER BY r DESC) AS h FROM ranked WHERE r <= 1000 GROUP BY 1)"
HIST = f"{RANKED}, {_HIST}"


@query("user_history", f"WITH {HIST} SELECT user_id, h AS history FROM hist")
def user_history(s, d):
    return histories(s, d)


@query("first_row_per_user", f"WITH {RANKED} SELECT user_id, arg_min(item_id, (ts, order_id, line, item_id)) AS item_id, min(ts) AS ts FROM ranked GROUP BY 1")
def first_row_per_user(s, d):
    return sequences.first_row_per_user(train_purchases(s, d), ["ts", "order_id", "line", "item_id"]).select("user_id", "item_id", "ts")


@query("user_budget", f"WITH {IX}, u AS (SELECT DISTINCT user_id FROM ix), b AS (SELECT user_id FROM u ORDER BY md5(concat_ws('|', user_id, '42')), user_id LIMIT 200) SELECT user_id, item_id, label FROM ix WHERE user_id IN (SELECT user_id FROM b)")
def user_budget(s, d):
    ix = T.interactions(s, d).select("user_id", "item_id", "label")
    return ix.join(io.uniform_sample(ix.select("user_id").distinct(), 200, F.col("user_id")), "user_id", "left_semi").select("user_id", "item_id", "label")


@query("pad_left", f"WITH {HIST} SELECT user_id, CASE WHEN len(h) >= 25 THEN h[-25:] ELSE list_concat(list_transform(range(25 - len(h)), lambda i: -1::BIGINT), h) END AS history FROM hist")
def pad_left(s, d):
    return sequences.padded(histories(s, d), 25)


@query("ragged_offsets", f'WITH {HIST}, n AS (SELECT user_id, len(h) AS n, sum(len(h)) OVER (ORDER BY user_id) AS e FROM hist) SELECT user_id, (e - n)::BIGINT AS "start", e::BIGINT AS "end" FROM n')
def ragged_offsets(s, d):
    return sequences.ragged_offsets(histories(s, d))


_POOL = """{name} AS (SELECT user_id, i, {mean} AS x FROM (SELECT user_id, unnest({slice}) AS item_id, len({slice}) AS n FROM hist) JOIN {vec} v USING (item_id), range(1, 65) t(i) GROUP BY 1, 2)"""


@query("masked_mean_pool", f"WITH {HIST}, {VEC}, " + _POOL.format(name="p", mean="avg(vec[i])", slice="h[-200:]", vec="vec") + " SELECT user_id, list(round(x, 6) + 0.0::DOUBLE ORDER BY i) AS vec FROM p GROUP BY 1")  # SQL keeps the sign of what it rounds to zero; adding zero takes it off
def masked_mean_pool(s, d):
    return sequences.pooled(histories(s, d), T.item_vectors(s, d)).select("user_id", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


@query("padded_mean_pool", f"WITH {HIST}, {VEC}, " + _POOL.format(name="p", mean="sum(vec[i]) / max(n)", slice="h", vec="vec") + ", l AS (SELECT user_id, list(x ORDER BY i) AS v FROM p GROUP BY 1) SELECT user_id, list_transform(v, lambda x: round(x / sqrt(list_sum(list_transform(v, lambda y: y * y))), 6) + 0.0::DOUBLE) AS vec FROM l")
def padded_mean_pool(s, d):
    return sequences.unit_pooled(histories(s, d), T.item_vectors(s, d)).select("user_id", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


@query("completeness_check", f"""WITH {IX}, {HIST}, u AS (SELECT user_id, count(*) AS n FROM ix WHERE split = 'test' GROUP BY 1) SELECT round(avg(n), 6) AS rows_per_user, avg(n) > 3 AND avg(n) < 13 AS within_bounds, count(*) FILTER (WHERE h IS NULL) AS n_without_history FROM u LEFT JOIN hist USING (user_id)""")
def completeness_check(s, d):
    return rounded(sequences.completeness_check(T.interactions(s, d).where("split = 'test'"), histories(s, d), 3, 13))


@query("session_snapshot", f"WITH {CLICKS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM clicks) SELECT user_id, list(item_id ORDER BY r) AS session FROM r WHERE r <= 50 GROUP BY 1")
def session_snapshot(s, d):
    return sequences.session_snapshot(T.clicks(s, d))


@query("session_ttl", f"""WITH {CLICKS}, g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 3600000000 THEN 0 ELSE 1 END AS fresh FROM clicks WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM g) SELECT user_id, no::BIGINT AS session_no, count(*) AS n, min(ts) AS started FROM n GROUP BY 1, 2""")
def session_ttl(s, d):
    cut = sequences.sessions(T.clicks(s, d), 3600)
    return cut.groupBy("user_id", "session_no").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("started"))


_COLUMNS = ("nation", "segment", "balance", "region", "wealth", "category", "city", "province")
_CODES = ", ".join(f"(dense_rank() OVER (ORDER BY {c}) - 1)::BIGINT AS {c}_idx" for c in _COLUMNS[:5])
_ITEM_CODES = ", ".join(f"(dense_rank() OVER (ORDER BY {c}) - 1)::BIGINT AS {c}_idx" for c in _COLUMNS[5:])


@query("prepared_split", f"""WITH {IX}, {META}, voc AS (SELECT item_id AS id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM (SELECT DISTINCT vec_id AS item_id FROM embeddings)), usr AS (SELECT user_id AS id, row_number() OVER (ORDER BY user_id) - 1 AS idx FROM (SELECT DISTINCT user_id FROM ix)),
  people AS (SELECT c_custkey, c_nationkey AS nation, c_mktsegment AS segment, sign(c_acctbal)::INT AS balance, n_regionkey AS region, floor(c_acctbal / 1000)::BIGINT AS wealth FROM customer JOIN nation ON n_nationkey = c_nationkey),
  pc AS (SELECT c_custkey, {_CODES} FROM people), mc AS (SELECT item_id, {_ITEM_CODES} FROM meta)
  SELECT split, usr.idx AS user_idx, coalesce(voc.idx, (SELECT count(*) FROM voc)) AS item_idx, label, {', '.join(f'{c}_idx' for c in _COLUMNS)}
  FROM ix JOIN usr ON usr.id = user_id LEFT JOIN voc ON voc.id = item_id LEFT JOIN mc USING (item_id) LEFT JOIN pc ON c_custkey = user_id""")
def prepared_split(s, d):
    """``split, user_idx, item_idx, label`` and eight encoded columns: five of the user, three of the item. The small tables are
    encoded before they meet the rows."""
    ix, meta = T.interactions(s, d), T.item_features(s, d)
    region = T.load(s, d, "nation", "n_nationkey", "n_regionkey").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    wealth = T.load(s, d, "customer", "c_custkey", "c_acctbal").select(F.col("c_custkey").alias("user_id"), F.floor(F.col("c_acctbal") / 1000).alias("wealth"))
    people = T.demographics(s, d).join(F.broadcast(region), "nation").join(wealth, "user_id")  # a row a nation
    ix = materialize(ix.select("user_id", "item_id", "label", "split"), "interactions")
    people, meta = (vocab.encode_categoricals(df, vocab.small_vocabs(df, list(names))).drop(*names) for df, names in ((people, _COLUMNS[:5]), (meta, _COLUMNS[5:])))
    rows = joins.join_item_meta(ix.select("user_id", "item_id", "label", "split"), meta).join(people, "user_id", "left")
    for ids, c, out in ((ix, "user_id", "user_idx"), (T.item_vectors(s, d), "item_id", "item_idx")):
        v = materialize(vocab.build_vocab(ids, c), "vocabulary")
        rows = vocab.encode_ids(rows, v, c, out, v.count())
    return rows.select("split", "user_idx", "item_idx", "label", *[f"{c}_idx" for c in _COLUMNS])


@query("pos_weight", f"WITH {IX} SELECT round(avg(label), 6) AS positive_rate, round((1 - avg(label)) / greatest(avg(label), 1e-6), 6) AS pos_weight FROM ix WHERE split = 'train'")
def pos_weight(s, d):
    return rounded(training.pos_weight(T.interactions(s, d).where("split = 'train'")))


@query("log_q", f"WITH {IX}, c AS (SELECT item_id, count(*) AS n FROM ix WHERE label = 1 AND split = 'train' GROUP BY 1) SELECT item_id, round(ln(n / (SELECT sum(n) FROM c) + 1e-12), 6) AS log_q FROM c")
def log_q(s, d):
    return rounded(training.log_q(T.interactions(s, d).where("split = 'train'")))


_SHUFFLE = "sh AS (SELECT user_id, item_id, row_number() OVER (ORDER BY md5(concat_ws('|', user_id, item_id, '42'))) - 1 AS position FROM ix WHERE split = 'train' AND label = 1)"


@query("epoch_shuffle", f"WITH {IX}, {_SHUFFLE} SELECT *, position // 64 AS batch FROM sh")
def epoch_shuffle(s, d):
    return _shuffled(s, d)


def _shuffled(s, d):
    clicked = T.interactions(s, d).where("split = 'train' AND label = 1").select("user_id", "item_id")
    return training.epoch_shuffle(clicked, [F.col("user_id"), F.col("item_id")], 64)


@query("inbatch_negatives", f"""WITH {IX}, {_SHUFFLE}, b AS (SELECT *, position // 64 AS batch FROM sh), c AS (SELECT item_id, count(*) AS n FROM ix WHERE label = 1 AND split = 'train' GROUP BY 1)
  SELECT x.batch, count(*) AS n_pairs, round(sum(-ln(c.n / (SELECT sum(n) FROM c) + 1e-12)), 4) AS weight FROM b x JOIN b y ON x.batch = y.batch AND x.user_id <> y.user_id AND x.item_id <> y.item_id JOIN c ON c.item_id = y.item_id GROUP BY 1""")
def inbatch_negatives(s, d):
    q = training.log_q(T.interactions(s, d).where("split = 'train'"))
    pairs = training.inbatch_negatives(_shuffled(s, d), q)
    return rounded(pairs.groupBy("batch").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum("weight").alias("weight")), 4)


@query("temporal_split", f"WITH {CLICKS} SELECT event_id, CASE WHEN ts < (SELECT date_trunc('day', max(ts)) FROM clicks) THEN 'train' ELSE 'test' END AS split FROM clicks")
def temporal_split(s, d):
    return training.temporal_split(T.clicks(s, d)).select("event_id", "split")


@query("leave_one_out", f"WITH {CLICKS} SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 THEN 'test' ELSE 'train' END AS split FROM clicks")
def leave_one_out(s, d):
    return training.leave_one_out(T.clicks(s, d)).select("event_id", "split")


_UNIT32 = "('0x' || substr(md5(concat_ws('|', {0}, '42')), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query("stratified_negatives", f"""WITH {IX}, tr AS (SELECT * FROM ix WHERE split = 'train'), c AS (SELECT item_id, count(*) AS n FROM tr GROUP BY 1), num AS (SELECT item_id, row_number() OVER (ORDER BY n DESC, item_id) - 1 AS pos FROM c), t AS (SELECT count(*) AS t FROM c),
  tries AS (SELECT user_id, item_id, st.s AS stratum, sl.s AS slot, floor(t * st.s / 5) + floor({_UNIT32.format('user_id, item_id, st.s, sl.s')} * (floor(t * (st.s + 1) / 5) - floor(t * st.s / 5))) AS pos FROM tr, t, range(5) st(s), range(20) sl(s) WHERE label = 1),
  f AS (SELECT tries.user_id, tries.item_id, stratum, num.item_id AS negative, min(slot) AS slot FROM tries JOIN num USING (pos) WHERE NOT EXISTS (SELECT 1 FROM ix WHERE ix.user_id = tries.user_id AND ix.item_id = num.item_id) GROUP BY ALL)
  SELECT user_id, item_id, stratum::INT AS stratum, arg_min(negative, slot) AS negative FROM f GROUP BY 1, 2, 3""")
def stratified_negatives(s, d):
    ix = materialize(T.interactions(s, d).select("user_id", "item_id", "label", "split"), "interactions")
    train = ix.where("split = 'train'")
    return training.stratified_negatives(train.where("label = 1").select("user_id", "item_id"), P.popularity(train), ix)


@query("split_leakage", f"""WITH {CLICKS}, a AS (SELECT 'random' AS scheme, *, CASE WHEN {_UNIT32.format('event_id')} < 0.1 THEN 'test' ELSE 'train' END AS split FROM clicks UNION ALL SELECT 'temporal', *, CASE WHEN ts < (SELECT date_trunc('day', max(ts)) FROM clicks) THEN 'train' ELSE 'test' END FROM clicks),
  u AS (SELECT scheme, count(*) AS k FROM (SELECT scheme, user_id FROM a GROUP BY 1, 2 HAVING count(DISTINCT split) = 2) GROUP BY 1), i AS (SELECT scheme, count(*) AS k FROM (SELECT scheme, item_id FROM a GROUP BY 1, 2 HAVING count(DISTINCT split) = 2) GROUP BY 1),
  n AS (SELECT scheme, user_id, item_id, count(*) AS n FROM a WHERE split = 'train' GROUP BY 1, 2, 3), sc AS (SELECT scheme, (event_type = 'purchase')::INT AS label, coalesce(n, 0) AS score FROM a LEFT JOIN n USING (scheme, user_id, item_id) WHERE split = 'test'),
  r AS (SELECT scheme, label, rank() OVER (PARTITION BY scheme ORDER BY score) + (count(*) OVER (PARTITION BY scheme, score) - 1) / 2.0::DOUBLE AS r FROM sc),
  m AS (SELECT scheme, (sum(r) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label)::DOUBLE * (count(*) - sum(label))) AS auc FROM r GROUP BY 1)
  SELECT scheme, count(*) FILTER (WHERE split = 'test') AS n_test, any_value(u.k) AS shared_users, any_value(i.k) AS shared_items, round(any_value(auc), 6) AS auc FROM a JOIN u USING (scheme) JOIN i USING (scheme) JOIN m USING (scheme) GROUP BY 1""")
def split_leakage(s, d):
    """What each way to split shares between its sides, and one metric under both: purchases ranked by the user's earlier events of the item."""
    log = T.clicks(s, d)
    frames = {"random": training.random_split(log, 0.1, [F.col("event_id")]), "temporal": training.temporal_split(log)}
    scored = reduce(lambda a, b: a.unionByName(b), [f.select(F.lit(n).alias("scheme"), "user_id", "item_id", "event_type", "split") for n, f in frames.items()])
    seen = scored.where("split = 'train'").groupBy("scheme", "user_id", "item_id").agg(F.count(F.lit(1)).alias("n"))
    test = scored.where("split = 'test'").join(seen, ["scheme", "user_id", "item_id"], "left").select("scheme", (F.col("event_type") == "purchase").cast("int").alias("label"), F.coalesce("n", F.lit(0)).cast("double").alias("score"))
    return rounded(training.split_overlap(frames).join(metrics.auc(materialize(test, "scored"), ["scheme"]), "scheme"))


# --- scorers: all over the rows of the test split


def _test(s, d):
    return T.interactions(s, d).where("split = 'test'").select("user_id", "item_id", "label")


def _asked(s, d):
    """The test rows, written: they are counted before they are scored."""
    return materialize(_test(s, d), "asked")


def _train(s, d):
    return T.interactions(s, d).where("split = 'train'").select("user_id", "item_id", "label")


_POP = f"""{IX}, te AS (SELECT user_id, item_id, label FROM ix WHERE split = 'test'), tr AS (SELECT * FROM ix WHERE split = 'train'), {META},
  g AS (SELECT item_id, count(*) AS n FROM tr GROUP BY 1), p AS (SELECT item_id, count(*) AS n FROM tr WHERE label = 1 GROUP BY 1), k AS (SELECT category, count(*) AS n FROM tr JOIN meta USING (item_id) WHERE label = 1 GROUP BY 1),
  s_random AS (SELECT *, {_UNIT32.format('user_id, item_id')} AS score FROM te), s_global_pop AS (SELECT te.*, ln(1 + coalesce(n, 0)) AS score FROM te LEFT JOIN g USING (item_id)),
  s_positive_pop AS (SELECT te.*, ln(1 + coalesce(n, 0)) AS score FROM te LEFT JOIN p USING (item_id)), s_category_pop AS (SELECT te.*, ln(1 + coalesce(n, 0)) AS score FROM te LEFT JOIN meta USING (item_id) LEFT JOIN k USING (category))"""


def _scored(df):
    return rounded(df.select("user_id", "item_id", "label", "score"))


@query("score_random", f"WITH {_POP} SELECT user_id, item_id, label, round(score, 6) AS score FROM s_random")
def score_random(s, d):
    return _scored(scorers.score_random(_test(s, d)))


@query("score_global_pop", f"WITH {_POP} SELECT user_id, item_id, label, round(score, 6) AS score FROM s_global_pop")
def score_global_pop(s, d):
    return _scored(scorers.score_global_pop(_test(s, d), _train(s, d)))


@query("score_positive_pop", f"WITH {_POP} SELECT user_id, item_id, label, round(score, 6) AS score FROM s_positive_pop")
def score_positive_pop(s, d):
    return _scored(scorers.score_positive_pop(_test(s, d), _train(s, d)))


@query("score_category_pop", f"WITH {_POP} SELECT user_id, item_id, label, round(score, 6) AS score FROM s_category_pop")
def score_category_pop(s, d):
    return _scored(scorers.score_category_pop(_test(s, d), _train(s, d), T.item_features(s, d)))


@query("pop_with_category", f"WITH {_POP} SELECT user_id, item_id, label, round(a.score + 0.5 * b.score, 6) AS score FROM s_positive_pop a JOIN s_category_pop b USING (user_id, item_id, label)")
def pop_with_category(s, d):
    return _scored(scorers.pop_with_category(_test(s, d), _train(s, d), T.item_features(s, d)))


#: Similarities of the test rows with the last 200 train items.
_REC = """rec AS (SELECT user_id, item_id AS history_item, row_number() OVER (PARTITION BY user_id ORDER BY r DESC) - 1 AS pos FROM ranked WHERE r <= 200),
  sims AS (SELECT te.user_id, te.item_id, rec.pos, rec.history_item, b.vec AS hv, coalesce(list_inner_product(a.vec, b.vec), 0) AS sim FROM te JOIN rec USING (user_id) LEFT JOIN unit a ON a.item_id = te.item_id LEFT JOIN unit b ON b.item_id = rec.history_item)"""
_SIMS = f"{IX}, te AS (SELECT user_id, item_id, label FROM ix WHERE split = 'test'), {RANKED}, {UNIT}, {_REC}"


@query("score_content_knn", f"WITH {_SIMS}, m AS (SELECT user_id, item_id, max(sim) AS score FROM sims GROUP BY 1, 2) SELECT user_id, item_id, label, round(coalesce(score, -1e9), 6) AS score FROM te LEFT JOIN m USING (user_id, item_id)")
def score_content_knn(s, d):
    got = scorers.score_content_knn(_asked(s, d), histories(s, d), T.item_vectors(s, d))
    return _scored(got.withColumn("score", F.greatest("score", F.lit(-1e9))))


@query("score_content_knn_mean", f"WITH {_SIMS}, m AS (SELECT user_id, item_id, avg(sim) AS score FROM sims GROUP BY 1, 2) SELECT user_id, item_id, label, round(coalesce(score, -1e9), 6) AS score FROM te LEFT JOIN m USING (user_id, item_id)")
def score_content_knn_mean(s, d):
    got = scorers.score_content_knn(_asked(s, d), histories(s, d), T.item_vectors(s, d), how="mean")
    return _scored(got.withColumn("score", F.greatest("score", F.lit(-1e9))))


_POOLED_LAST = _POOL.format(name="pp", mean="avg(vec[i])", slice="h[-200:]", vec="vec") + ", pooled AS (SELECT user_id, list(x ORDER BY i) AS v FROM pp GROUP BY 1)"
_POOLED_COSINE = "coalesce(list_inner_product(v, vec) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(vec, vec))), 0)"


@query("score_pooled_cosine", f"""WITH {IX}, te AS (SELECT user_id, item_id, label FROM ix WHERE split = 'test'), {HIST}, {UNIT}, {_POOLED_LAST}
  SELECT user_id, item_id, label, round({_POOLED_COSINE}, 6) AS score FROM te LEFT JOIN pooled USING (user_id) LEFT JOIN vec USING (item_id)""")
def score_pooled_cosine(s, d):
    v = T.item_vectors(s, d)
    return _scored(scorers.score_pooled_cosine(_test(s, d), sequences.pooled(histories(s, d), v), v))


@query("history_search", f"WITH {_SIMS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY round(sim, 9) DESC, pos) AS rank FROM sims WHERE hv IS NOT NULL) SELECT user_id, item_id, pos::INT AS pos, history_item, round(sim, 6) AS sim, rank::INT AS rank FROM r WHERE rank <= 3")
def history_search(s, d):
    return rounded(scorers.history_search(_asked(s, d), histories(s, d), T.item_vectors(s, d), 3))


_ATTENTION = """w AS (SELECT *, exp((sim - max(sim) OVER (PARTITION BY user_id, item_id)) * 8) AS w FROM sims WHERE hv IS NOT NULL),
  att AS (SELECT user_id, item_id, i, sum(w * hv[i]) / sum(w) AS x FROM w, range(1, 65) t(i) GROUP BY 1, 2, 3), vecs AS (SELECT user_id, item_id, list(x ORDER BY i) AS v FROM att GROUP BY 1, 2)"""


@query("target_attention", f"WITH {_SIMS}, {_ATTENTION} SELECT te.user_id, te.item_id, list_transform(coalesce(v, list_transform(range(64), lambda i: 0.0::DOUBLE)), lambda x: round(x, 6) + 0.0::DOUBLE) AS vec FROM te LEFT JOIN vecs USING (user_id, item_id)")
def target_attention(s, d):
    got = scorers.target_attention(_asked(s, d), histories(s, d), T.item_vectors(s, d))
    zero = F.array_repeat(F.lit(0.0), DIM)
    return got.select("user_id", "item_id", F.transform(F.when(F.size("vec") == DIM, F.col("vec")).otherwise(zero), lambda x: F.round(x, 6)).alias("vec"))


_SEARCHED = f"""{_SIMS}, top AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY round(sim, 9) DESC, pos) AS r FROM sims WHERE hv IS NOT NULL), w AS (SELECT *, exp((sim - max(sim) OVER (PARTITION BY user_id, item_id)) * 8) AS w FROM top WHERE r <= 5),
  ma AS (SELECT user_id, item_id, sum(w * sim) / sum(w) AS score FROM w GROUP BY 1, 2)"""


@query("search_attention", f"WITH {_SEARCHED} SELECT user_id, item_id, label, round(coalesce(score, 0), 6) AS score FROM te LEFT JOIN ma USING (user_id, item_id)")
def search_attention(s, d):
    """Two stages: the five history items most like the candidate, then attention over these alone."""
    ix, h = _written(s, d)
    te, v = _side(ix, "test"), _items(s, d)
    got = scorers.target_attention(te, h, v, k=5).withColumnRenamed("vec", "a").join(v, "item_id", "left")
    score = F.when(F.size("a") == F.size("vec"), dot(F.col("a"), F.col("vec")))
    return _scored(got.select("user_id", "item_id", F.coalesce(score, F.lit(0.0)).alias("score")).join(te, ["user_id", "item_id"]))


def _written(s, d):
    """Interactions and histories, written once: every scorer reads them."""
    return materialize(T.interactions(s, d).select("user_id", "item_id", "label", "split"), "interactions"), materialize(histories(s, d), "histories")


def _side(ix, split):
    return ix.where(F.col("split") == split).select("user_id", "item_id", "label")


def _wide_scores(s, d):
    """All scorers over the test rows, a column a scorer, written once: the metrics read them several times."""
    ix, h = _written(s, d)
    wide = scorers.score_wide(_side(ix, "test"), _side(ix, "train"), T.item_features(s, d), h, T.item_vectors(s, d))
    return materialize(wide.select("user_id", "item_id", "label", *[_ninth(m) for m in _MODELS]), "scores")


def _ninth(model):
    return (F.rint(F.col(model) * 1e9) / 1e9 + F.lit(0.0)).alias(model)  # round goes through decimals


def _all_scores(s, d):
    """The same with a row a scorer, made as it is read."""
    return scorers.long_scores(_wide_scores(s, d))


_MODELS = scorers.TOGETHER
_ALL = f"""{_POP}, {RANKED}, {UNIT}, {_REC}, {_HIST}, {_POOLED_LAST}, mk AS (SELECT user_id, item_id, max(sim) AS score, avg(sim) AS mean FROM sims GROUP BY 1, 2),
  wa AS (SELECT *, exp((sim - max(sim) OVER (PARTITION BY user_id, item_id)) * 8) AS w FROM sims WHERE hv IS NOT NULL), ma AS (SELECT user_id, item_id, sum(w * sim) / sum(w) AS score FROM wa GROUP BY 1, 2),
  s_content_knn AS (SELECT te.*, coalesce(mk.score, -1e9) AS score FROM te LEFT JOIN mk USING (user_id, item_id)), s_content_knn_mean AS (SELECT te.*, coalesce(mk.mean, -1e9) AS score FROM te LEFT JOIN mk USING (user_id, item_id)),
  s_attention AS (SELECT te.*, coalesce(ma.score, 0) AS score FROM te LEFT JOIN ma USING (user_id, item_id)), s_pop_with_category AS (SELECT user_id, item_id, label, a.score + 0.5 * b.score AS score FROM s_positive_pop a JOIN s_category_pop b USING (user_id, item_id, label)),
  s_pooled_cosine AS (SELECT te.*, {_POOLED_COSINE} AS score FROM te LEFT JOIN pooled USING (user_id) LEFT JOIN vec USING (item_id)),
  sc AS (""" + " UNION ALL ".join(f"SELECT '{m}' AS model, user_id, item_id, label, round(score, 9) AS score FROM s_{m}" for m in _MODELS) + ")"


@query("score_all", f"WITH {_ALL} SELECT model, user_id, item_id, label, round(score + 1e-10, 6) AS score FROM sc")
def score_all(s, d):
    return rounded(_all_scores(s, d).withColumn("score", F.col("score") + 1e-10))  # no ninth digit makes a tie of the sixth


# --- metrics

_RANKS = "rk AS (SELECT *, row_number() OVER (PARTITION BY model, user_id ORDER BY score DESC, md5(concat_ws('|', user_id, item_id, '42'))) AS r FROM sc)"
_KS = (1, 3, 5, 10)
_PER_USER = f"""{_RANKS}, pu AS (SELECT model, user_id, sum(label) AS p, min(r) FILTER (WHERE label = 1) AS f, {', '.join(f'sum(CASE WHEN label = 1 AND r <= {k} THEN 1 / log2(r + 1) ELSE 0 END) AS d{k}' for k in _KS)} FROM rk GROUP BY 1, 2),
  id AS (SELECT n, {', '.join(f'list_sum(list_transform(range(1, least(n, {k}) + 1), lambda i: 1 / log2(i + 1))) AS i{k}' for k in _KS)} FROM range(1, 2000) t(n)),
  rank_m AS (SELECT model, count(*) AS n_users, {', '.join(f'avg((f <= {k})::INT) AS hr_{k}, avg(d{k} / i{k}) AS ndcg_{k}' for k in _KS)}, avg(1.0::DOUBLE / f) AS mrr FROM pu JOIN id ON id.n = pu.p GROUP BY 1)"""
_RANK_COLS = ", ".join([f"round(hr_{k}, 6) AS hr_{k}" for k in _KS] + [f"round(ndcg_{k}, 6) AS ndcg_{k}" for k in _KS] + ["round(mrr, 6) AS mrr"])
_AUC = """ar AS (SELECT model, label, rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0::DOUBLE AS r FROM sc),
  auc_m AS (SELECT model, (sum(r) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label)::DOUBLE * (count(*) - sum(label))) AS auc FROM ar GROUP BY 1)"""
_LOSS = """ll AS (SELECT model, label, 1 / (1 + exp(-greatest(-60, least(60, score)))) AS q FROM sc), loss_m AS (SELECT model, avg(-(label * ln(q + 1e-9) + (1 - label) * ln(1 - q + 1e-9))) AS logloss FROM ll GROUP BY 1)"""
_PR = """pc AS (SELECT model, score, count(*) AS n, sum(label) AS p FROM sc GROUP BY 1, 2), pr AS (SELECT model, p, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM pc WINDOW w AS (PARTITION BY model ORDER BY score DESC)),
  pr_m AS (SELECT model, sum(p * cp / cn::DOUBLE) / sum(p) AS pr_auc FROM pr GROUP BY 1)"""
_GAUC = """gr AS (SELECT model, user_id, label, rank() OVER (PARTITION BY model, user_id ORDER BY score) + (count(*) OVER (PARTITION BY model, user_id, score) - 1) / 2.0::DOUBLE AS r FROM sc),
  gu AS (SELECT model, user_id, count(*) AS w, sum(label) AS p, sum(r) FILTER (WHERE label = 1) AS s FROM gr GROUP BY 1, 2), gauc_m AS (SELECT model, count(*) AS n, sum(w * round((s - p * (p + 1) / 2.0::DOUBLE) / (p * (w - p)), 5)) / sum(w) AS gauc FROM gu WHERE p > 0 AND w > p GROUP BY 1)"""


@query("per_user_ranking", f"WITH {_ALL}, {_PER_USER} SELECT model, n_users, {_RANK_COLS} FROM rank_m")
def per_user_ranking(s, d):
    return rounded(metrics.per_user_ranking(_all_scores(s, d), by=["model"]))


@query("auc", f"WITH {_ALL}, {_AUC} SELECT model, round(auc, 6) AS auc FROM auc_m")
def auc(s, d):
    return rounded(metrics.auc(_all_scores(s, d), ["model"]))


@query("logloss", f"WITH {_ALL}, {_LOSS} SELECT model, round(logloss, 6) AS logloss FROM loss_m")
def logloss(s, d):
    return rounded(metrics.logloss(_all_scores(s, d), ["model"]))


@query("pr_auc", f"WITH {_ALL}, {_PR} SELECT model, round(pr_auc, 6) AS pr_auc FROM pr_m")
def pr_auc(s, d):
    return rounded(metrics.pr_auc(_all_scores(s, d), ["model"]))


@query("gauc", f"WITH {_ALL}, {_GAUC} SELECT model, n AS n_users, round(gauc, 6) AS gauc FROM gauc_m")
def gauc(s, d):
    return rounded(metrics.gauc(_all_scores(s, d), ["model"]))


@query("candidate_set_size", f"WITH {_ALL}, u AS (SELECT model, user_id, count(*) AS n, sum(label) AS p FROM sc GROUP BY 1, 2) SELECT model, count(*) AS n_users, count(*) FILTER (WHERE p > 0) AS n_scored, round(avg(n), 6) AS rows_per_user FROM u GROUP BY 1")
def candidate_set_size(s, d):
    return rounded(metrics.candidate_set_size(_all_scores(s, d), ["model"]))


_EVAL = f"""{_ALL}, {_PER_USER}, {_AUC}, {_LOSS}, {_PR}, {_GAUC}, size_m AS (SELECT model, avg(n) AS rows_per_user FROM (SELECT model, user_id, count(*) AS n FROM sc GROUP BY 1, 2) GROUP BY 1)"""


@query("evaluate_table", f"""WITH {_EVAL} SELECT model, n_users, {_RANK_COLS}, round(auc, 6) AS auc, round(logloss, 6) AS logloss, round(pr_auc, 6) AS pr_auc, round(gauc, 6) AS gauc, round(rows_per_user, 6) AS rows_per_user
  FROM rank_m JOIN auc_m USING (model) JOIN loss_m USING (model) JOIN pr_m USING (model) JOIN gauc_m USING (model) JOIN size_m USING (model)""")
def evaluate_table(s, d):
    return rounded(_evaluated(_wide_scores(s, d), _MODELS))


def _evaluated(wide, models):
    """All metrics of the columns of ``wide``: rows go to their users before they become a row a model."""
    return metrics.evaluate_table(scorers.long_scores(wide, models), by_user=scorers.long_scores(wide.repartition("user_id"), models))


_SIZED = "sz AS (SELECT model, round(avg(n), 6) AS size FROM (SELECT model, user_id, count(*) AS n FROM sc GROUP BY 1, 2) GROUP BY 1)"


@query("compare_guard", f"WITH {_ALL}, {_AUC}, {_SIZED} SELECT model, round(auc, 6) AS auc, (row_number() OVER (ORDER BY round(auc, 6) DESC, model))::INT AS place, (SELECT count(DISTINCT size) = 1 FROM sz) AS comparable FROM auc_m")
def compare_guard(s, d):
    return _guarded(_all_scores(s, d))


@query("compare_guard_unequal", f"WITH {_ALL.replace('sc AS (', 'sc0 AS (')}, sc AS (SELECT * FROM sc0 WHERE model <> 'random' OR item_id IN (SELECT vec_id FROM embeddings)), {_AUC}, {_SIZED} SELECT model, round(auc, 6) AS auc, (row_number() OVER (ORDER BY round(auc, 6) DESC, model))::INT AS place, (SELECT count(DISTINCT size) = 1 FROM sz) AS comparable FROM auc_m")
def compare_guard_unequal(s, d):
    """One model scores only items with a vector: its candidate sets are smaller, and the comparison is refused."""
    scored, known = _all_scores(s, d), T.item_vectors(s, d).select("item_id")
    fewer = scored.where("model = 'random'").join(known, "item_id", "left_semi").select(*scored.columns)
    return _guarded(scored.where("model <> 'random'").unionByName(fewer))


def _guarded(scored):
    table = rounded(metrics.auc(scored, ["model"])).join(rounded(metrics.candidate_set_size(scored, ["model"])).select("model", "rows_per_user"), "model")
    return metrics.compare_guard(table, "auc")


@query("random_reference", "SELECT k::INT AS k, (SELECT count(*) FROM embeddings) AS n_items, round(k / (SELECT count(*) FROM embeddings), 6) AS expected_recall FROM (VALUES (10), (50), (100)) t(k)")
def random_reference(s, d):
    return rounded(metrics.random_reference(T.item_vectors(s, d), (10, 50, 100)))


# --- retrieval: users are their pooled unit vectors, items the unit vectors


def _users(s, d, targets=None, newest=1000):
    """All users by the items of their histories, or those of ``targets`` where nobody else's lists are read."""
    rows = train_purchases(s, d)
    rows = rows if targets is None else rows.join(targets.select("user_id").distinct(), "user_id", "left_semi")
    return sequences.unit_directions(sequences.newest_rows(rows, ["ts", "order_id", "line", "item_id"], newest), T.item_vectors(s, d))


def _recent(s, d, targets=None):
    """Users by their last ten items."""
    return _users(s, d, targets, 10)


def _items(s, d):
    return retrieval.normalise(T.item_vectors(s, d), "item_id")


_SPACE = f"{HIST}, {UNIT}, " + _POOL.format(name="pz", mean="sum(vec[i]) / max(n)", slice="h", vec="vec") + """, pl AS (SELECT user_id, list(x ORDER BY i) AS v FROM pz GROUP BY 1),
  us AS (SELECT user_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM pl)"""
_TOP = _SPACE + """, tk AS (SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM (SELECT user_id, item_id, list_inner_product(v, vec) AS score FROM us, unit))"""


_RECENT = _POOL.format(name="py", mean="sum(vec[i]) / max(n)", slice="h[-10:]", vec="vec") + """, ql AS (SELECT user_id, list(x ORDER BY i) AS v FROM py GROUP BY 1),
  ur AS (SELECT user_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM ql),
  tr_ AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM (SELECT user_id, item_id, list_inner_product(v, vec) AS score FROM ur, unit))"""


@query("exact_topk", f"WITH {_TOP} SELECT user_id, item_id, round(score, 6) AS score, rank::INT AS rank FROM tk WHERE rank <= 10")
def exact_topk(s, d):
    return rounded(retrieval.exact_topk(_users(s, d), _items(s, d), 10))


def _spaces(s, d):
    """Users and items, written: an index reads them several times."""
    return materialize(_users(s, d), "users"), materialize(_items(s, d), "items")


#: Cells looked into of 16 and length of the short list; tables and probes of each.
IVF, LSH = (12, 60), (28, 3)


@query("ivf_topk")
def ivf_topk(s, d):
    return rounded(indices.ivf_topk(*_spaces(s, d), 10, nprobe=IVF[0], short=IVF[1]))


@query("lsh_topk")
def lsh_topk(s, d):
    return rounded(indices.lsh_topk(*_spaces(s, d), 10, DIM, *LSH))


@query("ann_recall_sweep")
def ann_recall_sweep(s, d):
    """``index, effort, probes, recall, scored_share``: recall at 10 of each index, and the share of all pairs that it needs whole products of. Effort is
    the length of the short list, or the number of tables."""
    users, items = _spaces(s, d)
    pairs = users.agg(F.count(F.lit(1)).alias("u")).crossJoin(items.agg(F.count(F.lit(1)).alias("i"))).select((F.col("u") * F.col("i")).alias("pairs"))
    ivf, lsh = [(4, IVF[1]), (IVF[0], 20), IVF], [(4, LSH[1]), LSH]
    swept = indices.recall_sweep(users, items, indices.build_product_index(items), 10, DIM, ivf, lsh)
    names = [("ivf", short, nprobe) for nprobe, short in ivf] + [("lsh", tables, probes) for tables, probes in lsh]
    named = F.array(*[F.struct(F.lit(kind).alias("index"), F.lit(effort).alias("effort"), F.lit(probes).alias("probes")) for kind, effort, probes in names])
    return rounded(swept.crossJoin(pairs).select(F.get(named, F.col("at")).alias("n"), "recall", (F.col("n_scored") / F.col("pairs")).alias("scored_share")).select("n.*", "recall", "scored_share"))


@query("catalogue_topn", f"WITH {IX} SELECT item_id, count(*) AS n FROM ix WHERE split = 'train' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100")
def catalogue_topn(s, d):
    return retrieval.catalogue_topn(_train(s, d), 100)


@query("catalogue_category", f"WITH {IX} SELECT DISTINCT item_id, coalesce(p_brand, 'unknown') AS category FROM ix LEFT JOIN part ON p_partkey = item_id")
def catalogue_category(s, d):
    meta = T.item_features(s, d).withColumn("row", F.col("item_id"))
    return retrieval.catalogue_category(joins.catalogue_union(T.interactions(s, d)), meta)


@query("retrieval_targets", f"WITH {IX} SELECT user_id, item_id AS target FROM (SELECT user_id, item_id FROM ix WHERE split = 'test' AND label = 1 ORDER BY md5(concat_ws('|', user_id, item_id, '42')), user_id, item_id LIMIT 500)")
def retrieval_targets(s, d):
    return _some_targets(s, d)


def _targets(s, d):
    """Every clicked test row."""
    return _test(s, d).where("label = 1").select("user_id", F.col("item_id").alias("target"))


def _some_targets(s, d):
    """The 500 of them that the SQL of some queries names."""
    return io.uniform_sample(_targets(s, d), 500, F.col("user_id"), F.col("target"))


_ALL_TARGETS = "tg AS (SELECT user_id, item_id AS target FROM ix WHERE split = 'test' AND label = 1)"
_TARGETS = "tg AS (SELECT user_id, item_id AS target FROM (SELECT user_id, item_id FROM ix WHERE split = 'test' AND label = 1 ORDER BY md5(concat_ws('|', user_id, item_id, '42')), user_id, item_id LIMIT 500))"


@query("sample_catalogue", "SELECT vec_id AS item_id FROM embeddings ORDER BY md5(concat_ws('|', vec_id, '42')), vec_id LIMIT 50")
def sample_catalogue(s, d):
    return retrieval.sample_catalogue(T.item_vectors(s, d), 50)


@query("recommend", f"""WITH {_TOP}, f AS (SELECT * FROM tk WHERE rank <= 40 AND NOT EXISTS (SELECT 1 FROM buy b WHERE b.ts < TIMESTAMP '2000-07-01' AND b.user_id = tk.user_id AND b.item_id = tk.item_id)),
  r AS (SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM f) SELECT user_id, item_id, round(score, 5) AS score, rank::INT AS rank FROM r WHERE rank <= 10""")
def recommend(s, d):
    return retrieval.recommend(_users(s, d), _items(s, d), train_purchases(s, d), 10)


@query("cold_start", f"""WITH {HIST}, {IX}, b AS (SELECT item_id, row_number() OVER (ORDER BY count(*) DESC, item_id) AS rank FROM ix WHERE split = 'train' GROUP BY 1 ORDER BY 2 LIMIT 10)
  SELECT c_custkey AS user_id, item_id, 0.0::DOUBLE AS score, rank::INT AS rank, true AS cold FROM customer, b WHERE c_custkey NOT IN (SELECT user_id FROM hist)""")
def cold_start(s, d):
    people = T.load(s, d, "customer", "c_custkey").select(F.col("c_custkey").alias("user_id"))
    cold = people.join(histories(s, d), "user_id", "left_anti")
    return retrieval.cold_start(cold, P.popularity(_train(s, d)), 10)


_COLD = """b AS (SELECT item_id, row_number() OVER (ORDER BY count(*) DESC, item_id) AS rank FROM ix WHERE split = 'train' GROUP BY 1 ORDER BY 2 LIMIT 10)"""


@query("serve", f"""WITH {IX}, {_TOP}, {_COLD}, f AS (SELECT * FROM tk WHERE rank <= 40 AND NOT EXISTS (SELECT 1 FROM buy b WHERE b.ts < TIMESTAMP '2000-07-01' AND b.user_id = tk.user_id AND b.item_id = tk.item_id)),
  r AS (SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM f)
  SELECT user_id, item_id, round(score, 5) AS score, rank::INT AS rank, false AS cold FROM r WHERE rank <= 10
  UNION ALL SELECT c_custkey, item_id, 0.0, rank::INT, true FROM customer, b WHERE c_custkey NOT IN (SELECT user_id FROM us)""")
def serve(s, d):
    people = T.load(s, d, "customer", "c_custkey").select(F.col("c_custkey").alias("user_id"))
    users = materialize(_users(s, d), "users")
    return retrieval.serve(people, users, _items(s, d), train_purchases(s, d), P.popularity(_train(s, d)), 10)


@query("heldout_hits", f"""WITH {IX}, {_TOP}, {_RECENT}, {_ALL_TARGETS}, h AS (SELECT coalesce(a.rank <= 10, false)::INT AS a, coalesce(c.rank <= 10, false)::INT AS b FROM tg LEFT JOIN (SELECT user_id, item_id AS target, rank FROM tr_ WHERE rank <= 10) a USING (user_id, target) LEFT JOIN (SELECT user_id, item_id AS target, rank FROM tk WHERE rank <= 10) c USING (user_id, target))
  SELECT count(*) AS n_targets, round(avg(a), 6) AS hit_rate, round(avg(b), 6) AS baseline_rate, round(10 / (SELECT count(*) FROM embeddings), 6) AS random_rate, avg(a) > 100 / (SELECT count(*) FROM embeddings) AS beats_random, avg(a) >= 0.8 * avg(b) AS holds_baseline FROM h""")
def heldout_hits(s, d):
    """Lists by the last ten items, held against the training-free lists by the whole history, over every clicked test row."""
    items, targets = materialize(_items(s, d), "items"), materialize(_targets(s, d), "targets")
    served, free = retrieval.exact_topk(_recent(s, d, targets), items, 10), retrieval.exact_topk(_users(s, d, targets), items, 10)
    return rounded(retrieval.heldout_hits(served, free, targets, items.count(), 10))


@query("recall_from_topk", f"""WITH {IX}, {_TOP}, {_TARGETS}, h AS (SELECT rank FROM tg LEFT JOIN (SELECT user_id, item_id AS target, rank FROM tk WHERE rank <= 100) USING (user_id, target)) SELECT count(*) AS n_targets,
  {', '.join(f'round(avg(coalesce(rank <= {k}, false)::INT), 6) AS recall_{k}, round(avg(CASE WHEN rank <= {k} THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS ndcg_{k}' for k in (10, 50, 100))} FROM h""")
def recall_from_topk(s, d):
    targets = materialize(_some_targets(s, d), "targets")
    lists = retrieval.exact_topk(_users(s, d, targets), _items(s, d), 100)
    return rounded(metrics.recall_from_topk(lists, targets, (10, 50, 100, 500), 100))


@query("recall_full_matrix", f"""WITH {IX}, {_TOP}, {_TARGETS}, h AS (SELECT rank FROM tg LEFT JOIN (SELECT user_id, item_id AS target, rank FROM tk) USING (user_id, target)) SELECT count(*) AS n_targets,
  round(avg(coalesce(rank <= 20, false)::INT), 6) AS recall_20, round(avg(CASE WHEN rank <= 20 THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS ndcg_20 FROM h""")
def recall_full_matrix(s, d):
    targets = materialize(_some_targets(s, d), "targets")
    return rounded(retrieval.recall_full_matrix(_users(s, d, targets), _items(s, d), targets, (20,)))


def _recall_sql(space: str, lists: str, users: str) -> str:
    return f"""SELECT '{space}' AS space, count(*) AS n_targets, round(avg(coalesce(rank <= 10, false)::INT), 6) AS recall_10, round(avg(coalesce(rank <= 50, false)::INT), 6) AS recall_50, round(avg((u.user_id IS NOT NULL AND e.vec_id IS NOT NULL)::INT), 6) AS coverage
  FROM tg LEFT JOIN (SELECT user_id, item_id AS target, rank FROM {lists} WHERE rank <= 50) USING (user_id, target) LEFT JOIN (SELECT user_id FROM {users}) u USING (user_id) LEFT JOIN (SELECT vec_id FROM embeddings) e ON e.vec_id = target"""


@query("full_catalogue_recall", f"WITH {IX}, {_TOP}, {_RECENT}, {_TARGETS} {_recall_sql('pooled', 'tk', 'us')} UNION ALL {_recall_sql('recent', 'tr_', 'ur')}")
def full_catalogue_recall(s, d):
    """Recall over the whole catalogue in two query spaces, and the share of targets that each can reach at all."""
    targets, items = materialize(_some_targets(s, d), "targets"), materialize(_items(s, d), "items")
    return rounded(reduce(lambda a, b: a.unionByName(b), [_recall(n, u, items, targets) for n, u in (("pooled", _users(s, d, targets)), ("recent", _recent(s, d, targets)))]))


def _recall(space, users, items, targets):
    users = materialize(users, "queries")
    known = targets.join(users.select("user_id", F.lit(1).alias("u")), "user_id", "left").join(items.select(F.col("item_id").alias("target"), F.lit(1).alias("i")).distinct(), "target", "left")
    coverage = known.agg(F.avg((F.col("u").isNotNull() & F.col("i").isNotNull()).cast("double")).alias("coverage"))
    got = metrics.recall_from_topk(retrieval.exact_topk(users, items, 50), targets, (10, 50), 50)
    return got.select(F.lit(space).alias("space"), "n_targets", "recall_10", "recall_50").crossJoin(coverage)


def _clicked_pairs(s, d):
    """``user_id, item_id, u, v, log_q`` of clicked train rows: the user's mean unit vector without the item itself, the item's, and the log
    of its share of clicks."""
    ix, h = _written(s, d)
    clicked, v = ix.where("split = 'train' AND label = 1"), T.item_vectors(s, d)
    rows = clicked.select("user_id", "item_id").join(v.select("item_id"), "item_id", "left_semi").join(training.log_q(clicked), "item_id")
    return scorers.leave_one_out_means(rows, h, v, 1000, clicked)


@query("retrieval_towers")
def retrieval_towers(s, d):
    """Item vectors of the towers learned from clicks by a sampled softmax over each batch."""
    model = towers.fit_towers(_clicked_pairs(s, d))
    return model.project(_items(s, d), "item_id", "item").select("item_id", F.transform("vec", lambda x: F.round(x, 4)).alias("vec"))


@query("retrieval_ablation")
def retrieval_ablation(s, d):
    """Recall of every clicked test row in each vector space: content, factors of clicks, and towers."""
    ix = T.interactions(s, d).where("split = 'train' AND label = 1").select("user_id", "item_id", "label")
    model = scorers.fit_retrieval_factors(ix)
    users = model.userFactors.select(F.col("id").cast("bigint").alias("user_id"), F.col("features").cast("array<double>").alias("vec"))
    items = model.itemFactors.select(F.col("id").cast("bigint").alias("item_id"), F.col("features").cast("array<double>").alias("vec"))
    targets = materialize(_targets(s, d), "targets")
    content = materialize(_users(s, d, targets), "users"), materialize(_items(s, d), "items")
    learned = towers.fit_towers(_clicked_pairs(s, d))
    spaces = {"pooled": content, "factors": (users.join(targets.select("user_id").distinct(), "user_id", "left_semi"), items), "towers": (learned.project(content[0], "user_id", "user"), learned.project(content[1], "item_id", "item"))}
    parts = [metrics.recall_from_topk(retrieval.exact_topk(u, i, 50), targets, (10, 50), 50).withColumn("space", F.lit(n)) for n, (u, i) in spaces.items()]
    return rounded(reduce(lambda a, b: a.unionByName(b), parts))


@query("space_check", """SELECT space, max(q) AS n_queries, max(i) AS n_index, max(q) > 0 AND max(i) > 0 AS usable FROM (SELECT 'v' || n_regionkey AS space, count(*) AS i, 0 AS q FROM nation GROUP BY 1
  UNION ALL SELECT 'v' || c_nationkey, 0, count(*) FROM customer GROUP BY 1) GROUP BY 1""")
def space_check(s, d):
    """The five regions as versions of an index, the customers' nations as those of queries."""
    tag = lambda df, c: df.select(F.concat(F.lit("v"), F.col(c).cast("string")).alias("space"))
    return retrieval.space_check(tag(T.load(s, d, "customer", "c_nationkey"), "c_nationkey"), tag(T.load(s, d, "nation", "n_regionkey"), "n_regionkey"))


@query("table_manifest", """SELECT 'part' AS "table", count(*) AS n_rows, 3 AS n_columns, sum(('0x' || substr(md5(concat_ws('|', p_partkey, p_brand, p_size)), 1, 8))::BIGINT)::VARCHAR AS checksum FROM part""")
def table_manifest(s, d):
    return retrieval.table_manifest("part", T.load(s, d, "part", "p_partkey", "p_brand", "p_size"))


# --- learned scorers


def _features(s, d):
    """One row a candidate. A train row is left out of the counts and of the history that it is scored by, as it was part of them. Interactions are written once and
    counted from there; the counts go through the stream of histories with their rows, which aren't joined to its result afterwards."""
    ix, meta = T.interactions(s, d).select("user_id", "item_id", "label", "split"), T.item_features(s, d)
    rows = materialize(ix.withColumn("own", F.col("split") == "train"), "candidates")
    log_count = lambda n, own: F.log1p((F.coalesce(n, F.lit(0)) - own).cast("double"))
    is_own = F.col("own").cast("int")
    n = rows.where("own").groupBy("item_id").agg(F.count(F.lit(1)).alias("__n"), F.count_if(F.col("label") == 1).alias("__p"))
    cats = meta.select("item_id", "category")
    k = n.join(cats, "item_id").groupBy("category").agg(F.sum("__p").alias("__k"))  # from counts: a row an item
    item = cats.join(k, "category", "left").join(n, "item_id", "full").select("item_id", "__n", "__k")
    counted = rows.join(item, "item_id", "left").select(
        "user_id", "item_id", "label", "own", log_count(F.col("__n"), is_own).alias("global_pop"), log_count(F.col("__k"), is_own * F.col("label")).alias("category_pop")
    )
    likeness = scorers.history_features(counted, histories(s, d), T.item_vectors(s, d), among=rows)
    people = vocab.encode_categoricals(T.demographics(s, d), vocab.small_vocabs(T.demographics(s, d), ["segment"]))
    split = F.when(F.col("own"), "train").otherwise("test").alias("split")
    found = likeness.select("user_id", "item_id", "label", split, "global_pop", "category_pop", "pooled_cosine", "max_similarity", "attention")
    return found.join(people.select("user_id", "nation", "segment_idx", "balance"), "user_id", "left")


_FEATURES = f"""{IX}, te AS (SELECT *, split = 'train' AS own FROM ix), tr AS (SELECT * FROM ix WHERE split = 'train'), {META}, {RANKED}, {UNIT},
  g AS (SELECT item_id, count(*) AS n FROM tr GROUP BY 1), k AS (SELECT category, count(*) AS n FROM tr JOIN meta USING (item_id) WHERE label = 1 GROUP BY 1),
  rec AS (SELECT user_id, item_id AS history_item, row_number() OVER (PARTITION BY user_id ORDER BY r DESC) - 1 AS pos FROM ranked WHERE r <= 200),
  sims AS (SELECT te.user_id, te.item_id, a.vec AS cv, b.vec AS hv, coalesce(list_inner_product(a.vec, b.vec), 0) AS sim FROM te JOIN rec USING (user_id) LEFT JOIN unit a ON a.item_id = te.item_id JOIN unit b ON b.item_id = rec.history_item WHERE NOT (own AND history_item = te.item_id)),
  w AS (SELECT *, exp((sim - max(sim) OVER (PARTITION BY user_id, item_id)) * 8) AS w FROM sims), d AS (SELECT user_id, item_id, i, any_value(cv[i]) AS c, sum(hv[i]) AS p FROM w, range(1, 65) t(i) GROUP BY 1, 2, 3),
  c AS (SELECT user_id, item_id, sum(c * p) / nullif(sqrt(sum(c * c)) * sqrt(sum(p * p)), 0) AS pooled_cosine FROM d GROUP BY 1, 2),
  m AS (SELECT user_id, item_id, max(sim) AS max_similarity, sum(w * sim) / sum(w) AS attention FROM w GROUP BY 1, 2),
  seg AS (SELECT c_mktsegment AS segment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS segment_idx FROM (SELECT DISTINCT c_mktsegment FROM customer))"""


@query("ranking_features", f"""WITH {_FEATURES} SELECT te.user_id, te.item_id, label, split, round(ln(1 + coalesce(g.n, 0) - own::INT), 6) AS global_pop, round(ln(1 + coalesce(k.n, 0) - own::INT * label), 6) AS category_pop, round(coalesce(pooled_cosine, 0), 6) AS pooled_cosine,
  round(coalesce(max_similarity, 0), 6) AS max_similarity, round(coalesce(attention, 0), 6) AS attention, c_nationkey AS nation, segment_idx, sign(c_acctbal)::INT AS balance
  FROM te LEFT JOIN g USING (item_id) LEFT JOIN meta USING (item_id) LEFT JOIN k USING (category) LEFT JOIN c USING (user_id, item_id) LEFT JOIN m USING (user_id, item_id) LEFT JOIN customer ON c_custkey = te.user_id LEFT JOIN seg ON seg.segment = c_mktsegment""")
def ranking_features(s, d):
    return rounded(_features(s, d))


_LEARNED = ("global_pop", "category_pop", "pooled_cosine", "max_similarity", "attention", "balance")


def _ranked(s, d):
    """What the model needs is written: of train rows no keys."""
    kept = lambda c: F.when(F.col("split") == "test", F.col(c)).alias(c)
    rows = materialize(_features(s, d).select(kept("user_id"), kept("item_id"), "label", "split", *_LEARNED), "features")
    model = scorers.fit_pointwise_ranker(rows.where("split = 'train'"), list(_LEARNED), 2.0)
    return scorers.score_pointwise(model, rows.where("split = 'test'")).select("user_id", "item_id", "label", "score")


@query("pointwise_ranker")
def pointwise_ranker(s, d):
    return rounded(_ranked(s, d))


@query("retrieval_factors")
def retrieval_factors(s, d):
    """Learned item vectors."""
    model = scorers.fit_retrieval_factors(_train(s, d).where("label = 1"))
    return model.itemFactors.select(F.col("id").cast("bigint").alias("item_id"), F.transform("features", lambda x: F.round(x.cast("double"), 6)).alias("vec"))


@query("evaluate_learned")
def evaluate_learned(s, d):
    """The metrics of all eleven scorers over the same rows, the two learned ones among them."""
    model = scorers.fit_retrieval_factors(_train(s, d).where("label = 1"))
    users = model.userFactors.select(F.col("id").cast("bigint").alias("user_id"), F.col("features").cast("array<double>").alias("vec"))
    items = model.itemFactors.select(F.col("id").cast("bigint").alias("item_id"), F.col("features").cast("array<double>").alias("vec"))
    ranked = materialize(_ranked(s, d).withColumnRenamed("score", "pointwise"), "pointwise")
    factors = materialize(scorers.score_pooled_cosine(_test(s, d), users, items).withColumnRenamed("score", "factors"), "factors")
    tables = [_evaluated(wide, models) for wide, models in ((_wide_scores(s, d), _MODELS), (ranked, ("pointwise",)), (factors, ("factors",)))]
    return rounded(reduce(lambda a, b: a.unionByName(b), tables))
