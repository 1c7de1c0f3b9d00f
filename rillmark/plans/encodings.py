"""Vocabularies, vectors and joins (C, D and E of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillmark.functions import expr
from rillmark.operators import joins, vectors, vocab
from rillmark.plans.base import IX, META, UNIT, VEC, query, rounded
from rillmark.plans.profiles import histories
from rillmark.scratch import new_folder
from rillmark.sources import io
from rillmark.sources import tables as T

DIM = 64
_VOCAB = "voc AS (SELECT item_id AS id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM (SELECT DISTINCT vec_id AS item_id FROM embeddings))"


def _vocab(s, d):
    return vocab.build_vocab(T.item_vectors(s, d), "item_id")


@query("build_vocab", f"WITH {_VOCAB} SELECT * FROM voc")
def build_vocab(s, d):
    return _vocab(s, d)


@query("encode_ids", f"WITH {IX}, {_VOCAB} SELECT user_id, item_id, coalesce(idx, (SELECT count(*) FROM voc)) AS idx FROM ix LEFT JOIN voc ON id = item_id")
def encode_ids(s, d):
    return vocab.encode_ids(T.interactions(s, d).select("user_id", "item_id"), _vocab(s, d), "item_id", "idx")


@query("decode_ids", f"WITH {_VOCAB} SELECT l_partkey AS idx, count(*) AS n, any_value(coalesce(id, -1)) AS id FROM lineitem LEFT JOIN voc ON idx = l_partkey GROUP BY 1")
def decode_ids(s, d):
    asked = T.load(s, d, "lineitem", "l_partkey").groupBy(F.col("l_partkey").alias("idx")).agg(F.count(F.lit(1)).alias("n"))
    return vocab.decode_ids(asked, _vocab(s, d), "idx", "id")


_RANKED_ALL = """ranked AS (SELECT o_custkey AS user_id, l_partkey AS item_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) AS r
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate < TIMESTAMP '2000-07-01')"""


@query("encode_ragged", f"""WITH {_RANKED_ALL}, {_VOCAB} SELECT user_id, list(coalesce(idx, (SELECT count(*) FROM voc)) ORDER BY r DESC) AS codes FROM ranked LEFT JOIN voc ON id = item_id WHERE r <= 1000 GROUP BY 1""")
def encode_ragged(s, d):
    return vocab.encode_ragged(histories(s, d), _vocab(s, d), "user_id", "history", "codes")


@query("vocab_coverage", f"WITH {IX}, {_VOCAB} SELECT count(*) AS n, count(id) AS n_found, round(avg((id IS NOT NULL)::INT), 6) AS coverage FROM ix LEFT JOIN voc ON id = item_id")
def vocab_coverage(s, d):
    return rounded(vocab.vocab_coverage(T.interactions(s, d), _vocab(s, d), "item_id"))


@query("vocab_stats", """SELECT count(*) AS size, count(vec_id) AS n_with_vector, round(count(vec_id) / count(*), 6) AS vector_share, count(*) AS pad_index, min(p_partkey) AS min_id, max(p_partkey) AS max_id
  FROM part LEFT JOIN embeddings ON vec_id = p_partkey""")
def vocab_stats(s, d):
    return rounded(vocab.vocab_stats(vocab.build_vocab(T.item_features(s, d), "item_id"), T.item_vectors(s, d)))


@query("category_vocab", f"WITH {META} SELECT category AS id, row_number() OVER (ORDER BY category) - 1 AS idx FROM (SELECT DISTINCT category FROM meta)")
def category_vocab(s, d):
    return vocab.small_vocab(T.item_features(s, d), "category")


@query("encode_categoricals", f"""WITH {META}, a AS (SELECT category, dense_rank() OVER (ORDER BY category) - 1 AS i FROM meta), b AS (SELECT city, dense_rank() OVER (ORDER BY city) - 1 AS i FROM meta)
  SELECT item_id, category, city, (SELECT any_value(i) FROM a WHERE a.category = meta.category) AS category_idx,
  coalesce((SELECT any_value(i) FROM b WHERE b.city = meta.city), (SELECT count(DISTINCT city) FROM b)) AS city_idx FROM meta""")
def encode_categoricals(s, d):
    meta = T.item_features(s, d).select("item_id", "category", "city")
    return vocab.encode_categoricals(meta, vocab.small_vocabs(meta, ["category", "city"]))


@query("cardinalities", f"WITH {META} SELECT unnest(['category', 'city', 'province']) AS field, unnest([count(DISTINCT category) + 1, count(DISTINCT city) + 1, count(DISTINCT province) + 1]) AS cardinality FROM meta")
def cardinalities(s, d):
    meta = T.item_features(s, d)
    return vocab.cardinalities({c: vocab.small_vocab(meta, c) for c in ("category", "city", "province")})


@query("key_order_check", """WITH o AS (SELECT user_id, lag(user_id) OVER (ORDER BY event_id) AS p FROM events) SELECT count(*) FILTER (WHERE user_id < p) AS n_inversions,
  (SELECT count(*) FROM (SELECT 1 FROM events GROUP BY user_id HAVING count(*) > 1)) AS n_repeated_keys FROM o""")
def key_order_check(s, d):
    return vocab.key_order_check(T.load(s, d, "events", "event_id", "user_id"), "user_id", "event_id")


@query("key_to_row", "WITH k AS (SELECT user_id, min(event_id) AS row_index FROM events GROUP BY 1) SELECT c_custkey, coalesce(row_index, -1) AS row_index FROM customer LEFT JOIN k ON user_id = c_custkey")
def key_to_row(s, d):
    return vocab.key_to_row(T.load(s, d, "customer", "c_custkey"), T.load(s, d, "events", "event_id", "user_id"), "c_custkey", "user_id", "event_id")


@query("unify_users", f"""WITH {IX}, u AS (SELECT user_id, split, count(*) AS n FROM ix GROUP BY 1, 2), b AS (SELECT user_id, arg_min(split, CASE split WHEN 'test' THEN 0 ELSE 1 END) AS split, arg_min(n, CASE split WHEN 'test' THEN 0 ELSE 1 END) AS n FROM u GROUP BY 1)
  SELECT user_id, split, n, row_number() OVER (ORDER BY user_id) - 1 AS user_idx FROM b""")
def unify_users(s, d):
    per = T.interactions(s, d).groupBy("user_id", "split").agg(F.count(F.lit(1)).alias("n"))
    one = vocab.unify_users([per.where("split = 'test'"), per.where("split = 'train'")], "user_id")
    index = vocab.build_vocab(one, "user_id").select(F.col("id").alias("user_id"), F.col("idx").alias("user_idx"))
    return one.join(index, "user_id")


_Q8 = "list_transform(vec, lambda x: trunc(greatest(-1, least(1, x)) * 127)::TINYINT)"


@query("quantise_int8", f"WITH {VEC} SELECT item_id, {_Q8} AS q FROM vec")
def quantise_int8(s, d):
    return T.item_vectors(s, d).select("item_id", expr.quantise_int8(F.col("vec")).alias("q"))


@query("dequantise", f"WITH {VEC} SELECT item_id, list_transform({_Q8}, lambda x: round(x / 127.0::DOUBLE, 6)) AS v FROM vec")
def dequantise(s, d):
    back = expr.dequantise(expr.quantise_int8(F.col("vec")))
    return T.item_vectors(s, d).select("item_id", F.transform(back, lambda x: F.round(x, 6)).alias("v"))


@query("norm_stats", f"""WITH {VEC}, n AS (SELECT unnest([struct_pack(space := 'raw', n := sqrt(list_sum(list_transform(vec, lambda x: x * x)))), struct_pack(space := 'dequantised', n := sqrt(list_sum(list_transform({_Q8}, lambda x: (x / 127.0::DOUBLE) * (x / 127.0::DOUBLE)))))]) AS x FROM vec)
  SELECT x.space AS space, round(avg(x.n), 6) AS mean, round(stddev_pop(x.n), 6) AS std, round(min(x.n), 6) AS min, round(max(x.n), 6) AS max FROM n GROUP BY 1""")
def norm_stats(s, d):
    return rounded(vectors.norm_stats(T.item_vectors(s, d)))


@query("norm_verdict", f"""WITH {VEC}, n AS (SELECT unnest([struct_pack(space := 'raw', n := sqrt(list_sum(list_transform(vec, lambda x: x * x)))), struct_pack(space := 'dequantised', n := sqrt(list_sum(list_transform({_Q8}, lambda x: (x / 127.0::DOUBLE) * (x / 127.0::DOUBLE)))))]) AS x FROM vec)
  SELECT x.space AS space, (max(x.n) - min(x.n)) / avg(x.n) < 0.05 AND abs(avg(x.n) - 1) < 0.05 AS unit_norm FROM n GROUP BY 1""")
def norm_verdict(s, d):
    return vectors.norm_verdict(vectors.norm_stats(T.item_vectors(s, d)))


@query("dim_means", f"WITH {VEC} SELECT (i - 1)::INT AS dim, round(avg(vec[i]), 6) AS mean FROM vec, range(1, 65) t(i) GROUP BY 1")
def dim_means(s, d):
    return rounded(vectors.dim_means(T.item_vectors(s, d)))


@query("value_range", f"WITH {VEC} SELECT min(list_min(vec)) AS least, max(list_max(vec)) AS greatest, count(*) AS n_rows, max(len(vec))::INT AS dim FROM vec")
def value_range(s, d):
    return vectors.value_range(T.item_vectors(s, d))


@query("lookup_masked", f"WITH {VEC} SELECT p_partkey AS item_id, round(coalesce(list_sum(vec), 0), 6) AS total, vec IS NOT NULL AS known FROM part LEFT JOIN vec ON item_id = p_partkey")
def lookup_masked(s, d):
    found = vectors.lookup_masked(T.item_features(s, d).select("item_id"), T.item_vectors(s, d), DIM)
    return rounded(found.select("item_id", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x).alias("total"), "known"))


@query("dedupe_keys", f"WITH {VEC}, k AS (SELECT item_id % 100 AS key, item_id, vec[1] AS first FROM vec) SELECT key, min(item_id) AS item_id, round(arg_min(first, item_id), 6) AS first FROM k GROUP BY 1")
def dedupe_keys(s, d):
    keyed = T.item_vectors(s, d).select((F.col("item_id") % 100).alias("key"), "item_id", F.get("vec", 0).alias("first"))
    return rounded(vectors.dedupe_keys(keyed, "key", "item_id"))


@query("subset_vectors", f"WITH {IX}, {VEC} SELECT item_id, round(list_sum(vec), 6) AS total FROM vec WHERE item_id IN (SELECT item_id FROM ix WHERE label = 1) UNION ALL SELECT -1, 0.0")
def subset_vectors(s, d):
    kept = vectors.subset_vectors(T.item_vectors(s, d), T.interactions(s, d).where("label = 1"), DIM)
    return rounded(kept.select("item_id", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x).alias("total")))


@query("vector_primitives", f"""WITH {UNIT}, p AS (SELECT vec.item_id, vec.vec AS a, b.vec AS b, unit.vec AS u FROM vec JOIN vec b ON b.item_id = vec.item_id + 1 JOIN unit ON unit.item_id = vec.item_id)
  SELECT item_id, round(list_inner_product(a, b), 6) AS dot, round(list_inner_product(a, b) / (sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b))), 6) AS cosine, round(u[1], 6) AS first_unit FROM p""")
def vector_primitives(s, d):
    v = T.item_vectors(s, d)
    b = v.select((F.col("item_id") - 1).alias("item_id"), F.col("vec").alias("b"))
    pair = v.join(b, "item_id")
    return rounded(pair.select("item_id", expr.dot(F.col("vec"), F.col("b")).alias("dot"), expr.cosine(F.col("vec"), F.col("b")).alias("cosine"), F.get(expr.l2_normalise(F.col("vec")), 0).alias("first_unit")))


@query("mean_pairwise_cosine", f"WITH {UNIT}, s AS (SELECT i, sum(vec[i]) AS s, count(*) AS n FROM unit, range(1, 65) t(i) GROUP BY 1) SELECT max(n) AS n, round((sum(s * s) - max(n)) / (max(n) * (max(n) - 1)), 6) AS mean_cosine FROM s")
def mean_pairwise_cosine(s, d):
    return rounded(vectors.mean_pairwise_cosine(T.item_vectors(s, d)))


@query("encoding_footprint", """SELECT e AS encoding, 64 * w AS bytes_per_vector, 64 * w * (SELECT count(*) FROM embeddings) AS total_bytes
  FROM (VALUES ('int8', 1::BIGINT), ('float16', 2), ('bfloat16', 2), ('float32', 4), ('float64', 8)) t(e, w)""")
def encoding_footprint(s, d):
    return vectors.encoding_footprint(T.item_vectors(s, d))


@query("join_embeddings", f"WITH {IX}, {VEC} SELECT user_id, item_id, label, len(vec)::INT AS dim, round(vec[1], 6) AS first FROM ix JOIN vec USING (item_id)")
def join_embeddings(s, d):
    got = joins.join_embeddings(T.interactions(s, d).select("user_id", "item_id", "label"), T.item_vectors(s, d))
    return rounded(got.select("user_id", "item_id", "label", F.size("vec").alias("dim"), F.get("vec", 0).alias("first")))


@query("join_item_meta", f"WITH {IX}, {META} SELECT user_id, item_id, label, category, city, province FROM ix LEFT JOIN meta USING (item_id)")
def join_item_meta(s, d):
    return joins.join_item_meta(T.interactions(s, d).select("user_id", "item_id", "label"), T.item_features(s, d))


@query("training_join", f"""WITH {IX}, {META}, {VEC}, x AS (SELECT * FROM ix ORDER BY md5(concat_ws('|', user_id, item_id, '42')), user_id, item_id LIMIT 20000)
  SELECT count(*) AS n_rows, round(avg(label), 6) AS positive_rate, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, count(*) FILTER (WHERE category IS NULL) AS n_without_meta, max(len(vec))::INT AS dim
  FROM x JOIN vec USING (item_id) LEFT JOIN meta USING (item_id)""")
def training_join(s, d):
    """The joined table is written as its sink has it, and the summary reads what was written."""
    rows = io.uniform_sample(T.interactions(s, d), 20_000, F.col("user_id"), F.col("item_id"))
    joined = joins.join_item_meta(joins.join_embeddings(rows, T.item_vectors(s, d)), T.item_features(s, d))
    path = new_folder(s, "training")
    io.write_zstd(joined, path)
    return rounded(joins.training_join_summary(s.read.schema(joined.schema).parquet(path)))


@query("join_loss_audit", f"""WITH {IX} SELECT count(*) AS n_sampled, count(vec_id) AS n_matched, round(avg((vec_id IS NOT NULL)::INT), 6) AS retention, round(avg(ix.label), 6) AS rate_before, round(avg(ix.label) FILTER (WHERE vec_id IS NOT NULL), 6) AS rate_after,
  round(abs(avg(ix.label) FILTER (WHERE vec_id IS NOT NULL) - avg(ix.label)), 6) AS rate_shift FROM ix LEFT JOIN embeddings ON vec_id = item_id""")
def join_loss_audit(s, d):
    return rounded(joins.join_loss_audit(T.interactions(s, d), T.item_vectors(s, d)))


@query("join_loss_rows", f"WITH {IX} SELECT user_id, item_id, label FROM ix WHERE item_id NOT IN (SELECT vec_id FROM embeddings)")
def join_loss_rows(s, d):
    return joins.join_loss_rows(T.interactions(s, d).select("user_id", "item_id", "label"), T.item_vectors(s, d).select("item_id"))


@query("user_overlap", f"""WITH {IX}, a AS (SELECT DISTINCT user_id FROM ix WHERE split = 'train'), b AS (SELECT DISTINCT user_id FROM ix WHERE split = 'test'), x AS (SELECT * FROM a INTERSECT SELECT * FROM b)
  SELECT (SELECT count(*) FROM a) AS n_train_users, (SELECT count(*) FROM b) AS n_test_users, (SELECT count(*) FROM x) AS n_both, round((SELECT count(*) FROM x) / (SELECT count(*) FROM b), 6) AS test_share""")
def user_overlap(s, d):
    ix = T.interactions(s, d)
    return rounded(joins.user_overlap(ix.where("split = 'train'"), ix.where("split = 'test'")))


@query("complete_candidates", f"""WITH {IX}, {META}, w AS (SELECT DISTINCT user_id FROM ix WHERE split = 'test' AND label = 1)
  SELECT user_id, item_id, label, category, city, province, c_nationkey AS nation, c_mktsegment AS segment, sign(c_acctbal)::INT AS balance FROM ix LEFT JOIN meta USING (item_id) LEFT JOIN customer ON c_custkey = user_id WHERE split = 'test' AND user_id IN (SELECT user_id FROM w)""")
def complete_candidates(s, d):
    test = T.interactions(s, d).where("split = 'test'").select("user_id", "item_id", "label")
    return joins.complete_candidates(test, test.where("label = 1"), T.item_features(s, d), T.demographics(s, d))


@query("catalogue_union", f"WITH {IX} SELECT item_id FROM ix WHERE split = 'train' UNION SELECT item_id FROM ix WHERE split = 'test' AND label = 1")
def catalogue_union(s, d):
    ix = T.interactions(s, d)
    return joins.catalogue_union(ix.where("split = 'train'"), ix.where("split = 'test' AND label = 1"))


@query("vectorless_join", f"WITH {IX}, {META}, {VEC} SELECT user_id, item_id, category, round(list_sum(vec), 6) AS total FROM ix JOIN vec USING (item_id) LEFT JOIN meta USING (item_id)")
def vectorless_join(s, d):
    got = joins.vectorless_join(T.interactions(s, d).select("user_id", "item_id"), T.item_features(s, d), T.item_vectors(s, d))
    return rounded(got.select("user_id", "item_id", "category", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x).alias("total")))


@query("skew_join", "SELECT user_id % 3 AS hot, count(*) AS n, round(sum(value * n_nationkey), 4) AS total FROM events JOIN nation ON n_nationkey = user_id % 3 GROUP BY 1")
def skew_join(s, d):
    log = T.load(s, d, "events", "event_id", "user_id", "value").withColumn("hot", F.col("user_id") % 3)
    small = T.load(s, d, "nation", "n_nationkey").select(F.col("n_nationkey").cast("bigint").alias("hot"), "n_nationkey")
    return rounded(joins.salted_join(log, small, "hot", 4, "event_id").groupBy("hot").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value") * F.col("n_nationkey")).alias("total")), 4)


@query("hot_key_join", "SELECT user_id % 3 AS hot, count(*) AS n, round(sum(value * n_nationkey), 4) AS total FROM (SELECT CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id % 25 END AS user_id, value FROM events) e JOIN nation ON n_nationkey = e.user_id GROUP BY 1")
def hot_key_join(s, d):
    """A third of all rows have one key, which alone is spread."""
    log = T.load(s, d, "events", "event_id", "user_id", "value").withColumn("key", F.when(F.col("event_id") % 3 == 0, F.lit(1).cast("bigint")).otherwise(F.col("user_id") % 25))
    small = T.load(s, d, "nation", "n_nationkey").select(F.col("n_nationkey").cast("bigint").alias("key"), "n_nationkey")
    joined = joins.hot_key_join(log, small, "key", "event_id", rows_a_task=500, share=0.1)
    return rounded(joined.groupBy((F.col("key") % 3).alias("hot")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value") * F.col("n_nationkey")).alias("total")), 4)
