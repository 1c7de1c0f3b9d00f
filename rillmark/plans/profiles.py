"""Sources, projections and profiles (A, B and F of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillmark.functions import expr
from rillmark.operators import events as ev
from rillmark.operators import profile as P
from rillmark.operators import sequences, sketches
from rillmark.plans.base import CLICKS, COUNTS, IX, META, PURCHASES, query, rounded
from rillmark.scratch import materialize
from rillmark.sources import io
from rillmark.sources import tables as T


@query("scan_project", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity >= 45")
def scan_project(s, d):
    return io.scan_project(s, f"{d}/lineitem.parquet", ["l_orderkey", "l_partkey", "l_quantity"]).where("l_quantity >= 45")


@query("table_inventory")
def table_inventory(s, d):
    return io.table_inventory(s, d, ["customer", "part", "orders", "lineitem", "events"])


@query("uniform_sample", f"WITH {IX} SELECT user_id, item_id, label FROM ix ORDER BY md5(concat_ws('|', user_id, item_id, '42')), user_id, item_id LIMIT 1000")
def uniform_sample(s, d):
    return io.uniform_sample(T.interactions(s, d), 1000, F.col("user_id"), F.col("item_id")).select("user_id", "item_id", "label")


@query("fraction_sample", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE ('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, '42')), 1, 8))::BIGINT / 4294967296.0 < 0.1")
def fraction_sample(s, d):
    rows = T.load(s, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    return io.fraction_sample(rows, 0.1, *[F.col(c) for c in rows.columns])


@query("fraction_sample_exact", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, '42')), l_orderkey, l_linenumber, l_partkey LIMIT 500")
def fraction_sample_exact(s, d):
    """500 rows: some more than that by the threshold, then the ones with the least hashes."""
    rows = T.load(s, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    return io.fraction_sample(rows, 1.15 * 500 / max(rows.count(), 1) + 0.01, *[F.col(c) for c in rows.columns], n=500)


@query("onehot_label", f"WITH {IX} SELECT user_id, item_id, label::TINYINT AS label, label::BIGINT AS argmax FROM ix")
def onehot_label(s, d):
    hot = T.interactions(s, d).select("user_id", "item_id", F.array(1 - F.col("label"), F.col("label")).alias("label_0"))
    return hot.select("user_id", "item_id", expr.onehot_label(F.col("label_0")).alias("label"), expr.argmax(F.col("label_0")).alias("argmax"))


@query("schema_contract", f"""WITH {IX}, r AS (SELECT count(*) FILTER (WHERE ix.user_id IS NULL OR vec_id IS NULL) AS null_key, count(*) FILTER (WHERE len([1 - ix.label, ix.label]) <> 2) AS onehot_length, count(*) FILTER (WHERE ix.label NOT IN (0, 1)) AS label_range,
  count(*) FILTER (WHERE coalesce(len(embedding), 0) <> 64) AS vector_length FROM ix LEFT JOIN embeddings ON vec_id = item_id)
  SELECT unnest(['null_key', 'onehot_length', 'label_range', 'vector_length', 'missing:city_code']) AS rule, unnest([null_key, onehot_length, label_range, vector_length, 1]) AS n_violations FROM r""")
def schema_contract(s, d):
    """The samples beside the vectors of their items: rows without a vector have a null key there and no vector's length."""
    v = T.load(s, d, "embeddings", "vec_id", "embedding")
    joined = T.interactions(s, d).join(v, F.col("item_id") == F.col("vec_id"), "left")
    hot = joined.select("user_id", "vec_id", "label", "embedding", F.array(1 - F.col("label"), F.col("label")).alias("label_0"))
    return P.schema_contract(hot, ["user_id", "vec_id"], "label_0", "label", "embedding", 64, ["user_id", "label_0", "embedding", "city_code"])


@query("rename_cast_project", "SELECT l_orderkey AS user_id, l_partkey AS item_id, (CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::TINYINT AS label FROM lineitem")
def rename_cast_project(s, d):
    return T.load(s, d, "lineitem", "l_orderkey", "l_partkey", "l_returnflag").select(
        F.col("l_orderkey").alias("user_id"), F.col("l_partkey").alias("item_id"), (F.col("l_returnflag") == "R").cast("tinyint").alias("label")
    )


@query("timestamp_quality", """SELECT count(*) AS n_before, count(*) FILTER (WHERE ok) AS n_after, round(avg((NOT ok)::INT), 6) AS dropped_share,
  count(DISTINCT user_id) AS users_before, count(DISTINCT user_id) FILTER (WHERE ok) AS users_after
  FROM (SELECT *, ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-20' AS ok FROM events)""")
def timestamp_quality(s, d):
    return rounded(P.timestamp_quality(T.load(s, d, "events", "ts", "user_id"), "2024-01-03", "2024-01-20"))


@query("redact_fields", """SELECT event_id, name, CASE WHEN regexp_matches(lower(name), 'api_key|apikey|authorization|credential|password|secret|token|x-api-key') THEN '***' ELSE v END AS shown
  FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'X-Api-Key' WHEN 1 THEN 'user' WHEN 2 THEN 'refresh_TOKEN' ELSE event_type END AS name, props AS v FROM events)""")
def redact_fields(s, d):
    m = F.col("event_id") % 4
    name = F.when(m == 0, "X-Api-Key").when(m == 1, "user").when(m == 2, "refresh_TOKEN").otherwise(F.col("event_type"))
    return T.load(s, d, "events").select("event_id", name.alias("name"), "props").select("event_id", "name", ev.redact(F.col("name"), F.col("props")).alias("shown"))


@query("normalise_key", """SELECT k2 AS key, count(*) AS n FROM (SELECT CASE WHEN lower(trim(coalesce(k, ''))) IN ('', 'unknown') THEN '__anonymous__' ELSE k END AS k2
  FROM (SELECT CASE user_id % 5 WHEN 0 THEN NULL WHEN 1 THEN ' Unknown ' WHEN 2 THEN '' ELSE user_id::VARCHAR END AS k FROM events)) GROUP BY 1""")
def normalise_key(s, d):
    m = F.col("user_id") % 5
    k = F.when(m == 0, F.lit(None)).when(m == 1, F.lit(" Unknown ")).when(m == 2, F.lit("")).otherwise(F.col("user_id").cast("string"))
    return T.load(s, d, "events", "user_id").groupBy(expr.normalise_key(k).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("client_key", """SELECT event_id, coalesce(nullif(trim(split_part(fwd, ',', 1)), ''), peer, 'unknown') AS client
  FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN ' u' || user_id || ' , proxy' WHEN 1 THEN ' , proxy' END AS fwd, CASE WHEN event_id % 2 = 0 THEN event_type END AS peer FROM events)""")
def client_key(s, d):
    fwd = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" u"), F.col("user_id"), F.lit(" , proxy"))).when(F.col("event_id") % 3 == 1, F.lit(" , proxy"))
    peer = F.when(F.col("event_id") % 2 == 0, F.col("event_type"))
    return T.load(s, d, "events").select("event_id", expr.client_key(fwd, peer).alias("client"))


@query("label_cardinality", f"""WITH {IX} SELECT split, count(*) AS n_rows, sum(label)::BIGINT AS n_positive, round(avg(label), 6) AS positive_rate,
  count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items FROM ix GROUP BY 1""")
def label_cardinality(s, d):
    return rounded(P.label_cardinality(T.interactions(s, d)))


@query("item_popularity", f"WITH {COUNTS} SELECT * FROM c ORDER BY n DESC, item_id LIMIT 50")
def item_popularity(s, d):
    return P.top(P.popularity(T.interactions(s, d)), 50)


_TOP_RANKED = """SELECT k::BIGINT AS k, round(sum(n) FILTER (WHERE r <= k) / sum(n), 6) AS share FROM (SELECT n, row_number() OVER (ORDER BY n DESC) AS r FROM {0}), (VALUES (10), (100), (1000), (10000)) t(k) GROUP BY 1"""


@query("top_share", f"WITH {COUNTS} " + _TOP_RANKED.format("c"))
def top_share(s, d):
    return rounded(P.top_share(P.popularity(T.interactions(s, d))))


@query("items_for_pct", f"""WITH {COUNTS}, r AS (SELECT row_number() OVER w AS r, sum(n) OVER w AS cum, (SELECT sum(n) FROM c) AS t FROM c WINDOW w AS (ORDER BY n DESC, item_id ROWS UNBOUNDED PRECEDING))
  SELECT p::BIGINT AS pct, min(r) AS n_items FROM r, (VALUES (50), (90)) v(p) WHERE 100 * cum >= p * t GROUP BY 1""")
def items_for_pct(s, d):
    return P.items_for_pct(P.popularity(T.interactions(s, d)))


_GINI = "SELECT round((2 * sum(r * n) - (count(*) + 1) * sum(n))::DOUBLE / (count(*) * sum(n)), 6) AS gini FROM (SELECT n, row_number() OVER (ORDER BY n) AS r FROM {0})"


@query("gini", f"WITH {COUNTS} " + _GINI.format("c"))
def gini(s, d):
    return rounded(P.gini(P.popularity(T.interactions(s, d))))


@query("log_histogram", f"""WITH {COUNTS}, m AS (SELECT max(n) AS m FROM c), b AS (SELECT least(9, floor(ln(n) / ln(m) * 10 + 1e-9))::INT AS bin, count(*) AS k FROM c, m GROUP BY 1)
  SELECT g.bin::INT AS bin, round(pow(m, g.bin / 10.0), 6) AS low, coalesce(k, 0) AS n_items FROM (SELECT unnest(range(10)) AS bin) g LEFT JOIN b ON b.bin = g.bin, m""")
def log_histogram(s, d):
    return rounded(P.log_histogram(P.popularity(T.interactions(s, d))))


@query("positive_popularity", f"WITH {IX}, p AS (SELECT item_id, count(*) AS n FROM ix WHERE label = 1 GROUP BY 1) SELECT (SELECT count(*) FROM p) AS n_items, (SELECT round(sum(n) / (SELECT sum(n) FROM p), 6) FROM (SELECT n FROM p ORDER BY n DESC LIMIT 100)) AS top100_share")
def positive_popularity(s, d):
    counts = P.popularity(T.interactions(s, d).where("label = 1"))
    return rounded(counts.agg(F.count(F.lit(1)).alias("n_items")).crossJoin(P.top_share(counts, (100,)).select(F.col("share").alias("top100_share"))))


@T.shareable
def history_sizes(s, d):
    """``user_id, n``: how long each history is; the newest items needn't be known for that."""
    return train_purchases(s, d).groupBy("user_id").agg(F.least(F.count(F.lit(1)), F.lit(1000)).cast("int").alias("n"))


@query("sequence_length_stats", f"""WITH {PURCHASES}, h AS (SELECT least(count(*), 1000) AS n FROM buy WHERE ts < TIMESTAMP '2000-07-01' GROUP BY user_id)
  SELECT round(avg(n), 6) AS mean, round(quantile_cont(n, 0.1), 6) AS p10, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 0.99), 6) AS p99,
  max(n)::INT AS max, round(avg((n >= 1000)::INT), 6) AS share_at_cap FROM h""")
def sequence_length_stats(s, d):
    return rounded(P.sequence_length_stats(history_sizes(s, d), F.col("n"), 1000))


def train_purchases(s, d):
    return T.purchases(s, d).where(F.col("ts") < F.lit(T.SPLIT_DATE).cast("timestamp"))


def histories(s, d, newest=1000):
    return sequences.user_history(train_purchases(s, d), ["ts", "order_id", "line", "item_id"], newest)


@query("distinct_buckets", "SELECT unnest(['c_nationkey', 'c_mktsegment']) AS field, unnest([count(DISTINCT c_nationkey), count(DISTINCT c_mktsegment)]) AS n_distinct FROM customer")
def distinct_buckets(s, d):
    return P.distinct_buckets(T.load(s, d, "customer", "c_nationkey", "c_mktsegment"), ["c_nationkey", "c_mktsegment"])


@query("embedding_coverage", f"WITH {IX}, i AS (SELECT DISTINCT item_id FROM ix) SELECT count(*) AS n_items, count(vec_id) AS n_with_vector, round(avg((vec_id IS NOT NULL)::INT), 6) AS coverage FROM i LEFT JOIN embeddings ON vec_id = item_id")
def embedding_coverage(s, d):
    return rounded(P.embedding_coverage(T.interactions(s, d), T.item_vectors(s, d)))


@query("item_metadata_card", f"WITH {META} SELECT count(DISTINCT item_id) AS items, count(DISTINCT category) AS categories, count(DISTINCT city) AS cities, count(DISTINCT province) AS provinces FROM meta")
def item_metadata_card(s, d):
    c = F.count_distinct
    return T.item_features(s, d).agg(c("item_id").alias("items"), c("category").alias("categories"), c("city").alias("cities"), c("province").alias("provinces"))


@query("top_categories", f"WITH {META} SELECT category, count(*) AS n FROM meta GROUP BY 1 ORDER BY n DESC, category LIMIT 20")
def top_categories(s, d):
    return P.top(P.popularity(T.item_features(s, d), "category"), 20, "category")


@query("split_summary", f"""WITH {IX}, u AS (SELECT split, user_id, count(*) AS n, sum(label) AS p FROM ix GROUP BY 1, 2), i AS (SELECT split, count(DISTINCT item_id) AS n_items FROM ix GROUP BY 1)
  SELECT split, sum(n)::BIGINT AS n_rows, count(*) AS n_users, sum(p)::BIGINT AS n_positive, round(sum(p) / sum(n), 6) AS positive_rate, round(avg(n), 6) AS rows_per_user, round(avg(p), 6) AS positives_per_user,
  count(*) FILTER (WHERE p > 0) AS n_users_with_positive, round(avg((p > 0)::INT), 6) AS share_with_positive, any_value(n_items) AS n_items FROM u JOIN i USING (split) GROUP BY 1""")
def split_summary(s, d):
    return rounded(P.split_summary(T.interactions(s, d)))


@query("history_summary", f"""WITH {PURCHASES}, h AS (SELECT least(count(*), 1000) AS n FROM buy WHERE ts < TIMESTAMP '2000-07-01' GROUP BY user_id)
  SELECT count(*) AS n_users, sum(n)::BIGINT AS n_items, round(avg(n), 6) AS mean_length, max(n)::INT AS max_length, 4 * sum(n)::BIGINT AS bytes_int32, 8 * sum(n)::BIGINT AS bytes_int64 FROM h""")
def history_summary(s, d):
    return rounded(P.history_summary(history_sizes(s, d), F.col("n")))


@query("shard_locality")
def shard_locality(s, d):
    return P.shard_locality(T.load(s, d, "orders"), "o_custkey")


@query("column_modes", f"""WITH {META} SELECT * FROM (SELECT 'category' AS field, category AS value, count(*) AS n FROM meta GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 1)
  UNION ALL SELECT * FROM (SELECT 'city', city, count(*) FROM meta GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 1) UNION ALL SELECT * FROM (SELECT 'province', province::VARCHAR, count(*) FROM meta GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 1)""")
def column_modes(s, d):
    return P.column_modes(T.item_features(s, d), ["category", "city", "province"])


@query("catalogue_funnel", f"""WITH {IX} SELECT 0 AS step, 'vocabulary' AS stage, (SELECT count(DISTINCT p_partkey) FROM part) AS n_items UNION ALL SELECT 1, 'embedded', (SELECT count(DISTINCT vec_id) FROM embeddings)
  UNION ALL SELECT 2, 'targets', (SELECT count(DISTINCT item_id) FROM ix) UNION ALL SELECT 3, 'catalogue', (SELECT count(DISTINCT item_id) FROM ix JOIN embeddings ON vec_id = item_id)""")
def catalogue_funnel(s, d):
    ix, vec = T.interactions(s, d), T.item_vectors(s, d)
    return P.catalogue_funnel({"vocabulary": T.item_features(s, d), "embedded": vec, "targets": ix, "catalogue": ix.join(vec.select("item_id"), "item_id", "left_semi")})


@query("behaviour_profile", f"""WITH {CLICKS}, c AS (SELECT item_id, count(*) AS n FROM clicks GROUP BY 1), g AS ({_GINI.format('c')})
  SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, count(DISTINCT event_type) AS n_types, (SELECT count(DISTINCT p_brand) FROM clicks JOIN part ON p_partkey = item_id) AS n_categories,
  round((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0, 6) AS days, (SELECT count(*) FROM (SELECT 1 FROM clicks GROUP BY user_id, item_id, event_type, ts HAVING count(*) > 1)) AS n_duplicate_groups,
  (SELECT round(avg((n = 1)::INT), 6) FROM c) AS singleton_share, (SELECT gini FROM g) AS gini, (SELECT round(sum(n) / (SELECT sum(n) FROM c), 6) FROM (SELECT n FROM c ORDER BY n DESC LIMIT 100)) AS top100_share FROM clicks""")
def behaviour_profile(s, d):
    return rounded(P.behaviour_profile(T.clicks(s, d), T.item_features(s, d)))


@query("rows_per_user", "SELECT round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.9), 6) AS p90, max(n) AS max FROM (SELECT count(*) AS n FROM events GROUP BY user_id)")
def rows_per_user(s, d):
    return rounded(P.rows_per_user(T.clicks(s, d)))


@query("behaviour_mix", "SELECT event_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY 1")
def behaviour_mix(s, d):
    return rounded(P.behaviour_mix(T.clicks(s, d)))


@query("behaviour_funnel", """WITH u AS (SELECT user_id, max(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END) AS d FROM events GROUP BY 1),
  r AS (SELECT i, count(*) FILTER (WHERE d >= i) AS n_users, count(*) FILTER (WHERE d = i) AS n_deepest FROM u, (VALUES (1), (2), (3)) t(i) GROUP BY 1)
  SELECT ['view', 'click', 'purchase'][i] AS stage, n_users, n_deepest, round(n_users / coalesce(lag(n_users) OVER (ORDER BY i), n_users), 6) AS conversion FROM r""")
def behaviour_funnel(s, d):
    return rounded(P.behaviour_funnel(T.clicks(s, d), ["view", "click", "purchase"]))


@query("latency_summary", """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99,
  max(value) AS max, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0), 6) AS per_day FROM events GROUP BY 1""")
def latency_summary(s, d):
    return rounded(P.latency_summary(T.load(s, d, "events"), "event_type", "value"))


@query("request_counts", """SELECT (user_id % 7)::BIGINT AS endpoint, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error,
  count(*) FILTER (WHERE event_type = 'view') AS view FROM events GROUP BY 1""")
def request_counts(s, d):
    return P.request_counts(T.load(s, d, "events", "user_id", "event_type"), F.col("user_id") % 7, "event_type", ["click", "error", "view"])


@query("latency_sketch", """SELECT event_type, count(*) AS n, true AS p50_close, true AS p95_close, true AS p99_close FROM events GROUP BY 1""")
def latency_sketch(s, d):
    """Percentiles of sketches stored by day and merged: whether each lies between the exact ones 2 % of the ranks below and above."""
    log = T.load(s, d, "events", "ts", "event_type", "value")
    daily = materialize(sketches.quantile_sketches(log.withColumn("day", F.to_date("ts")), ["day", "event_type"], "value"), "latency-sketches")
    got = sketches.merged_quantiles(daily, ["event_type"], P.LATENCY)
    edges = sketches.exact_quantiles(log, ["event_type"], "value", {f"{n}_{side}": min(1.0, max(0.0, q + e)) for n, q in P.LATENCY.items() for side, e in (("low", -0.02), ("high", 0.02))})
    return got.join(edges, "event_type").select("event_type", "n", *[F.col(n).between(F.col(f"{n}_low"), F.col(f"{n}_high")).alias(f"{n}_close") for n in P.LATENCY])


@query("distinct_sketch", f"WITH {IX} SELECT split, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items, true AS users_close, true AS items_close FROM ix GROUP BY 1")
def distinct_sketch(s, d):
    """Distinct users and items by sketches stored by month and merged, beside the exact numbers: whether they are within 2 %."""
    ix = materialize(T.interactions(s, d), "interactions")
    monthly = materialize(sketches.distinct_sketches(ix.withColumn("month", F.date_trunc("month", "last_ts")), ["split", "month"], ["user_id", "item_id"]), "distinct-sketches")
    got = sketches.merged_distinct(monthly, ["split"], ["user_id", "item_id"])
    exact = ix.groupBy("split").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("item_id").alias("items"))
    return got.join(exact, "split").select("split", "users", "items", sketches.within(F.col("n_user_id"), F.col("users"), 0.02).alias("users_close"), sketches.within(F.col("n_item_id"), F.col("items"), 0.02).alias("items_close"))
