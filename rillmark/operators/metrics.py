"""Ranking and classification metrics, per model throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmark.functions.expr import seeded_md5

KS = (1, 3, 5, 10)


def per_user_ranking(scored: DataFrame, ks: tuple[int, ...] = KS, seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """HR@k, NDCG@k and MRR, averaged over users with a positive; equal scores are ordered by a seeded hash."""
    by = by or []
    w = Window.partitionBy(*by, "user_id").orderBy(F.desc("score"), seeded_md5(seed, F.col("user_id"), F.col("item_id")))
    ranked = scored.withColumn("r", F.row_number().over(w))
    hit, gain = F.col("label") == 1, 1 / F.log2(F.col("r") + 1)
    per_user = ranked.groupBy(*by, "user_id").agg(
        F.sum("label").alias("p"), F.min(F.when(hit, F.col("r"))).alias("first"),
        *[F.sum(F.when(hit & (F.col("r") <= k), gain).otherwise(0.0)).alias(f"dcg{k}") for k in ks],
    )
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least("p", F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    good = per_user.where("p > 0")
    out = [F.count(F.lit(1)).alias("n_users")]
    out += [F.avg((F.col("first") <= k).cast("double")).alias(f"hr_{k}") for k in ks]
    out += [F.avg(F.col(f"dcg{k}") / ideal(k)).alias(f"ndcg_{k}") for k in ks]
    out += [F.avg(1 / F.col("first")).alias("mrr")]
    return good.groupBy(*by).agg(*out) if by else good.agg(*out)


def _score_classes(scored: DataFrame, by: list[str]) -> DataFrame:
    """Rows and positives of each distinct score: what a running sum has to pass over."""
    return scored.groupBy(*by, "score").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("label").cast("double").alias("p"))


def _running(classes: DataFrame, by: list[str], descending: bool) -> DataFrame:
    """Adds running sums of ``n`` and ``p`` over scores. Each model's distinct scores are cut into ranges, summed, and the
    ranges' totals, at most 256 a model, carry the offsets."""
    order = -F.col("score") if descending else F.col("score")
    keyed = classes.withColumn("__o", F.when(order == float("-inf"), -1e308).when(order == float("inf"), 1e308).otherwise(order))
    edges = keyed.groupBy(*by).agg(F.percentile_approx("__o", F.array(*[F.lit(i / 64) for i in range(1, 64)]), F.lit(1000)).alias("__e"))
    cut = (keyed.join(F.broadcast(edges), by) if by else keyed.crossJoin(F.broadcast(edges))).withColumn("__b", F.size(F.filter("__e", lambda e: e < F.col("__o")))).drop("__e")
    totals = cut.groupBy(*by, "__b").agg(F.sum("n").alias("tn"), F.sum("p").alias("tp"))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "__b", F.coalesce(F.sum("tn").over(before), F.lit(0.0)).alias("on"), F.coalesce(F.sum("tp").over(before), F.lit(0.0)).alias("op"))
    inside = Window.partitionBy(*by, "__b").orderBy("__o").rowsBetween(Window.unboundedPreceding, 0)
    return cut.join(F.broadcast(offsets), [*by, "__b"]).withColumns({"cn": F.sum("n").over(inside) + F.col("on"), "cp": F.sum("p").over(inside) + F.col("op")})


def _agg(df: DataFrame, by: list[str], *cells: Column) -> DataFrame:
    return df.groupBy(*by).agg(*cells) if by else df.agg(*cells)


def auc(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve by average ranks; NaN if all labels are alike."""
    by = by or []
    ranked = _running(_score_classes(scored, by), by, False)
    mean_rank = F.col("cn") - F.col("n") + (F.col("n") + 1) / 2
    p, n = F.sum("p"), F.sum("n") - F.sum("p")
    value = F.when((p > 0) & (n > 0), (F.sum(mean_rank * F.col("p")) - p * (p + 1) / 2) / (p * n)).otherwise(F.lit(float("nan")))
    return _agg(ranked, by, value.alias("auc"))


def pr_auc(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Average precision; equal scores form one step."""
    by = by or []
    ranked = _running(_score_classes(scored, by), by, True)
    return _agg(ranked, by, (F.sum(F.col("p") * F.col("cp") / F.col("cn")) / F.sum("p")).alias("pr_auc"))


def logloss(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    q = 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.col("score")))))
    loss = -(F.col("label") * F.log(q + 1e-9) + (1 - F.col("label")) * F.log(1 - q + 1e-9))
    return _agg(scored, by or [], F.avg(loss).alias("logloss"))


def gauc(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """AUC of each user with both kinds of rows, weighted by their rows."""
    by = by or []
    w = Window.partitionBy(*by, "user_id")
    ranked = scored.withColumn("rank", F.rank().over(w.orderBy("score")) + (F.count(F.lit(1)).over(Window.partitionBy(*by, "user_id", "score")) - 1) / 2)
    per_user = ranked.groupBy(*by, "user_id").agg(F.count(F.lit(1)).alias("w"), F.sum("label").alias("p"), F.sum(F.when(F.col("label") == 1, F.col("rank"))).alias("s"))
    p, n = F.col("p"), F.col("w") - F.col("p")
    value = F.round((F.col("s") - p * (p + 1) / 2) / (p * n), 5)
    return _agg(per_user.where((p > 0) & (n > 0)), by, F.count(F.lit(1)).alias("n_users"), (F.sum(F.col("w") * value) / F.sum("w")).alias("gauc"))


def recall_from_topk(lists: DataFrame, targets: DataFrame, ks: tuple[int, ...], depth: int) -> DataFrame:
    """Recall and NDCG at each ``k`` up to the lists' depth, of one target a query."""
    hit = targets.join(lists.select("user_id", F.col("item_id").alias("target"), "rank"), ["user_id", "target"], "left")
    usable = [k for k in ks if k <= depth]
    cells = [F.avg((F.coalesce(F.col("rank") <= k, F.lit(False))).cast("double")).alias(f"recall_{k}") for k in usable]
    cells += [F.avg(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"ndcg_{k}") for k in usable]
    return hit.agg(F.count(F.lit(1)).alias("n_targets"), *cells)


def candidate_set_size(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    per_user = rows.groupBy(*by, "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p"))
    return _agg(per_user, by, F.count(F.lit(1)).alias("n_users"), F.count_if(F.col("p") > 0).alias("n_scored"), F.avg("n").alias("rows_per_user"))


def compare_guard(table: DataFrame, metric: str) -> DataFrame:
    """Models ranked by the metric, nulls last, with ``comparable``: all were judged on sets of one size."""
    sizes = table.agg((F.count_distinct("rows_per_user") <= 1).alias("comparable"))
    w = Window.orderBy(F.desc_nulls_last(metric), "model")  # one row a model
    return table.crossJoin(F.broadcast(sizes)).select("model", metric, F.row_number().over(w).alias("place"), "comparable")


def random_reference(catalogue: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    n = catalogue.agg(F.count(F.lit(1)).alias("n_items"))
    return n.select("n_items", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).select("k", "n_items", (F.col("k") / F.col("n_items")).alias("expected_recall"))


def _curves(scored: DataFrame, by: list[str]) -> DataFrame:
    """AUC and average precision of one pass over the running sums: those from above are what the total leaves."""
    ranked = _running(_score_classes(scored, by), by, False)
    p, n = F.sum("p"), F.sum("n") - F.sum("p")
    mean_rank = F.col("cn") - F.col("n") + (F.col("n") + 1) / 2
    value = F.when((p > 0) & (n > 0), (F.sum(mean_rank * F.col("p")) - p * (p + 1) / 2) / (p * n)).otherwise(F.lit(float("nan")))
    totals = ranked.groupBy(*by).agg(F.sum("p").alias("__p"), F.sum("n").alias("__n"))
    above = ranked.join(F.broadcast(totals), by)  # one row a model
    step = F.col("p") * (F.col("__p") - F.col("cp") + F.col("p")) / (F.col("__n") - F.col("cn") + F.col("n"))
    return above.groupBy(*by).agg(value.alias("auc"), (F.sum(step) / F.sum("p")).alias("pr_auc"))


def _users(scored: DataFrame, ks: tuple[int, ...], seed: int = 42) -> DataFrame:
    """The metrics that are means over users, and log loss: one shuffle by model and user carries their windows and sums."""
    w = Window.partitionBy("model", "user_id")
    q = 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.col("score")))))
    loss = -(F.col("label") * F.log(q + 1e-9) + (1 - F.col("label")) * F.log(1 - q + 1e-9))
    ranked = scored.withColumns({
        "r": F.row_number().over(w.orderBy(F.desc("score"), seeded_md5(seed, F.col("user_id"), F.col("item_id")))), "loss": loss,
        "rank": F.rank().over(w.orderBy("score")) + (F.count(F.lit(1)).over(Window.partitionBy("model", "user_id", "score")) - 1) / 2,
    })
    hit, gain = F.col("label") == 1, 1 / F.log2(F.col("r") + 1)
    user = ranked.groupBy("model", "user_id").agg(
        F.count(F.lit(1)).alias("w"), F.sum("label").alias("p"), F.min(F.when(hit, F.col("r"))).alias("first"), F.sum("loss").alias("loss"), F.sum(F.when(hit, F.col("rank"))).alias("s"),
        *[F.sum(F.when(hit & (F.col("r") <= k), gain).otherwise(0.0)).alias(f"dcg{k}") for k in ks],
    )
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least("p", F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    p, n = F.col("p"), F.col("w") - F.col("p")
    good, both = p > 0, (p > 0) & (n > 0)
    auc_of = F.when(both, F.round((F.col("s") - p * (p + 1) / 2) / (p * n), 5))
    return user.groupBy("model").agg(
        F.count_if(good).alias("n_users"), *[F.avg(F.when(good, (F.col("first") <= k).cast("double"))).alias(f"hr_{k}") for k in ks],
        *[F.avg(F.when(good, F.col(f"dcg{k}") / ideal(k))).alias(f"ndcg_{k}") for k in ks], F.avg(F.when(good, 1 / F.col("first"))).alias("mrr"),
        (F.sum("loss") / F.sum("w")).alias("logloss"), (F.sum(F.col("w") * auc_of) / F.sum(F.when(both, F.col("w")))).alias("gauc"), F.avg("w").alias("rows_per_user"),
    )


def evaluate_table(scored: DataFrame, ks: tuple[int, ...] = KS, by_user: DataFrame | None = None) -> DataFrame:
    """All metrics of every model of a long score table, one row a model. The table is read twice: by user and by score. Write it
    first if it is costly. ``by_user``: the same rows where they lie by user already, which saves a shuffle of a row a model."""
    return _users(scored if by_user is None else by_user, ks).join(_curves(scored, ["model"]), "model")
