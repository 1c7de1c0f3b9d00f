"""Profiles of labels, popularity, sequences, coverage, behaviour and request logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmark.operators.sketches import exact_quantiles, merged_quantiles, quantile_sketches


def label_cardinality(ix: DataFrame, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return ix.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("label").alias("n_positive"), F.avg("label").alias("positive_rate"),
        distinct("user_id").alias("n_users"), distinct("item_id").alias("n_items"),
    )


def popularity(rows: DataFrame, by: str = "item_id") -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def top(counts: DataFrame, n: int, by: str = "item_id") -> DataFrame:
    return counts.orderBy(F.desc("n"), by).limit(n)


def _count_classes(counts: DataFrame) -> DataFrame:
    """Items by how often they occur: as many rows as there are different counts, however many items."""
    return counts.groupBy("n").agg(F.count(F.lit(1)).alias("items"))


def _summed(classes: DataFrame, order: Column, values: dict[str, Column]) -> DataFrame:
    """Running sums over all classes in one small window: different counts add up to the rows, so there are at most as many as the root of
    twice the rows, a million and a half for a trillion."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return classes.withColumns({name: F.sum(v).over(w) for name, v in values.items()})


def _descending(counts: DataFrame) -> DataFrame:
    return _summed(_count_classes(counts), F.desc("n"), {"rank_to": F.col("items"), "sum_to": F.col("n") * F.col("items")})


def top_share(counts: DataFrame, ks: tuple[int, ...] = (10, 100, 1000, 10000)) -> DataFrame:
    """``k, share``: what the k most frequent items hold of all rows; k beyond the number of items means all of them."""
    ranked = _descending(counts).withColumn("ks", F.explode(F.array(*[F.lit(k).cast("bigint") for k in ks])))
    before = F.col("rank_to") - F.col("items")
    taken = F.greatest(F.lit(0), F.least(F.col("items"), F.col("ks") - before)) * F.col("n")
    return ranked.groupBy(F.col("ks").alias("k")).agg((F.sum(taken) / F.sum(F.col("n") * F.col("items"))).alias("share"))


def items_for_pct(counts: DataFrame, pcts: tuple[int, ...] = (50, 90)) -> DataFrame:
    """``pct, n_items``: the fewest items that cover the share of all rows."""
    ranked = _descending(counts)
    total = ranked.agg(F.max("sum_to").alias("total"))
    wanted = ranked.crossJoin(F.broadcast(total)).withColumn("pct", F.explode(F.array(*[F.lit(p).cast("bigint") for p in pcts])))
    before, sum_before = F.col("rank_to") - F.col("items"), F.col("sum_to") - F.col("n") * F.col("items")
    need = F.col("pct") * F.col("total") - 100 * sum_before
    more = F.ceil(need / (100 * F.col("n"))).cast("bigint")
    return wanted.where((need > 0) & (F.col("pct") * F.col("total") <= 100 * F.col("sum_to"))).groupBy("pct").agg(F.min(before + more).alias("n_items"))


def gini(counts: DataFrame) -> DataFrame:
    """Inequality of the counts, 0 for equal ones."""
    ranked = _summed(_count_classes(counts), F.asc("n"), {"rank_to": F.col("items")})
    first = F.col("rank_to") - F.col("items") + 1
    weighted = F.sum((first + F.col("rank_to")).cast("double") * F.col("items") / 2 * F.col("n"))
    n, total = F.sum("items"), F.sum(F.col("n") * F.col("items"))
    return ranked.agg(((2 * weighted - (n + 1) * total) / (n * total)).alias("gini"))


def log_histogram(counts: DataFrame, bins: int = 10) -> DataFrame:
    """``bin, low, n_items``: bins of equal width on a log scale from 1 to the greatest count, the last one closed."""
    most = counts.agg(F.max("n").alias("m"))
    bin_of = F.least(F.lit(bins - 1), F.floor(F.log("n") / F.log("m") * bins + 1e-9)).cast("int")
    found = counts.crossJoin(F.broadcast(most)).groupBy(F.when(F.col("m") > 1, bin_of).otherwise(F.lit(0)).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    frame = most.select("m", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return frame.join(F.broadcast(found), "bin", "left").select("bin", F.pow(F.col("m"), F.col("bin") / bins).alias("low"), F.coalesce("c", F.lit(0)).alias("n_items"))


def sequence_length_stats(lists: DataFrame, column: str | Column, cap: int) -> DataFrame:
    """``column``: the lists' name, or their length."""
    n = F.size(column) if isinstance(column, str) else column
    sized = lists.select(n.alias("n"))
    p = exact_quantiles(sized, [], "n", {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99})
    one = sized.agg(F.avg("n").alias("mean"), F.max("n").alias("max"), F.avg((F.col("n") >= cap).cast("double")).alias("share_at_cap"))
    return one.crossJoin(F.broadcast(p)).select("mean", "p10", "p50", "p90", "p99", "max", "share_at_cap")


def distinct_buckets(df: DataFrame, columns: list[str]) -> DataFrame:
    one = df.agg(*[F.count_distinct(c).alias(c) for c in columns])
    return one.unpivot([], columns, "field", "n_distinct")


def embedding_coverage(targets: DataFrame, vectors: DataFrame) -> DataFrame:
    items = targets.select("item_id").distinct()
    has = items.join(vectors.select(F.col("item_id").alias("__v")).distinct(), items["item_id"] == F.col("__v"), "left")
    return has.agg(F.count(F.lit(1)).alias("n_items"), F.count("__v").alias("n_with_vector"), F.avg(F.col("__v").isNotNull().cast("double")).alias("coverage"))


def split_summary(ix: DataFrame) -> DataFrame:
    per_user = ix.groupBy("split", "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p"))
    items = ix.groupBy("split").agg(F.count_distinct("item_id").alias("n_items"))
    return per_user.groupBy("split").agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_users"), F.sum("p").alias("n_positive"), (F.sum("p") / F.sum("n")).alias("positive_rate"),
        F.avg("n").alias("rows_per_user"), F.avg("p").alias("positives_per_user"), F.count_if(F.col("p") > 0).alias("n_users_with_positive"), F.avg((F.col("p") > 0).cast("double")).alias("share_with_positive"),
    ).join(items, "split")


def history_summary(histories: DataFrame, column: str | Column) -> DataFrame:
    """``column``: the histories' name, or their length."""
    n = F.size(column) if isinstance(column, str) else column
    return histories.agg(
        F.count(F.lit(1)).alias("n_users"), F.sum(n).alias("n_items"), F.avg(n).alias("mean_length"), F.max(n).alias("max_length"),
        (F.sum(n) * 4).alias("bytes_int32"), (F.sum(n) * 8).alias("bytes_int64"),
    )


def shard_locality(df: DataFrame, user: str) -> DataFrame:
    """Users, and the share of users all of whose rows lie in one file."""
    files = df.groupBy(user).agg(F.count_distinct("_metadata.file_path").alias("files"))
    return files.agg(F.count(F.lit(1)).alias("n_users"), F.avg((F.col("files") == 1).cast("double")).alias("share_in_one_file"))


def column_modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """``field, value, n``: the most common value of each column, the least one on ties."""
    out = None
    for c in columns:
        counted = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
        one = counted.orderBy(F.desc("n"), "value").limit(1).select(F.lit(c).alias("field"), "value", "n")
        out = one if out is None else out.unionByName(one)
    return out


def catalogue_funnel(steps: dict[str, DataFrame]) -> DataFrame:
    """``step, stage, n_items``: distinct items at each step, in order."""
    out = None
    for i, (name, df) in enumerate(steps.items()):
        one = df.select("item_id").distinct().agg(F.lit(i).alias("step"), F.lit(name).alias("stage"), F.count(F.lit(1)).alias("n_items"))
        out = one if out is None else out.unionByName(one)
    return out


def rows_per_user(rows: DataFrame) -> DataFrame:
    n = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    p = exact_quantiles(n, [], "n", {"p50": 0.5, "p90": 0.9})
    return n.agg(F.avg("n").alias("mean"), F.max("n").alias("max")).crossJoin(F.broadcast(p)).select("mean", "p50", "p90", "max")


def behaviour_profile(log: DataFrame, meta: DataFrame) -> DataFrame:
    """Size and span of a behaviour log, groups of rows that repeat exactly, and how unequal its items are."""
    days = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / F.lit(86_400_000_000)
    base = log.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("user_id").alias("n_users"), F.count_distinct("item_id").alias("n_items"), F.count_distinct("event_type").alias("n_types"), days.alias("days"))
    cats = log.select("item_id").distinct().join(meta.select("item_id", "category"), "item_id").agg(F.count_distinct("category").alias("n_categories"))
    same = log.groupBy("user_id", "item_id", "event_type", "ts").count().agg(F.count_if(F.col("count") > 1).alias("n_duplicate_groups"))
    items = popularity(log)
    single = items.agg(F.avg((F.col("n") == 1).cast("double")).alias("singleton_share"))
    top100 = top_share(items, (100,)).select(F.col("share").alias("top100_share"))
    return base.crossJoin(cats).crossJoin(same).crossJoin(single).crossJoin(gini(items)).crossJoin(top100)


def behaviour_mix(log: DataFrame) -> DataFrame:
    counts = log.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.crossJoin(F.broadcast(total)).select("event_type", "n", (F.col("n") / F.col("t")).alias("share"))


def behaviour_funnel(log: DataFrame, stages: list[str]) -> DataFrame:
    """``stage, n_users, n_deepest, conversion``: users who reached each stage or a later one, and who stopped there."""
    code = F.lit(0)
    for i, s in enumerate(stages, 1):
        code = F.when(F.col("event_type") == s, F.lit(i)).otherwise(code)
    deepest = log.groupBy("user_id").agg(F.max(code).alias("d"))
    per = deepest.agg(*[F.count_if(F.col("d") >= i).alias(f"r{i}") for i in range(1, len(stages) + 1)], *[F.count_if(F.col("d") == i).alias(f"e{i}") for i in range(1, len(stages) + 1)])
    rows = F.array(*[
        F.struct(F.lit(s).alias("stage"), F.col(f"r{i}").alias("n_users"), F.col(f"e{i}").alias("n_deepest"), (F.col(f"r{i}") / F.col(f"r{max(1, i - 1)}")).alias("conversion"))
        for i, s in enumerate(stages, 1)
    ])
    return per.select(F.inline(rows))


LATENCY = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def latency_summary(requests: DataFrame, by: str, latency: str, approximate: bool = False) -> DataFrame:
    """Count, mean, percentiles, greatest and rate a day by endpoint; percentiles are exact, or of sketches."""
    days = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / F.lit(86_400_000_000)
    rest = requests.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(latency).alias("mean"), F.max(latency).alias("max"), (F.count(F.lit(1)) / days).alias("per_day"))
    p = merged_quantiles(quantile_sketches(requests, [by], latency), [by], LATENCY).drop("n") if approximate else exact_quantiles(requests, [by], latency, LATENCY)
    return rest.join(p, by, "left").select(by, "n", "mean", *LATENCY, "max", "per_day")


def request_counts(requests: DataFrame, endpoint: Column, status: str, values: list[str]) -> DataFrame:
    return requests.groupBy(endpoint.alias("endpoint")).pivot(status, values).agg(F.count(F.lit(1))).na.fill(0)


def schema_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rule, n_violations`` of each rule, in one pass."""
    one = df.agg(*[F.count_if(c).alias(n) for n, c in rules.items()])
    return one.unpivot([], list(rules), "rule", "n_violations")


def schema_contract(df: DataFrame, keys: list[str], onehot: str, label: str, vector: str, dim: int, required: list[str]) -> DataFrame:
    """``rule, n_violations``: rows with a null key, a one-hot list that isn't of length 2, a label other than 0 and 1, or a vector of
    another length (none counts as such), and one row for each required column that is missing."""
    rules = {
        "null_key": F.greatest(*[F.col(k).isNull() for k in keys]) if len(keys) > 1 else F.col(keys[0]).isNull(), "onehot_length": F.coalesce(F.size(onehot), F.lit(-1)) != 2,
        "label_range": ~F.coalesce(F.col(label).isin(0, 1), F.lit(False)), "vector_length": F.coalesce(F.size(vector), F.lit(-1)) != dim,
    }
    found = schema_violations(df, rules)
    for c in missing_columns(df, required):
        found = found.unionByName(df.sparkSession.range(1).select(F.lit(f"missing:{c}").alias("rule"), F.lit(1).cast("bigint").alias("n_violations")))
    return found


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def timestamp_quality(log: DataFrame, first: str, last: str) -> DataFrame:
    """Rows in and out of the valid period ``[first, last)``."""
    ok = (F.col("ts") >= F.lit(first).cast("timestamp")) & (F.col("ts") < F.lit(last).cast("timestamp"))
    return log.agg(
        F.count(F.lit(1)).alias("n_before"), F.count_if(ok).alias("n_after"), F.avg((~ok).cast("double")).alias("dropped_share"),
        F.count_distinct("user_id").alias("users_before"), F.count_distinct(F.when(ok, F.col("user_id"))).alias("users_after"),
    )


def report(sections: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """``section, metric, value`` of several frames of numbers: one-row ones, or ones whose rows a column names."""
    out = None
    for name, (df, key) in sections.items():
        cells = [c for c in df.columns if c != key]
        keys = [F.col(key).cast("string").alias("__key")] if key else []
        long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cells]).unpivot(["__key"] if key else [], cells, "metric", "value")
        metric = F.concat_ws(".", "__key", "metric") if key else F.col("metric")
        one = long.where("value is not null").select(F.lit(name).alias("section"), metric.alias("metric"), "value")
        out = one if out is None else out.unionByName(one)
    return out


def write_report(df: DataFrame, path: str) -> DataFrame:
    """Writes the report as JSON and gives what was written."""
    df.write.json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def item_rank(counts: DataFrame) -> DataFrame:
    """Items with their competition rank by count; equal counts share it."""
    classes = _descending(counts).select("n", (F.col("rank_to") - F.col("items") + 1).alias("rank"))
    return counts.join(classes, "n")


def per_user_rank(rows: DataFrame, order: list[Column]) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(*order)))
