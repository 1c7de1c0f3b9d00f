"""Benchmark decontamination by a prefix-filtered set join.

A window of an item can only occur in a document that holds all the window's shingles, so one necessary shingle suffices
to find candidates: the rarest. Shingles are ordered by their number of occurrences in the documents; each window's
rarest one is its prefix. Documents' shingles are joined with the prefixes, bounds on length and position discard
alignments without room for a window, and the words of the item-sized window are then compared one by one.

Defined cases: null texts have no words; items without words or without an id never match; repeated items count once a
distinct id; repeated documents each get their own, equal row; texts of any length are matched whole, in pieces no longer than an
item; of equally rare shingles the one with the least hash is the prefix; empty tables give zero counts or no rows; other columns,
whatever their names, are passed over or kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillmark.llm.text import ALNUM, ALNUM_ANY_CASE, ascii_lower, whole, words
from rillmark.scratch import materialize

WINDOW = 10
SHINGLE = 3
#: Tables of items and prefixes of up to so many rows, with so many words in all, are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 200_000
BROADCAST_WORDS = 4_000_000


def _item_words(items: DataFrame) -> DataFrame:
    w = items.select(items["item_id"].cast("string").alias("item_id"), words(ascii_lower(whole(items["text"])), ALNUM).alias("w"))
    w = w.where("item_id is not null and size(w) > 0")
    return w.groupBy("w").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))


def _doc_words(docs: DataFrame) -> DataFrame:
    """The words of each document under a key that equal rows share: they have equal results."""
    return docs.select(docs["doc_id"].alias("doc_id"), F.xxhash64(whole(docs["text"])).alias("text_key"), words(ascii_lower(whole(docs["text"])), ALNUM).alias("w"))


def _shingle(w: Column, at: Column, q: int) -> Column:
    return F.xxhash64(*[F.get(w, at + j) for j in range(q)])


def _doc_shingles(docs: DataFrame, q: int) -> DataFrame:
    n = F.size("w")
    return _doc_words(docs).where(n >= q).select("doc_id", "text_key", "w", F.explode(F.sequence(F.lit(0), n - q)).alias("at")).withColumn("shingle", _shingle(F.col("w"), F.col("at"), q))


def _prefixes(items: DataFrame, docs: DataFrame, q: int, window: int, small: bool) -> DataFrame:
    """``w, ids, p, shingle``: the shingles at ``p`` that some window of the item has as its rarest."""
    listed = items.select("w", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("w") - q), lambda i: _shingle(F.col("w"), i, q))).alias("p", "shingle"))
    wanted = listed.select("shingle").distinct()
    found = _doc_shingles(docs, q).select("shingle").join(F.broadcast(wanted) if small else wanted, "shingle").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    ranked = listed.join(found, "shingle", "left").groupBy("w").agg(
        F.array_sort(F.collect_list(F.struct("p", F.coalesce("n", F.lit(0)).alias("n"), "shingle"))).alias("s")
    )
    length = F.least(F.size("w"), F.lit(window))
    by_rarity = F.transform("s", lambda x: F.struct(x["n"].alias("n"), x["shingle"].alias("shingle"), x["p"].alias("p")))
    rarest = ranked.select("w", length.alias("len"), by_rarity.alias("s")).select(
        "w", F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1), lambda st: F.array_min(F.slice("s", st, F.col("len") - (q - 1))))).alias("best")
    )
    return rarest.select("w", F.explode("best").alias("b")).select(F.col("w").alias("iw"), F.col("b.p").alias("p"), F.col("b.shingle").alias("shingle"))


def _aligned(docs: DataFrame, prefixes: DataFrame, q: int, window: int, small: bool) -> DataFrame:
    """Distinct alignments of an item with a document: the words of both where they overlap."""
    size, n, p = F.size("iw"), F.size("w"), F.col("p")
    length = F.least(size, F.lit(window))
    start = F.col("at") - p
    bounds = (start + F.least(p, size - length) >= 0) & (start + F.greatest(p - (length - q), F.lit(0)) + length <= n)
    low, high = F.greatest(start, F.lit(0)), F.least(start + size, n)
    cut = ["doc_id", "text_key", low.alias("low"), F.slice("w", low + 1, high - low).alias("dw"), F.slice("iw", low - start + 1, high - low).alias("cw"), "iw"]
    shingles = _doc_shingles(docs, q)
    if small:
        found = shingles.join(F.broadcast(prefixes), "shingle").where(bounds).select(*cut)
    else:
        hits = shingles.select("doc_id", "text_key", "at", "shingle").join(prefixes, "shingle").withColumnsRenamed({"doc_id": "k", "text_key": "tk"})
        dw = _doc_words(docs)
        found = hits.join(dw, F.col("k").eqNullSafe(F.col("doc_id")) & (F.col("tk") == F.col("text_key"))).where(bounds).select(*cut)
    return found.distinct()


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, text_key, first, last, ids``: runs of document words that windows of an item cover, ends exclusive."""
    known = materialize(_item_words(items), "items")
    n_rows, n_words, sizes = known.agg(F.count(F.lit(1)), F.sum(F.size("w")), F.collect_set(F.least(F.size("w"), F.lit(SHINGLE)))).first()
    n_words, parts = n_words or 0, []
    for q in sorted(sizes):
        group = known.where(F.least(F.size("w"), F.lit(SHINGLE)) == q)
        pre = materialize(_prefixes(group, docs, q, window, n_words <= BROADCAST_WORDS), f"prefixes{q}")
        rows, held = pre.agg(F.count(F.lit(1)), F.sum(F.size("iw"))).first()
        parts.append(_aligned(docs, pre, q, window, rows <= BROADCAST_ROWS and (held or 0) <= BROADCAST_WORDS))
    if not parts:
        none = docs.select(docs["doc_id"].alias("doc_id"), F.lit(0).cast("long").alias("text_key"), F.lit(0).alias("first"), F.lit(0).alias("last"), F.array(F.lit("")).alias("ids"))
        return none.where(F.lit(False))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    same = F.zip_with("dw", "cw", lambda a, b: a == b)
    found = found.select("doc_id", "text_key", "low", F.least(F.size("iw"), F.lit(window)).alias("len"), "iw", same.alias("same"))
    edge = lambda step: F.filter(F.sequence(F.lit(0), F.size("same") - 1), lambda j: F.get("same", j) & ~F.coalesce(F.get("same", j + step), F.lit(False)))
    runs = F.filter(F.zip_with(edge(-1), edge(1), lambda a, b: F.struct(a.alias("a"), (b + 1).alias("b"))), lambda r: r["b"] - r["a"] >= F.col("len"))
    found = found.select("doc_id", "text_key", "low", "iw", F.explode(runs).alias("r"))
    hit = found.select("doc_id", "text_key", (F.col("low") + F.col("r.a")).alias("first"), (F.col("low") + F.col("r.b")).alias("last"), "iw")
    small = n_rows <= BROADCAST_ROWS and n_words <= BROADCAST_WORDS
    ids = known.withColumnRenamed("w", "iw")
    return hit.join(F.broadcast(ids) if small else ids, "iw").drop("iw")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row a document: ``doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated``."""
    found = materialize(occurrences(docs, items, window), "occurrences")
    key = ["doc_id", "text_key"]
    before = W.partitionBy(*key).orderBy("first", "last").rowsBetween(W.unboundedPreceding, -1)
    spans = found.select(*key, "first", "last").distinct().withColumn("upto", F.max("last").over(before))
    fresh = F.greatest(F.lit(0), F.col("last") - F.greatest("first", F.coalesce("upto", F.lit(0))))
    hits = spans.groupBy(*key).agg(F.sum(fresh).cast("long").alias("n_hit"))
    listed = found.select(*key, F.explode("ids").alias("id")).distinct().groupBy(*key).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    both = hits.join(listed, [hits["doc_id"].eqNullSafe(listed["doc_id"]), hits["text_key"] == listed["text_key"]]).select(
        hits["doc_id"].alias("k"), hits["text_key"].alias("tk"), "n_hit", "ids"
    )
    n_words = F.size(words(docs["text"], ALNUM_ANY_CASE)).cast("long")
    counted = docs.select(docs["doc_id"].alias("doc_id"), F.xxhash64(whole(docs["text"])).alias("text_key"), n_words.alias("n_words"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return counted.join(both, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("text_key") == F.col("tk")), "left").select(
        *key, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents in which no window of any item occurs, with their own columns."""
    bad = occurrences(docs, items, window).select(F.col("doc_id").alias("k"), F.col("text_key").alias("tk")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["k"]) & (F.xxhash64(whole(docs["text"])) == bad["tk"]), "left_anti")
