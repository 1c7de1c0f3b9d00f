"""Scores of candidate rows: popularity, content similarity, attention, and models fitted with Spark ML."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.functions.expr import cosine, hash_unit, l2_normalise, norm

NO_HISTORY = float("-inf")
#: A user's candidates are cut into parts of about so many rows; the place of candidates behind any history.
MANY, CANDIDATE = 10_000, 1_000_000
#: Vectors of up to so many bytes are broadcast.
BROADCAST_BYTES = 64 << 20
#: Ids of up to so many items are broadcast.
BROADCAST_ROWS = 1_000_000
#: Scores are compared after rounding, so that sums in another order don't change the order of ties.
DIGITS = 9


def score_random(rows: DataFrame, seed: int = 42) -> DataFrame:
    return rows.withColumn("score", hash_unit(seed, F.col("user_id"), F.col("item_id")))


def _by_count(rows: DataFrame, train: DataFrame, key: str) -> DataFrame:
    counts = train.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return rows.join(counts, key, "left").withColumn("score", F.log1p(F.coalesce("__n", F.lit(0)))).drop("__n")


def score_global_pop(rows: DataFrame, train: DataFrame) -> DataFrame:
    return _by_count(rows, train, "item_id")


def score_positive_pop(rows: DataFrame, train: DataFrame) -> DataFrame:
    return _by_count(rows, train.where("label = 1"), "item_id")


def score_category_pop(rows: DataFrame, train: DataFrame, meta: DataFrame) -> DataFrame:
    cats = meta.select("item_id", "category")
    counted = _by_count(rows.join(cats, "item_id", "left"), train.where("label = 1").join(cats, "item_id"), "category")
    return counted.drop("category")


def pop_with_category(rows: DataFrame, train: DataFrame, meta: DataFrame, alpha: float = 0.5) -> DataFrame:
    a = score_positive_pop(rows, train).withColumnRenamed("score", "__a")
    return score_category_pop(a, train, meta).withColumn("score", F.col("__a") + alpha * F.col("score")).drop("__a")


def _user_streams(rows: DataFrame, histories: DataFrame, vectors: DataFrame, last: int, carry: tuple[str, ...] = (), among: DataFrame | None = None) -> DataFrame:
    """Each user's last items and then their candidates, as one sorted stream: ``user_id, salt, place, item_id, vec, length, times`` and the
    carried columns. ``place`` is the item's place in the history, and ``CANDIDATE`` for candidates. Vectors have unit length, and ``length`` was theirs; unknown
    items have none, and those of a history are one row, with their number as ``times``. Candidates of users with more than ``MANY`` of them are spread
    over salts, each with the history.

    Vectors of up to ``BROADCAST_BYTES`` meet the stream once it is sorted, so that keys alone are shuffled. ``rows`` are read twice; ``among`` are the same
    candidates where they are cheaper to count."""
    unit = vectors.select("item_id", l2_normalise(F.col("vec")).alias("vec"), norm(F.col("vec")).alias("length"))
    held = vectors.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("vec") * 8 + 24).alias("bytes")).first()
    ids = vectors.select("item_id", F.lit(True).alias("known"))
    ids = F.broadcast(ids) if held["n"] <= BROADCAST_ROWS else ids
    n = (rows if among is None else among).groupBy("user_id").agg(F.count(F.lit(1)).alias("__n")).select("user_id", F.ceil(F.col("__n") / MANY).cast("int").alias("salts"))
    many = n.where(F.col("salts") > 1)  # at most one row in MANY: its size decides how it is joined
    salts = F.coalesce("salts", F.lit(1))
    recent = F.slice("history", -F.least(F.size("history"), F.lit(last)), last)
    wanted = histories.where(F.size("history") > 0).join(n, "user_id")
    flat = wanted.select("user_id", "salts", F.posexplode(recent).alias("place", "item_id")).join(ids, "item_id", "left")
    thin = flat.groupBy("user_id", "salts", F.when(F.col("known"), F.col("place")).otherwise(-1).alias("place")).agg(F.any_value("item_id").alias("item_id"), F.count(F.lit(1)).alias("times"))
    nothing = [F.lit(None).cast(dict(rows.dtypes)[c]).alias(c) for c in carry]
    seen = thin.select("user_id", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "place", "item_id", "times", *nothing)
    placed = rows.select("user_id", "item_id", *carry).join(many, "user_id", "left")
    salt = F.pmod(F.xxhash64("item_id"), salts).cast("int")
    asked = placed.select("user_id", salt.alias("salt"), F.lit(CANDIDATE).alias("place"), "item_id", F.lit(1).cast("bigint").alias("times"), *carry)
    both = seen.unionByName(asked)
    order = ["user_id", "salt", "place"]
    if (held["bytes"] or 0) > BROADCAST_BYTES:
        return both.join(unit, "item_id", "left").repartition("user_id", "salt").sortWithinPartitions(*order)
    # numbered, since Spark leaves out a sort that lies straight under a join
    placed = both.repartition("user_id", "salt").sortWithinPartitions(*order).withColumn("number", F.monotonically_increasing_id())
    return placed.join(F.broadcast(unit), "item_id", "left")


def _scored_streams(batches: Iterator[pd.DataFrame], emit, carry: tuple[str, ...] = ()) -> Iterator[pd.DataFrame]:
    """Reads ``_user_streams``, holding one history at a time, and hands each run of candidates to ``emit(columns, vectors,
    history)``, where the history has ``place, item_id, known, length, times`` and ``matrix``. It gives new columns of the candidates, or of those
    that ``row`` counts among them; frames are made once a batch, since most users have few rows."""
    now, held, dim = None, [], 1
    kept = ["user_id", "item_id", *carry]

    def wide(matrix: np.ndarray) -> np.ndarray:
        return matrix if matrix.shape[1] == dim else np.zeros((len(matrix), dim))  # written before any vector was known

    for b in batches:
        if not len(b):
            continue
        known = b["vec"].notna().to_numpy()
        found = np.stack(b["vec"].to_numpy()[known]) if known.any() else np.zeros((0, dim))
        dim = found.shape[1]
        matrix = np.zeros((len(b), dim))
        matrix[known] = found
        user, salt, place, item = (b[c].to_numpy() for c in ("user_id", "salt", "place", "item_id"))
        times = b["times"].to_numpy() if "times" in b else np.ones(len(b), dtype=np.int64)
        length, columns = np.where(known, b["length"].to_numpy(dtype=float), 0.0), {c: b[c].to_numpy() for c in kept}
        starts = np.flatnonzero(np.r_[True, (user[1:] != user[:-1]) | (salt[1:] != salt[:-1])])
        ends = np.r_[starts[1:], len(b)]
        olds = starts + np.add.reduceat((place < CANDIDATE).astype(np.int64), starts)
        at, new = [], []
        for s, m, e, key in zip(starts.tolist(), olds.tolist(), ends.tolist(), zip(user[starts].tolist(), salt[starts].tolist(), strict=True), strict=True):
            if key != now:
                now, held = key, []
            if m > s or not held:
                held.append((place[s:m], item[s:m], known[s:m], length[s:m], times[s:m], matrix[s:m]))
            if e > m:
                parts = list(zip(*held, strict=True))
                whole = [x[0] if len(x) == 1 else np.concatenate(x) for x in parts[:5]]
                h = wide(held[0][5]) if len(held) == 1 else np.concatenate([wide(x) for x in parts[5]])
                got = emit({c: x[m:e] for c, x in columns.items()}, matrix[m:e], dict(zip(("place", "item_id", "known", "length", "times"), whole, strict=True), matrix=h))
                at.append(m + got.pop("row") if "row" in got else np.arange(m, e))
                new.append(got)
        if new:
            joined = {c: np.concatenate([x[c] for x in new]) for c in new[0]}
            yield b[kept].take(np.concatenate(at)).reset_index(drop=True).assign(**{c: list(x) if x.ndim > 1 else x for c, x in joined.items()})


def score_content_knn(rows: DataFrame, histories: DataFrame, vectors: DataFrame, last: int = 200, how: str = "max") -> DataFrame:
    """Greatest (or mean) cosine of the candidate with the user's last items; unknown items count as zero vectors, and users
    without a history score minus infinity. One matrix product a user and batch."""

    def emit(cand: dict, vecs: np.ndarray, history: dict) -> dict:
        sims = vecs @ history["matrix"].T
        return {"score": np.full(len(vecs), NO_HISTORY) if not sims.shape[1] else sims.max(1) if how == "max" else sims.sum(1) / history["times"].sum()}

    carry = tuple(c for c in rows.columns if c not in ("user_id", "item_id"))
    types = T.StructType([*rows.select("user_id", "item_id", *carry).schema.fields, T.StructField("score", T.DoubleType())])
    return _user_streams(rows, histories, vectors, last, carry).mapInPandas(partial(_scored_streams, emit=emit, carry=carry), types).select(*rows.columns, "score")


def score_pooled_cosine(rows: DataFrame, user_vectors: DataFrame, vectors: DataFrame) -> DataFrame:
    u = user_vectors.select("user_id", F.col("vec").alias("__u"))
    v = vectors.select("item_id", F.col("vec").alias("__v"))
    both = rows.join(v, "item_id", "left").join(u, "user_id", "left")
    return both.withColumn("score", F.coalesce(cosine(F.col("__u"), F.col("__v")), F.lit(0.0))).drop("__u", "__v")


def history_search(rows: DataFrame, histories: DataFrame, vectors: DataFrame, k: int, last: int = 200) -> DataFrame:
    """``user_id, item_id, pos, history_item, sim, rank``: the ``k`` known history items most like each candidate."""

    def emit(cand: dict, vecs: np.ndarray, history: dict) -> dict:
        known = history["known"]
        sims, place, item = vecs @ history["matrix"][known].T, history["place"][known], history["item_id"][known]
        order = np.lexsort((np.broadcast_to(place, sims.shape), -sims.round(9)))[:, :k]
        row, rank = np.repeat(np.arange(len(vecs)), order.shape[1]), np.tile(np.arange(1, order.shape[1] + 1), len(vecs))
        at = order.ravel()
        return {"row": row, "pos": place[at], "history_item": item[at], "sim": sims[row, at], "rank": rank}

    schema = "user_id long, item_id long, pos int, history_item long, sim double, rank int"
    return _user_streams(rows, histories, vectors, last).mapInPandas(partial(_scored_streams, emit=emit), schema)


def _attention(vecs: np.ndarray, history: dict, allowed: np.ndarray, k: int | None = None) -> np.ndarray:
    """Each candidate's mean of history vectors under softmax weights of the scaled products; zero where none is allowed."""
    h = history["matrix"]
    if not len(h):
        return np.zeros(vecs.shape)
    logits = np.where(allowed, (vecs @ h.T) * np.sqrt(h.shape[1]), -np.inf)
    if k is not None and k < logits.shape[1]:
        logits = np.where(np.argsort(np.argsort(-logits, axis=1, kind="stable"), axis=1) < k, logits, -np.inf)
    top = logits.max(1, keepdims=True)
    w = np.exp(logits - np.where(np.isfinite(top), top, 0.0))
    return (w @ h) / np.maximum(w.sum(1, keepdims=True), 1e-300)


def target_attention(rows: DataFrame, histories: DataFrame, vectors: DataFrame, last: int = 200, k: int | None = None) -> DataFrame:
    """``user_id, item_id, vec``: the attention vector of each candidate over the known history items, or over the ``k`` most
    like it; the zero vector for users without any."""

    def emit(cand: dict, vecs: np.ndarray, history: dict) -> dict:
        return {"vec": _attention(vecs, history, np.broadcast_to(history["known"], (len(vecs), len(history["known"]))), k)}

    return _user_streams(rows, histories, vectors, last).mapInPandas(partial(_scored_streams, emit=emit), "user_id long, item_id long, vec array<double>")


def history_features(rows: DataFrame, histories: DataFrame, vectors: DataFrame, last: int = 200, own: str = "own", among: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``pooled_cosine, max_similarity, attention``: likeness of each candidate to the user's known history:
    to its mean, its most similar item, and its attention vector. Where the column ``own`` is true the candidate's own item is
    left out of the history: the row is one that the history was made of. ``among``: see ``_user_streams``."""

    def emit(cand: dict, vecs: np.ndarray, history: dict) -> dict:
        h = history["matrix"]
        allowed = np.broadcast_to(history["known"], (len(vecs), len(h))) & ~(cand[own].astype(bool)[:, None] & (cand["item_id"][:, None] == history["item_id"]))
        sims = vecs @ h.T
        most = np.where(allowed, sims, -np.inf).max(1, initial=-np.inf)
        pooled = allowed.astype(float) @ h
        length = np.linalg.norm(pooled, axis=1) * np.linalg.norm(vecs, axis=1)
        cosine_ = np.where(length > 1e-12, (pooled * vecs).sum(1) / np.maximum(length, 1e-300), 0.0)
        return {"pooled_cosine": cosine_, "max_similarity": np.where(np.isfinite(most), most, 0.0), "attention": (_attention(vecs, history, allowed) * vecs).sum(1)}

    carry = tuple(c for c in rows.columns if c not in ("user_id", "item_id"))
    new = [T.StructField(c, T.DoubleType()) for c in ("pooled_cosine", "max_similarity", "attention")]
    types = T.StructType([*rows.select("user_id", "item_id", *carry).schema.fields, *new])
    return _user_streams(rows, histories, vectors, last, carry, among).mapInPandas(partial(_scored_streams, emit=emit, carry=carry), types)


def leave_one_out_means(rows: DataFrame, histories: DataFrame, vectors: DataFrame, last: int = 1000, among: DataFrame | None = None) -> DataFrame:
    """``rows``, whose items are known, with ``u``, the direction of the mean of the user's known history without the row's own item (zero if nothing is
    left), and ``v``, that of the item, in single precision; rows of users without a known history item are left out. ``among``: see ``_user_streams``."""

    def emit(cand: dict, vecs: np.ndarray, history: dict) -> dict:
        known = history["known"]
        if not known.any():
            none = np.zeros((0, vecs.shape[1]), dtype=np.float32)
            return {"row": np.zeros(0, dtype=np.int64), "u": none, "v": none}
        rest = (cand["item_id"][:, None] != history["item_id"][known]).astype(float) @ history["matrix"][known]
        length = np.sqrt((rest * rest).sum(1, keepdims=True))
        return {"row": np.arange(len(vecs)), "u": np.divide(rest, length, out=np.zeros_like(rest), where=length > 0).astype(np.float32), "v": vecs.astype(np.float32)}

    carry = tuple(c for c in rows.columns if c not in ("user_id", "item_id"))
    types = T.StructType([*rows.select("user_id", "item_id", *carry).schema.fields, *[T.StructField(c, T.ArrayType(T.FloatType())) for c in ("u", "v")]])
    return _user_streams(rows, histories, vectors, last, carry, among).mapInPandas(partial(_scored_streams, emit=emit, carry=carry), types)


#: The scorers that ``score_wide`` computes together.
TOGETHER = ("random", "global_pop", "positive_pop", "category_pop", "pop_with_category", "content_knn", "content_knn_mean", "pooled_cosine", "attention")
#: What an empty history scores where a score is stored.
LOWEST = -1e9


def _likeness(cand: dict, vecs: np.ndarray, history: dict) -> dict:
    """The four scores of ``TOGETHER`` that look at the history. Unknown items only count as zeros: products are with known ones."""
    known = history["known"]
    n = int(history["times"].sum()) if "times" in history else len(known)
    none = np.zeros(len(vecs))
    if not n:
        low = np.full(len(vecs), LOWEST)
        return {"content_knn": low, "content_knn_mean": low, "pooled_cosine": none, "attention": none}
    h = history["matrix"][known]
    if not len(h):
        return {"content_knn": none, "content_knn_mean": none, "pooled_cosine": none, "attention": none}
    sims = vecs @ h.T
    most = sims.max(1)
    w = np.exp((sims - most[:, None]) * math.sqrt(h.shape[1]))
    pooled = history["length"][known] @ h
    size = math.sqrt(pooled @ pooled)
    return {
        "content_knn": most if len(h) == n else np.maximum(most, 0.0), "content_knn_mean": sims.sum(1) / n,
        "pooled_cosine": vecs @ pooled / size if size > 0 else none, "attention": (w * sims).sum(1) / w.sum(1),
    }


def score_wide(rows: DataFrame, train: DataFrame, meta: DataFrame, histories: DataFrame, vectors: DataFrame, last: int = 200, alpha: float = 0.5) -> DataFrame:
    """``rows`` with a column a scorer: what each of them gives on its own, by one join of the counts and one pass over the users' histories.
    ``train`` is read twice."""
    counts = train.groupBy("item_id").agg(F.count(F.lit(1)).alias("__n"), F.count_if(F.col("label") == 1).alias("__p"))
    cats = meta.select("item_id", "category")
    by_category = counts.join(cats, "item_id").groupBy("category").agg(F.sum("__p").alias("__k"))  # from counts: a row an item
    log_of = lambda c: F.log1p(F.coalesce(c, F.lit(0)))
    item = cats.join(by_category, "category", "left").join(counts, "item_id", "full").select("item_id", log_of("__n").alias("global_pop"), log_of("__p").alias("positive_pop"), log_of("__k").alias("category_pop"))
    named = rows.join(item, "item_id", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("global_pop", "positive_pop", "category_pop")})
    counted = named.withColumns({"random": hash_unit(42, F.col("user_id"), F.col("item_id")), "pop_with_category": F.col("positive_pop") + alpha * F.col("category_pop")})
    carry = tuple(c for c in counted.columns if c not in ("user_id", "item_id"))

    new = [T.StructField(c, T.DoubleType()) for c in TOGETHER if c not in carry]
    types = T.StructType([*counted.select("user_id", "item_id", *carry).schema.fields, *new])
    return _user_streams(counted, histories, vectors, last, carry, rows).mapInPandas(partial(_scored_streams, emit=_likeness, carry=carry), types)


def long_scores(wide: DataFrame, models: tuple[str, ...] = TOGETHER) -> DataFrame:
    """``model, user_id, item_id, label, score`` of a row with a column a model."""
    listed = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("score")) for m in models])
    return wide.select("user_id", "item_id", "label", F.inline(listed)).select("model", "user_id", "item_id", "label", "score")


def score_all(models: dict[str, DataFrame]) -> DataFrame:
    """``model, user_id, item_id, label, score`` of several scorers over the same rows."""
    out = None
    for name, df in models.items():
        one = df.select(F.lit(name).alias("model"), "user_id", "item_id", "label", "score")
        out = one if out is None else out.unionByName(one)
    return out


def fit_pointwise_ranker(features: DataFrame, columns: list[str], weight: float | None = None, seed: int = 42, trees: int = 0):
    """A logistic model on candidate features, or so many boosted trees; ``weight`` goes to the positive rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    weighted = features.withColumn("__weight", F.when(F.col("label") == 1, F.lit(float(weight or 1.0))).otherwise(1.0))
    gather, common = VectorAssembler(inputCols=columns, outputCol="__raw"), {"labelCol": "label", "weightCol": "__weight"}
    if trees:
        stages = [gather, GBTClassifier(featuresCol="__raw", maxIter=trees, maxDepth=4, stepSize=0.2, subsamplingRate=0.8, seed=seed, **common)]
    else:
        stages = [gather, StandardScaler(inputCol="__raw", outputCol="__x"), LogisticRegression(featuresCol="__x", regParam=0.01, **common)]
    return Pipeline(stages=stages).fit(weighted)


def score_pointwise(model, features: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(features.withColumn("__weight", F.lit(1.0))).withColumn("score", F.get(vector_to_array("probability"), 1))


def fit_retrieval_factors(clicked: DataFrame, rank: int = 16, seed: int = 42):
    """User and item vectors learned from clicks by alternating least squares."""
    from pyspark.ml.recommendation import ALS

    als = ALS(userCol="user_id", itemCol="item_id", ratingCol="label", rank=rank, implicitPrefs=True, seed=seed, maxIter=5)
    return als.fit(clicked.select(F.col("user_id").cast("int"), F.col("item_id").cast("int"), F.col("label").cast("float")))


def blocked_topk(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """Rows of a user block and an item block: the block's best ``k`` items of each user, by one matrix product; ties go to
    the smaller item."""
    for b in batches:
        for users, uvecs, items, ivecs in zip(b["users"], b["uvecs"], b["items"], b["ivecs"], strict=True):
            items = np.asarray(items)
            order = np.argsort(items, kind="stable")
            scores = np.stack(list(uvecs)) @ np.stack(list(ivecs))[order].T
            best = np.argsort(-scores.round(DIGITS), axis=1, kind="stable")[:, :k]
            yield pd.DataFrame({"user_id": np.repeat(np.asarray(users), best.shape[1]), "item_id": items[order][best.ravel()], "score": np.take_along_axis(scores, best, 1).ravel()})


#: Pairs whose vectors are multiplied in double precision at once, and columns of a block of products in single precision.
PAIRS, WIDE = 1 << 15, 2048


def pair_products(u: np.ndarray, v: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Inner products of the named pairs."""
    return np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", u[rows[s : s + PAIRS]], v[at[s : s + PAIRS]]) for s in range(0, len(rows), PAIRS)]])


def _places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns where the mask holds, which is seldom: eight places are looked at together."""
    flat = mask.reshape(-1)
    if flat.size % 8:
        return np.nonzero(mask)
    some = np.flatnonzero(flat.view(np.uint64))
    group, place = np.nonzero(flat.reshape(-1, 8)[some])
    return np.divmod(some[group] * 8 + place, mask.shape[1])


class Side:
    """Vectors of one side of a product: as they are, in single precision, and their lengths. ``plain`` unless single precision could overflow."""

    def __init__(self, vecs: np.ndarray):
        self.vecs = vecs
        with np.errstate(over="ignore", invalid="ignore"):
            self.single, self.length = vecs.astype(np.float32), np.sqrt(np.einsum("ij,ij->i", vecs, vecs))
        self.plain = bool(np.isfinite(self.length).all() and (not len(vecs) or self.length.max() < 1e12))

    def __getitem__(self, part) -> Side:
        out = Side.__new__(Side)
        out.vecs, out.single, out.length, out.plain = self.vecs[part], self.single[part], self.length[part], self.plain
        return out


class BestRows:
    """Of each of the users its best ``k`` over blocks of items, in ``held`` as ``row, item, score`` and the further columns that were offered, sorted by row and place
    once ``settled``; ties go to the smaller item.

    Products of a block are made in single precision and held against the user's k-th score, less all that their rounding can amount to. Those that may reach it, few
    of a block, are made again in double precision, which alone decides. They wait until there are as many as are held, so that lists are sorted a few times only."""

    def __init__(self, users: Side, k: int, more: int = 0):
        self.users, self.k, self.least = users, k, np.full(len(users.vecs), -np.inf)
        self.held = [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), *[np.zeros(0) for _ in range(1 + more)]]
        self.waiting: list[list[np.ndarray]] = []

    def offer(self, block: Side, items: np.ndarray, rows: np.ndarray | None = None, allowed=None, masked=None, more=None, products: np.ndarray | None = None) -> None:
        """The block's items to all users, or to ``rows``. ``allowed(row, at)``: which pairs count, and ``masked(columns)`` the same as a matrix for the first ones;
        ``more(row, at)``: further columns. ``products``: those of all users with the block in single precision, where others need them too."""
        users = self.users if rows is None else self.users[rows]
        if not (users.plain and block.plain):
            scores = users.vecs @ block.vecs.T
            scores = np.where(np.isnan(scores), -np.inf, scores)
            row, at = np.nonzero(np.ones(scores.shape, dtype=bool))
            return self._take(row if rows is None else rows[row], at, items, scores[row, at], allowed, more)
        slack = (block.vecs.shape[1] + 4) * 2.0**-23 * users.length * (block.length.max() if len(items) else 0.0) + 1e-30
        for s in range(0, len(items), WIDE):
            part = slice(s, s + WIDE)
            scores = users.single @ block.single[part].T if products is None else np.ascontiguousarray(products[:, part])
            bar = self.least if rows is None else self.least[rows]
            none = np.flatnonzero(bar == -np.inf)
            if scores.shape[1] >= self.k and len(none):
                counted = scores[none] if masked is None else np.where(masked(part)[none], scores[none], -np.inf)
                bar = bar.copy()
                bar[none] = np.partition(counted, -self.k, axis=1)[:, -self.k] - slack[none]
            bar = bar - 10.0**-DIGITS
            row, at = _places(scores >= np.nextafter((bar - slack).astype(np.float32), np.float32(-np.inf))[:, None])
            at = at + s
            if allowed is not None:
                kept = allowed(row if rows is None else rows[row], at)
                row, at = row[kept], at[kept]
            score = pair_products(users.vecs, block.vecs, row, at)
            reach = score >= bar[row]
            row, at, score = row[reach], at[reach], score[reach]
            self._take(row if rows is None else rows[row], at, items, score, None, more)

    def _take(self, row: np.ndarray, at: np.ndarray, items: np.ndarray, score: np.ndarray, allowed, more) -> None:
        if allowed is not None:
            kept = allowed(row, at)
            row, at, score = row[kept], at[kept], score[kept]
        if len(row):
            self.waiting.append([row, items[at], score, *([] if more is None else more(row, at))])
            if sum(len(w[0]) for w in self.waiting) >= max(len(self.held[0]), len(self.least) * self.k // 2):
                self.settled()

    def settled(self) -> list[np.ndarray]:
        if self.waiting:
            joined = [np.concatenate(x) for x in zip(self.held, *self.waiting, strict=True)]
            self.waiting = []
            order = np.lexsort((joined[1], -joined[2].round(DIGITS), joined[0]))
            sorted_ = joined[0][order]
            place = np.arange(len(order)) - np.searchsorted(sorted_, sorted_)
            self.held = [x[order[place < self.k]] for x in joined]
            last = order[place == self.k - 1]
            self.least[joined[0][last]] = joined[2][last].round(DIGITS)
        return self.held


def merged_topk(batches: Iterator[pd.DataFrame], k: int, chunk: int = 512) -> Iterator[pd.DataFrame]:
    """Rows of a user block, ``part``, with one item block after another, vectors laid end to end: each user's best ``k`` over all of them, with ``rank``; ties go to
    the smaller item. One block of users is held with its lists."""
    now, users, held = None, np.zeros(0), []

    def lists() -> pd.DataFrame:
        row, item, score = (np.concatenate(x) for x in zip(*[(r + s, i, x) for s, (r, i, x) in ((s, h.settled()) for s, h in held)], strict=True))
        return pd.DataFrame({"user_id": users[row], "item_id": item, "score": score, "rank": np.arange(len(row)) - np.searchsorted(row, row) + 1})

    for b in batches:
        for part, ids, uvecs, items, ivecs in zip(b["part"], b["users"], b["uvecs"], b["items"], b["ivecs"], strict=True):
            if part != now:
                if now is not None:
                    yield lists()
                now, users = part, np.asarray(ids)
                side = Side(np.asarray(uvecs).reshape(len(ids), -1))
                held = [(s, BestRows(side[s : s + chunk], k)) for s in range(0, len(users), chunk)]
            items = np.asarray(items)
            block = Side(np.asarray(ivecs).reshape(len(items), -1))
            for _, h in held:
                h.offer(block, items)
    if now is not None:
        yield lists()
