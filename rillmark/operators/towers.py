"""Retrieval learned from clicks: two linear towers, a sampled softmax over each batch, and averages of what the tasks learn.

A user's content vector and an item's are each multiplied by a matrix; the towers start as content similarity and learn from there what of it
predicts clicks. In a batch of clicked rows the items of the other rows are negatives, but for rows of the same user or
item, and each item's logit is lowered by the log of its share of clicks, since popular items are drawn as negatives more often. The
matrices are all that is learned, so a model is as large as the vectors are wide, whatever the numbers of users and items: tasks
start an epoch from one copy each, take whole batches step by step, and their matrices are averaged at its end."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.scratch import Scratch

#: Matrices in the order in which they are laid end to end.
SIDES = ("user", "item")


@dataclass(frozen=True)
class Towers:
    """``weights[side]``: dimension x width; ``scale`` multiplies products while learning."""

    weights: dict[str, np.ndarray]
    scale: float

    def project(self, vectors: DataFrame, key: str, side: str) -> DataFrame:
        """``key, vec`` in the learned space."""
        w = self.weights[side]

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield pd.DataFrame({key: b[key], "vec": list(np.stack(b["vec"].to_list()) @ w)})

        return vectors.select(F.col(key).cast("long").alias(key), "vec").mapInPandas(each, f"{key} long, vec array<double>")


def batch_loss(u: np.ndarray, v: np.ndarray, users: np.ndarray, items: np.ndarray, log_q: np.ndarray, weights: list[np.ndarray], scale: float) -> tuple[float, list[np.ndarray]]:
    """Mean loss of a batch whose right answers lie on the diagonal, and its gradients by the two matrices."""
    a, b = u @ weights[0], v @ weights[1]
    logits = scale * (a @ b.T) - log_q[None, :]
    clash = (users[:, None] == users[None, :]) | (items[:, None] == items[None, :])
    np.fill_diagonal(clash, False)
    logits = np.where(clash, -np.inf, logits)
    shifted = logits - logits.max(1, keepdims=True)
    p = np.exp(shifted)
    total = p.sum(1, keepdims=True)
    loss = float((np.log(total[:, 0]) - np.diag(shifted)).mean())
    g = (p / total - np.eye(len(u))) * (scale / len(u))
    return loss, [u.T @ (g @ b), v.T @ (g.T @ a)]


def _learn(batches: Iterator[pd.DataFrame], weights: list[np.ndarray], batch: int, scale: float, rate: float, decay: float) -> Iterator[pd.DataFrame]:
    """Rows in the epoch's order: one step for each ``batch`` of them, and one for the rest, with gradients scaled by the roots of their running squares. Out come the task's matrices, the number
    of its steps and the sum of its losses."""
    now = [w.copy() for w in weights]
    moved = [np.full(w.shape, 1e-8) for w in weights]
    held: dict[str, np.ndarray] | None = None
    steps, losses = 0, 0.0

    def step(x: dict[str, np.ndarray]) -> None:
        nonlocal steps, losses
        if len(x["user_id"]) < 2:
            return
        u, v = (np.stack(list(x[c])).astype(float) for c in ("u", "v"))
        loss, grads = batch_loss(u, v, x["user_id"], x["item_id"], x["log_q"], now, scale)
        for w, m, g, start in zip(now, moved, grads, weights, strict=True):
            g = g + decay * (w - start)
            m += g * g
            w -= rate * g / np.sqrt(m)
        steps, losses = steps + 1, losses + loss

    for b in batches:
        rows = {c: b[c].to_numpy() if held is None else np.concatenate([held[c], b[c].to_numpy()]) for c in b.columns}
        whole = len(rows["user_id"]) // batch * batch
        for start in range(0, whole, batch):
            step({c: x[start : start + batch] for c, x in rows.items()})
        held = {c: x[whole:] for c, x in rows.items()}
    if held is not None:
        step(held)
    if steps:
        yield pd.DataFrame({"flat": [np.concatenate([w.ravel() for w in now])], "steps": [float(steps)], "losses": [losses]})


def fit_towers(pairs: DataFrame, width: int | None = None, epochs: int = 4, batch: int = 128, rate: float = 0.02, scale: float = 8.0, decay: float = 1e-4, tasks: int = 8, seed: int = 42, losses: list[float] | None = None) -> Towers:
    """``pairs``: ``user_id, item_id, u, v, log_q`` of clicked rows. Every epoch shuffles them anew, by a seeded hash of their keys, over ``tasks`` that
    learn side by side in steps of ``batch`` rows: fewer learn more between averages, more are faster. A row with its vectors goes through one shuffle an
    epoch, in single precision. The mean loss of each epoch is added to ``losses``."""
    with Scratch(pairs.sparkSession, "towers") as space:
        pairs = space.keep(pairs.select("user_id", "item_id", F.col("u").cast("array<float>").alias("u"), F.col("v").cast("array<float>").alias("v"), "log_q"), "pairs")
        first = pairs.select(F.size("u").alias("d")).first()
        if first is None:
            raise ValueError("no clicked rows to learn from")
        dim, tasks = first["d"], max(1, min(tasks, pairs.count() // batch))  # a task has a whole batch or more
        rng = np.random.default_rng(seed)
        width = width or dim
        weights = [np.eye(dim, width) + rng.normal(scale=1e-3, size=(dim, width)) for _ in SIDES]
        for epoch in range(epochs):
            keyed = pairs.withColumn("__o", F.xxhash64(F.lit(seed + epoch), "user_id", "item_id"))
            rows = keyed.repartition(tasks, "__o").sortWithinPartitions("__o", "user_id", "item_id").drop("__o")
            work = partial(_learn, weights=weights, batch=batch, scale=scale, rate=rate, decay=decay)
            learned = rows.mapInPandas(work, "flat array<double>, steps double, losses double")
            mean = learned.agg(Summarizer.mean(array_to_vector("flat"), F.col("steps")).alias("m"), F.sum("steps").alias("steps"), F.sum("losses").alias("losses")).select(vector_to_array("m").alias("m"), "steps", "losses").first()
            flat = np.array(mean["m"])
            weights = [flat[: dim * width].reshape(dim, width), flat[dim * width :].reshape(dim, width)]
            if losses is not None:
                losses.append(mean["losses"] / mean["steps"])
        return Towers(dict(zip(SIDES, weights, strict=True)), scale)
