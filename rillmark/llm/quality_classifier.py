"""Quality classifier: regularised quadratic discriminant analysis.

Transformed statistics of a document are modelled by one Gaussian a class. Each class covariance is shrunk towards the
diagonal of the pooled one, so that statistics which hardly vary in a class can't blow up its distances. The score is the
logistic of the difference of the classes' log densities and priors; the Cholesky factors are computed once and travel with
the model.

Labels are taken from at most ``SAMPLE`` rows, those with the least hashes, ties by id and label; several documents of one id give
one row to learn from, the least statistics. Defined cases: a null text is empty, all of whose statistics are 0, and is scored like
any other; texts of any length are read whole; repeated rows are scored alike; labels other than 0 and 1 are left out; with no
labels the score is 0.5, with one class it is 0 or 1; a null id is never held out; an empty table gives an empty result. Only the
text enters a score; other columns, whatever their names, are passed along in ``row``.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.llm.text import whole

#: Most labelled rows that the model is fitted on.
SAMPLE = 20_000
SHRINKAGE = 0.1
FOLDS = 5
STATISTICS = ("log_words", "word_length", "symbols", "exclamations", "capitals", "digits", "variety", "repeated_lines", "echoes")
_SYMBOLS, _UPPER, _DIGITS = b"#*$%&|<>", bytes(range(65, 91)), bytes(range(48, 58))


def statistics(text: str) -> list[float]:
    words, raw = text.split(), text.encode()
    n, size = len(words), max(len(raw), 1)
    if not n:
        return [0.0] * len(STATISTICS)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    less = lambda drop: (len(raw) - len(raw.translate(None, drop))) / size
    return [
        np.log1p(n),
        np.log(sum(map(len, words)) / n),
        np.sqrt(less(_SYMBOLS) * size / n),
        np.sqrt(text.count("!") / n),
        np.sqrt(less(_UPPER)),
        np.sqrt(less(_DIGITS)),
        np.log1p(len(set(words))) / np.log1p(n),
        np.sqrt((len(lines) - len(set(lines))) / max(len(lines), 1)),
        np.sqrt(sum(map(operator.eq, words, words[1:])) / n),
    ]


def _statistics(text: Column) -> Column:
    def of(t: pd.Series) -> pd.Series:
        return pd.Series([statistics(x) for x in t])

    return F.pandas_udf(of, "array<double>")(text)


def fold(key: Column) -> Column:
    return F.crc32(key.cast("string")) % FOLDS


@dataclass(frozen=True)
class Qda:
    """Log prior, mean, inverse Cholesky factor and half log determinant of each class that has labels."""

    classes: dict

    def score(self, x: np.ndarray) -> np.ndarray:
        if set(self.classes) != {0, 1}:
            return np.full(len(x), 0.5 if not self.classes else float(next(iter(self.classes))))
        logs = {}
        for k, (prior, mean, inverse, half_log_det) in self.classes.items():
            z = (x - mean) @ inverse.T
            logs[k] = prior - half_log_det - 0.5 * np.einsum("ij,ij->i", z, z)
        return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, shrinkage: float = SHRINKAGE, seed: int = 42) -> Qda:
    """Fits on ``labels`` (``doc_id, quality``) outside fold 0."""
    usable = labels.where("quality in (0, 1) and doc_id is not null").where(fold(F.col("doc_id")) != 0)
    chosen = usable.select(F.col("doc_id").alias("k"), F.col("quality").alias("y")).orderBy(F.xxhash64("k", F.lit(seed)), "k", "y").limit(sample)
    known = docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["k"]).select(chosen["k"].alias("id"), chosen["y"].alias("y"), _statistics(whole(docs["text"])).alias("x"))
    known = known.groupBy("id", "y").agg(F.min("x").alias("x"))  # rows of one id count once, so the sample is no larger than its bound
    d = len(STATISTICS)
    x = [F.get("x", i) for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    cells = [F.avg(c).alias(f"m{i}") for i, c in enumerate(x)] + [F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i, j in pairs]
    found = {r["y"]: r for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n"), *cells).collect()}  # two rows at most
    total = sum(r["n"] for r in found.values())
    covariances = {}
    for y, r in found.items():
        c = np.zeros((d, d))
        for i, j in pairs:
            c[i, j] = c[j, i] = r[f"c{i}_{j}"]
        covariances[y] = c
    pooled = sum((found[y]["n"] / total) * c for y, c in covariances.items()) if found else None
    classes = {}
    for y, c in covariances.items():
        shrunk = (1 - shrinkage) * c + shrinkage * np.diag(np.diag(pooled)) + 1e-4 * np.eye(d)
        factor = np.linalg.cholesky(shrunk)
        mean = np.array([found[y][f"m{i}"] for i in range(d)])
        classes[y] = (float(np.log(found[y]["n"] / total)), mean, np.linalg.inv(factor), float(np.log(np.diag(factor)).sum()))
    return Qda(classes)


def score(docs: DataFrame, model: Qda, text: str = "text") -> DataFrame:
    """``row`` (the document's columns without its text) and ``score``."""

    @F.pandas_udf("double")
    def judge(t: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(x) for x in t]).reshape(-1, len(STATISTICS))))

    return docs.select(F.struct(*[docs[c] for c in docs.columns if c != text]).alias("row"), judge(whole(docs[text])).alias("score"))
