"""Bounded samples of labelled documents, and a small logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_of

#: Folds by a checksum of the id; fold 0 is held out.
FOLDS = 5


def fold(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS


def training_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text, y, weight`` of at most ``per_class`` labelled rows of either class
    outside the held-out fold: those whose id has the smallest hashes.  The ids
    are broadcast, and ``per_class`` bounds them.  ``weight`` is how many labelled
    ids of its class a row stands for, so that weighted classes have the shares
    of all labels; it is 1 where a class is below the bound."""
    marked = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y"))
    marked = marked.filter(F.col("id").isNotNull() & F.col("y").isin(0, 1)).filter(fold("id") != 0)
    order = [F.xxhash64("id"), F.col("id")]
    chosen = [marked.filter(F.col("y") == y).dropDuplicates(["id"]).orderBy(*order).limit(per_class) for y in (0, 1)]
    counts = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.countDistinct("id").alias("n")).collect()}
    weight = [max(1.0, counts.get(y, 0) / per_class) for y in (0, 1)]
    chosen = [c.withColumn("weight", F.lit(w)) for c, w in zip(chosen, weight)]
    chosen = chosen[0].unionByName(chosen[1])
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    sample = texts.join(F.broadcast(chosen), "id").select("id", "text", "y", "weight")
    return materialise(sample, f"sample-{label}")


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 30, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights, the intercept last, by Newton steps with a ridge penalty.  A row of
    ``weight`` n counts like n rows."""
    n = np.ones(len(x)) if weight is None else weight
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], l2)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (n * (p - y)) + penalty * w
        hessian = (a * (n * p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_signed(x: np.ndarray, y: np.ndarray, signs: list[int], l2: float = 1.0, weight: np.ndarray | None = None) -> np.ndarray:
    """``fit_logistic`` without weights against ``signs``: features that get one
    are left out, and the rest is fitted again."""
    used = np.ones(x.shape[1], bool)
    while True:
        w = np.zeros(x.shape[1] + 1)
        w[np.append(used, True)] = fit_logistic(x[:, used], y, l2, weight=weight)
        wrong = w[:-1] * np.array(signs) < 0
        if not wrong.any():
            return w
        used &= ~wrong


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
