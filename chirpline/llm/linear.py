"""Bounded labelled samples and score calibration for the linear text classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirpline.llm.common import crc_fold, hash_sample, written


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, folds: int = 4, held_out: int = 2) -> DataFrame:
    """(text, label) of at most about ``rows`` distinct labelled texts of each class.

    Only rows outside the held-out fold count. Equal texts count once, with the highest
    of their labels, and sampling is by the hash of the text, so a group of copies can't
    fill the sample. The distinct texts of a class are counted first and give the sampled
    fraction; all of a rare class are taken. Hashes are joined and grouped; only the texts
    of the sample are fetched.
    """
    known = labels.where(F.col(label).isin(0, 1)).where(crc_fold("doc_id", folds) != held_out).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    hashed = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"))
    distinct = written(hashed.join(known, "doc_id").groupBy("key").agg(F.max("label").alias("label"), F.min("doc_id").alias("doc_id")))
    sizes = {r["label"]: r["count"] for r in distinct.groupBy("label").count().collect()}
    share = F.lit(0.0)
    for value, count in sizes.items():
        share = F.when(F.col("label") == value, F.lit(min(1.0, rows / count))).otherwise(share)
    sample = F.broadcast(hash_sample(distinct, F.col("key"), share))  # about 2 * rows rows
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))
    return texts.join(sample, ["doc_id", "key"]).groupBy("text").agg(F.max("label").alias("label"))


def sigmoid(x):
    return 0.5 * (1.0 + np.tanh(0.5 * np.asarray(x, dtype=np.float64)))


def platt(margins: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities, by Newton's method with
    smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    if pos == 0 or neg == 0:
        return 1.0, float(np.log((pos + 1) / (neg + 1)))
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margins, np.ones_like(margins)])
    w = np.array([1.0, np.log((pos + 1) / (neg + 1))])
    for _ in range(steps):
        p = sigmoid(w @ x)
        h = (x * (p * (1 - p) + 1e-9)) @ x.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x @ (p - target))
        w = w - step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])
