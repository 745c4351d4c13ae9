"""The bounded sample of labelled documents that the classifiers learn from."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: At most this many labelled documents of each class are learned from.
MAX_PER_CLASS = 2500
#: At most this many bytes of their texts are learned from; the documents of the smallest seeded hashes come first.
MAX_BYTES = 64 << 20
#: Documents whose crc32 leaves 0 are held out.
FOLDS = 5


def held_out(doc_id):
    """Column: crc32 of the id as text leaves 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fold(doc_id: object) -> int:
    return zlib.crc32(str(doc_id).encode()) % FOLDS


def labelled(docs: DataFrame, labels: DataFrame, label: str, max_per_class: int = MAX_PER_CLASS) -> list[tuple[str, int]]:
    """(text, label) of at most max_per_class documents of each class outside the held-out fold.

    The ids come from the small labels table, the smallest seeded hashes first, so reruns learn from the same rows. A
    document whose label rows disagree is left out; of rows that repeat an id the smallest text counts, picked before
    anything goes to the driver. Ordered by id, whole texts, up to MAX_BYTES of them.
    """
    one = agreed(labels, label)
    picked = []
    for c in (0, 1):
        rows = one.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class).collect()
        picked += [(r["doc_id"], c) for r in rows]
    if not picked:
        return []
    by_id = dict(picked)
    texts = docs.where(F.col("doc_id").isin(list(by_id))).groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    order = W.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, 0)  # at most 2 max_per_class rows
    texts = texts.withColumn("upto", F.sum(F.octet_length("text").cast("long")).over(order)).where(F.col("upto") <= MAX_BYTES)
    return [(r["text"], by_id[r["doc_id"]]) for r in texts.orderBy("doc_id").select("doc_id", "text").collect()]


def agreed(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y, y2) of the documents outside the held-out fold whose label rows agree."""
    y = F.col(label)
    one = labels.where(y.isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return one.groupBy("doc_id").agg(F.min(y.cast("int")).alias("y"), F.max(y.cast("int")).alias("y2")).where("y = y2 and y in (0, 1)")


def rate(labels: DataFrame, label: str) -> float:
    """The share of label 1 among the documents outside the held-out fold, counted over all labels; 0.5 without any."""
    return agreed(labels, label).agg(F.avg("y")).first()[0] or 0.5


def logistic(x, y, steps: int = 50, ridge: float = 1e-3):
    """Weights (bias last) of a logistic regression on a few features, by Newton's method; both classes weigh alike.

    The ridge holds for features in units of their deviation, so that small features are not flattened.
    """
    import numpy as np

    x = np.asarray(x, float).reshape(len(y), -1)
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-9)
    x = np.column_stack([(x - mean) / spread, np.ones(len(y))])
    y = np.asarray(y, float)
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (p - y)) + ridge * w
        hess = (x * (share * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    w[:-1] /= spread
    w[-1] -= w[:-1] @ mean
    return w
