"""Labelled training texts for the classifiers.

A row may teach only if ``crc32(doc_id as text) mod 3`` is not 1; the others are
held out.  Training takes a bounded sample: of the labelled documents that are
there, per class the first ``per_class`` rows in the order of their ids' hashes,
as far as their whole texts together stay within the class's part of
``TRAIN_BYTES`` (the first always does).  So no row is preferred or left out for
its own length.  Only that sample reaches the driver.

Of several texts under one id the one that hashes lowest teaches; empty and null
texts teach as empty ones.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_bytes


#: bytes of all training texts, half for each class
TRAIN_BYTES = 48 << 20


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training (a null id is)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(True))


def training_texts(docs: DataFrame, labels: DataFrame, label: str, per_class: dict[int, int], max_bytes: int = TRAIN_BYTES) -> list[tuple[bytes, int]]:
    """Bounded, reproducible ``(text, label)`` pairs for training.

    Labels other than 0 and 1 are ignored; a document with both counts as 1.  Of a
    class's ``per_class`` documents (by hash) those are taken, in order, that still
    fit its share of ``max_bytes``; a text larger than the share is never one.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    marked = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).alias("y"))
    marked = marked.join(texts.select("doc_id"), "doc_id", "left_semi")
    found = []
    for y, n in per_class.items():
        chosen = marked.filter(F.col("y") == y).select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(n)
        # at most n ids: safe to broadcast whatever the table's size
        rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "h").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
        taken, left = [], max_bytes // len(per_class)
        for r in sorted(rows.select("h", "doc_id", F.octet_length("text").alias("size")).collect()):
            if r["size"] <= left:  # a text that does not fit is left out and counts nothing
                taken.append((r["doc_id"],))
                left -= r["size"]
        wanted = docs.sparkSession.createDataFrame(taken, "doc_id long")
        found += [(r["doc_id"], bytes(r["text"]), y) for r in rows.join(F.broadcast(wanted), "doc_id").select("doc_id", "text").collect()]
    return [(t, y) for _, t, y in sorted(found)]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-3, steps: int = 50) -> tuple[np.ndarray, float]:
    """Logistic regression of a few dense features by Newton's method: (weights, bias)."""
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    sample = np.ones(len(y)) if weight is None else weight
    ridge = np.full(a.shape[1], l2 * sample.sum())
    ridge[-1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        g = a.T @ (sample * (p - y)) + ridge * w
        h = (a * (sample * p * (1 - p))[:, None]).T @ a + np.diag(ridge + 1e-9)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])
