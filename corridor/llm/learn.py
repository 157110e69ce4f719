"""Small numpy learners and the bounded samples that they may see."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, weight: np.ndarray | None = None, steps: int = 25, start: np.ndarray | None = None) -> np.ndarray:
    """Weights and a last bias of an L2-regularised logistic regression, by Newton steps with backtracking from ``start``."""
    x1 = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1).astype(np.float64)
    w = np.zeros(x1.shape[1])
    c = np.ones(len(y)) if weight is None else weight
    if len(y):
        base = np.clip((c * y).sum() / c.sum(), 1e-3, 1 - 1e-3)
        w[-1] = np.log(base / (1 - base))
    if len(np.unique(y)) < 2:
        return w
    w = w if start is None else start.copy()
    ridge = np.full(len(w), l2 * c.sum())
    ridge[-1] = 1e-9 * c.sum()

    def loss(v):
        z = x1 @ v
        return (c * (np.logaddexp(0, z) - y * z)).sum() + (ridge * v * v).sum() / 2

    half, now = x1.astype(np.float32), loss(w)
    for _ in range(steps):
        p = sigmoid(x1 @ w)
        grad = x1.T @ (c * (p - y)) + ridge * w
        h = (half * np.sqrt(c * np.maximum(p * (1 - p), 1e-4)).astype(np.float32)[:, None])
        h = (h.T @ h).astype(np.float64)  # steps need no more than single precision, the gradient does
        h[np.diag_indices(len(w))] += ridge + 1e-6 * c.sum()
        step = np.linalg.solve(h, grad)
        scale = 1.0
        while (then := loss(w - scale * step)) > now and scale > 1e-4:
            scale /= 2
        if then >= now - 1e-9 * abs(now):
            break
        w, now = w - scale * step, then
    return w


def labelled(labels: DataFrame, target: str, limit: int, modulus: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, y) of the rows that may be learnt from: crc32 of the id modulo ``modulus`` is not ``held``.

    At most about ``limit`` rows, chosen by a hash of the id.  Null labels are left out; of several labels for a
    document the largest counts.
    """
    own = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus != held))
    own = own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(target).cast("int")).alias("y"))
    n = own.count()
    scale = 1 << 30
    return own.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(scale)) < int(scale * min(1.0, limit / max(n, 1))))
