"""Bounded labelled samples for fitting classifiers, and a small linear trainer.

A sample takes rows by a hash of their id, at a rate that counts over all rows
have given for each class; its expected size is the documented bound.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GRAIN = 1 << 30


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0 (nothing is learned from it)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)), F.lit(0)).cast("int")


def per_class(rows: DataFrame, label: str, id_col: str, bound: int) -> DataFrame:
    """About ``bound`` rows of each class of ``rows``, all of a smaller class."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # one row for each class
    draw = F.pmod(F.xxhash64(F.lit("sample"), id_col), F.lit(_GRAIN))
    keep = F.lit(False)
    for k, n in counts.items():
        keep = keep | ((F.col(label) == F.lit(k)) & (draw < int(_GRAIN * min(1.0, bound / n))))
    return rows.filter(keep)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, steps: int = 120, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by accelerated gradient steps; y is +1 or -1."""
    n, d = x.shape
    s = np.ones(n) if weight is None else weight * n / weight.sum()
    norm = float(np.linalg.norm(x, 2) ** 2) if min(n, d) <= 256 else _norm2(x)
    rate = 1.0 / (1.0 / c / n + 2.0 * s.max() * (norm + n) / n)
    w, b, v, vb = np.zeros(d, x.dtype), 0.0, np.zeros(d, x.dtype), 0.0
    for t in range(steps):
        m = t / (t + 3.0)
        u, ub = w + m * v, b + m * vb
        slack = np.maximum(0.0, 1.0 - y * (x @ u + ub)) * y * s
        nw, nb = u - rate * (u / (c * n) - 2.0 * (x.T @ slack.astype(x.dtype)) / n), ub + rate * 2.0 * float(slack.sum()) / n
        v, vb, w, b = nw - w, nb - b, nw, nb
    return w, b


def _norm2(x: np.ndarray, steps: int = 12) -> float:
    v = np.ones(x.shape[1], x.dtype) / np.sqrt(x.shape[1])
    k = 1.0
    for _ in range(steps):
        v = x.T @ (x @ v)
        k = float(np.linalg.norm(v)) or 1.0
        v = v / k
    return 1.1 * k


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 200, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression by accelerated gradient steps; y is 0 or 1."""
    n, d = x.shape
    s = np.ones(n) if weight is None else weight * n / weight.sum()
    rate = 1.0 / (l2 + 0.25 * s.max() * (_norm2(x) + n) / n)
    w, b, v, vb = np.zeros(d, x.dtype), 0.0, np.zeros(d, x.dtype), 0.0
    for t in range(steps):
        m = t / (t + 3.0)
        u, ub = w + m * v, b + m * vb
        g = (1.0 / (1.0 + np.exp(-np.clip(x @ u + ub, -30, 30))) - y) * s
        nw, nb = u - rate * (x.T @ g.astype(x.dtype) / n + l2 * u), ub - rate * float(g.sum()) / n
        v, vb, w, b = nw - w, nb - b, nw, nb
    return w, b
