"""Which vectors take part, and k-means on a bounded sample."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(column: str) -> Column:
    """Neither null, empty or zero, and no component null or non-finite."""
    at = F.col(column)
    finite = F.forall(at, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(at.isNotNull() & finite & F.exists(at, lambda x: x != 0), F.lit(False))


def matrix(column) -> np.ndarray:
    """An Arrow list column, without nulls and of one length, as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), dtype=np.int64)
    half = (centres * centres).sum(1) / 2
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = np.argmax(x[i : i + 4096] @ centres.T - half, axis=1)
    return out


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    k = min(k, len(x))
    centres = x[np.sort(np.random.default_rng(seed).choice(len(x), k, replace=False))].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        by = np.argsort(own, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], own[by][1:] != own[by][:-1]]))
        centres[own[by][cut]] = np.add.reduceat(x[by], cut, axis=0) / np.diff(np.append(cut, len(x)))[:, None]
    return centres
