"""Share of inertia per axis, as tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tablescope.functions.tables import small_table

BASES = ("total", "kept")


def dims(n: int) -> list[str]:
    return [f"Dim{k + 1}" for k in range(n)]


def inertia_shares(eigenvalues: np.ndarray, total: float, basis: str) -> np.ndarray:
    """Share of each axis in the total inertia, or among the kept axes only."""
    if basis not in BASES:
        raise ValueError(f"inertia_basis must be one of {BASES}, got {basis!r}")
    whole = total if basis == "total" else float(eigenvalues.sum())
    return eigenvalues / (whole if whole > 0 else 1.0)


def inertia_table(spark: SparkSession, eigenvalues: Sequence[float], shares: np.ndarray) -> DataFrame:
    """``(dim, eigenvalue, inertia_pct, cumulative_pct)`` with 4, 2 and 2 decimals."""
    rows = [
        (name, round(float(v), 4), round(float(s) * 100, 2), round(float(c) * 100, 2))
        for name, v, s, c in zip(dims(len(eigenvalues)), eigenvalues, shares, np.cumsum(shares))
    ]
    return small_table(spark, rows, "dim string, eigenvalue double, inertia_pct double, cumulative_pct double")
