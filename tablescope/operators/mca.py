"""Multiple correspondence analysis (Greenacre 1984) from the Burt table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.functions.columns import col
from tablescope.functions.tables import small_table
from tablescope.operators.inertia import dims, inertia_shares, inertia_table
from tablescope.operators.levels import Levels, SplitLevels, burt_matrix, existing, level_weights, split_levels
from tablescope.operators.pca import ordered_eigen
from tablescope.operators.wide_levels import WideAxes, add_wide_weights, wide_axes, wide_coordinates, wide_texts


@dataclass(frozen=True)
class MCAResult:
    """``levels`` and ``level_coordinates`` are those of variables with few levels; the levels of ``wide`` variables stay
    in a table. ``all_eigenvalues`` are the kept ones only if there are any."""

    variables: tuple[str, ...]
    levels: Levels
    eigenvalues: np.ndarray
    all_eigenvalues: np.ndarray
    total_inertia: float
    shares: np.ndarray
    level_coordinates: np.ndarray  # principal coordinates, levels x axes
    n_components: int
    row_coordinates: DataFrame
    n_levels: int = 0
    wide: DataFrame | None = None  # (variable, level, dim, coordinate, mass)
    residuals: np.ndarray | None = None  # error bound of each axis where several variables are wide
    converged: bool = True

    @property
    def total_inertia_explained(self) -> float:
        return float(self.shares.sum())

    def inertia_df(self, spark: SparkSession) -> DataFrame:
        return inertia_table(spark, self.eigenvalues, self.shares)

    def levels_df(self, spark: SparkSession) -> DataFrame:
        """``(variable, level, dim, coordinate, mass)``: mass is the level's share of all cells."""
        q = len(self.variables)
        rows = [
            (self.levels.variables[v], text, dim, float(self.level_coordinates[i, k]), float(self.levels.share[i] / q))
            for i, (v, text) in enumerate(self.levels.names)
            for k, dim in enumerate(dims(self.n_components))
        ]
        few = small_table(spark, rows, "variable string, level string, dim string, coordinate double, mass double")
        return few if self.wide is None else few.unionByName(self.wide)


def mca(
    df: DataFrame,
    categorical: Sequence[str],
    n_components: int = 2,
    key: Sequence[str] = (),
    inertia_basis: str = "total",
    split: SplitLevels | None = None,
    burt: np.ndarray | None = None,
    dense_levels: int | None = None,
) -> MCAResult:
    """Axes of the levels of at least two columns, of any number; row coordinates are a lazy projection.

    A row lies at the mean of the standard coordinates of its levels, so its axis variance is the eigenvalue.
    ``split`` and ``burt`` are the counts of the same columns where they are known already.
    """
    variables = existing(df, categorical)
    if not variables:
        raise ValueError(f"none of the categorical columns {list(categorical)} is in the table")
    if len(variables) < 2:
        raise ValueError(f"multiple correspondence analysis needs at least 2 categorical columns, got {variables}")
    q = len(variables)
    n_components = max(1, min(n_components, q - 1))
    split = split_levels(df, variables, dense_levels=dense_levels) if split is None else split
    if not split.n:
        raise ValueError("the table is empty")
    levels = split.narrow
    root = np.sqrt(levels.share)
    burt = burt_matrix(df, levels) if burt is None else burt
    # q times the matrix of the analysis; its trivial axis is taken out
    centred = burt / (levels.n * np.outer(root, root)) - np.outer(root, root)
    total = split.n_levels / q - 1.0
    carried = {k: col(k) for k in key}
    names = dims(n_components)
    axes: WideAxes | None = None
    if split.wide:
        axes = wide_axes(df, split, centred, np.zeros(0), n_components)
        every = kept = axes.eigenvalues / q
        vectors = axes.dense
        carried |= wide_texts(df, split)
    else:
        found, vectors = ordered_eigen(centred / q)
        kept, every = found[:n_components], found[: max(0, len(levels) - q)]
        vectors = vectors[:, :n_components]
    standard = vectors * np.sqrt(q) / root[:, None]
    rows = level_weights(df, levels, standard / q, carried, names)
    wide = None
    if axes is not None:
        rows = add_wide_weights(rows, df, axes, split, q**-0.5, names).select(*[col(k) for k in key], *names)
        wide = wide_coordinates(axes, split, np.sqrt(q * kept), names).withColumn("mass", F.col("share") / q)
        wide = wide.select("variable", "level", "dim", "coordinate", "mass")
    return MCAResult(
        tuple(variables),
        levels,
        kept,
        every,
        total,
        inertia_shares(kept, total, inertia_basis),
        standard * np.sqrt(kept),
        n_components,
        rows,
        split.n_levels,
        wide,
        axes and axes.residuals / q,
        axes is None or axes.converged,
    )
