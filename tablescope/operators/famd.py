"""Factor analysis of mixed data (Pagès 2004): standardised columns and weighted indicators together."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.functions.columns import col, level_text, measure, pick_numeric
from tablescope.functions.tables import small_table
from tablescope.operators.inertia import dims, inertia_shares, inertia_table
from tablescope.operators.levels import Levels, SplitLevels, burt_matrix, existing, level_weights, split_levels
from tablescope.operators.moments import Moments, cross_moments
from tablescope.operators.pca import linear_scores, ordered_eigen
from tablescope.operators.wide_levels import add_wide_weights, wide_axes, wide_coordinates, wide_texts


@dataclass(frozen=True)
class FAMDResult:
    continuous: tuple[str, ...]
    categorical: tuple[str, ...]
    levels: Levels
    eigenvalues: np.ndarray
    all_eigenvalues: np.ndarray
    total_inertia: float
    shares: np.ndarray
    continuous_coordinates: np.ndarray  # correlation of the column with the axis
    level_coordinates: np.ndarray  # mean row coordinate of the level
    relationships: np.ndarray  # squared correlation or correlation ratio, variables x axes
    n_components: int
    row_coordinates: DataFrame
    wide: DataFrame | None = None  # (variable, level, kind, dim, coordinate) of variables with many levels
    residuals: np.ndarray | None = None  # error bound of each axis where several variables are wide
    converged: bool = True

    @property
    def total_inertia_explained(self) -> float:
        return float(self.shares.sum())

    def inertia_df(self, spark: SparkSession) -> DataFrame:
        return inertia_table(spark, self.eigenvalues, self.shares)

    def columns_df(self, spark: SparkSession) -> DataFrame:
        """``(variable, level, kind, dim, coordinate)``; ``level`` is NULL for a continuous column."""
        rows = [
            (c, None, "continuous", dim, float(self.continuous_coordinates[i, k]))
            for i, c in enumerate(self.continuous)
            for k, dim in enumerate(dims(self.n_components))
        ] + [
            (self.levels.variables[v], text, "level", dim, float(self.level_coordinates[i, k]))
            for i, (v, text) in enumerate(self.levels.names)
            for k, dim in enumerate(dims(self.n_components))
        ]
        few = small_table(spark, rows, "variable string, level string, kind string, dim string, coordinate double")
        return few if self.wide is None else few.unionByName(self.wide)

    def relationships_df(self, spark: SparkSession) -> DataFrame:
        """``(variable, dim, squared)``: how much of the axis the variable accounts for."""
        rows = [
            (c, dim, float(self.relationships[i, k]))
            for i, c in enumerate(self.continuous + self.categorical)
            for k, dim in enumerate(dims(self.n_components))
        ]
        return small_table(spark, rows, "variable string, dim string, squared double")


def mixed_table(df: DataFrame, continuous: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Continuous columns as doubles beside categorical columns as level texts: the same rows, no join."""
    return df.select(
        *[measure(df, c).alias(c) for c in continuous], *[level_text(df, c).alias(c) for c in categorical]
    )


def block_matrix(moments: Moments, levels: Levels, burt: np.ndarray) -> np.ndarray:
    """Cross-products of standardised columns z and indicators (1_k - p_k) / sqrt(p_k), divided by the rows."""
    p, share = len(moments.columns), levels.share
    root = np.sqrt(share)
    matrix = np.empty((p + len(levels), p + len(levels)))
    matrix[:p, :p] = moments.standardized_cov()
    # sqrt(p_k) * mean(z | k) = (sum of x over level k - n_k * mean) / (n * sd * sqrt(p_k))
    centred = (levels.sums - levels.rows[:, None] * moments.mean) / moments.scale
    matrix[p:, :p] = np.where(moments.sd > 0, centred / (levels.n * root[:, None]), 0.0)
    matrix[:p, p:] = matrix[p:, :p].T
    matrix[p:, p:] = (burt / levels.n - np.outer(share, share)) / np.outer(root, root)
    return matrix


def centred_columns(df: DataFrame, names: Sequence[str], mean: Sequence[float]) -> list[Column]:
    """The columns around their means, whose level sums ``split_levels`` takes."""
    return [measure(df, c) - F.lit(float(m)) for c, m in zip(names, mean)]


def famd(
    df: DataFrame,
    continuous: Sequence[str],
    categorical: Sequence[str],
    n_components: int = 2,
    key: Sequence[str] = (),
    inertia_basis: str = "total",
    moments: Moments | None = None,
    split: SplitLevels | None = None,
    burt: np.ndarray | None = None,
    dense_levels: int | None = None,
) -> FAMDResult:
    """Common axes of continuous columns and categorical levels, of any number; row coordinates are lazy.

    ``split``, with the sums of ``centred_columns``, and ``burt`` are the counts where they are known already.
    """
    reals, labels = existing(df, continuous), existing(df, categorical)
    if not reals:
        raise ValueError(f"none of the continuous columns {list(continuous)} is in the table")
    if not labels:
        raise ValueError(f"none of the categorical columns {list(categorical)} is in the table")
    pick_numeric(df, reals)
    n_components = max(1, min(n_components, len(reals) + len(labels) - 1))
    values = {c: measure(df, c) for c in reals}
    if moments is None:
        moments = cross_moments(df, values)
    if not moments.n:
        raise ValueError("the table is empty")
    moments = moments.subset([moments.columns.index(c) for c in reals])
    if split is None:
        split = split_levels(df, labels, centred_columns(df, reals, moments.mean), dense_levels)
    levels = split.narrow
    matrix = block_matrix(
        replace(moments, mean=np.zeros(len(reals))),  # level sums are already centred
        levels,
        burt_matrix(df, levels) if burt is None else burt,
    )
    p, root, names = len(reals), np.sqrt(levels.share), dims(n_components)
    # standardised columns that vary, and one less than its levels for each variable
    total = float(len(moments.varying) + split.n_levels - len(labels))
    carried = {k: col(k) for k in key}
    axes = None
    if split.wide:
        axes = wide_axes(df, split, matrix, moments.scale, n_components)
        eigenvalues = kept = axes.eigenvalues
        vectors = axes.dense
        carried |= wide_texts(df, split)
    else:
        eigenvalues, vectors = ordered_eigen(matrix)
        kept, vectors = eigenvalues[:n_components], vectors[:, :n_components]
    squares = {v: (vectors[[p + i for i in levels.of(q)]] ** 2).sum(axis=0) for q, v in enumerate(levels.variables)}
    if axes is not None:
        squares |= axes.squares
    relationships = [kept * vectors[j] ** 2 for j in range(p)] + [kept * squares[v] for v in labels]

    scores = [f"__z{k}" for k in range(n_components)]
    linear = linear_scores(list(values.values()), moments.mean, moments.scale, vectors[:p], scores)
    carried |= dict(zip(scores, linear))
    placed = level_weights(df, levels, vectors[p:] / root[:, None], carried, [f"__c{k}" for k in range(n_components)])
    rows = placed.select(
        *[col(k) for k in carried if k not in scores],
        *[(F.col(f"__z{k}") + F.col(f"__c{k}")).alias(n) for k, n in enumerate(names)],
    )
    wide = None
    if axes is not None:
        rows = add_wide_weights(rows, df, axes, split, 1.0, names).select(*[col(k) for k in key], *names)
        wide = wide_coordinates(axes, split, kept, names)
        wide = wide.select("variable", "level", F.lit("level").alias("kind"), "dim", "coordinate")
    return FAMDResult(
        tuple(reals),
        tuple(labels),
        levels,
        kept,
        eigenvalues,
        total,
        inertia_shares(kept, total, inertia_basis),
        vectors[:p] * np.sqrt(kept),
        vectors[p:] / root[:, None] * kept,
        np.array(relationships),
        n_components,
        rows,
        wide,
        axes and axes.residuals,
        axes is None or axes.converged,
    )
