"""Principal component analysis of the standardised columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablescope.functions.tables import small_table
from tablescope.functions.columns import col
from tablescope.operators.moments import Moments

REFERENCE_SHARE = 0.80


def ordered_eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and eigenvectors whose largest absolute entry is positive."""
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(-values, kind="stable")
    return np.maximum(values[order], 0.0), positive_peaks(vectors[:, order])


def positive_peaks(vectors: np.ndarray) -> np.ndarray:
    """Flip columns so that the first entry of (nearly) largest size is positive."""
    out = vectors.copy()
    for k in range(out.shape[1]):
        size = np.abs(out[:, k])
        peak = int(np.argmax(size >= size.max() * (1 - 1e-9)))
        if out[peak, k] < 0:
            out[:, k] = -out[:, k]
    return out


def first_reaching(cumulative: np.ndarray, share: float) -> int | None:
    """1-based number of the first component whose cumulative share reaches ``share``."""
    reached = np.flatnonzero(cumulative >= share)
    return int(reached[0]) + 1 if len(reached) else None


@dataclass(frozen=True)
class PCAResult:
    variables: tuple[str, ...]
    eigenvalues: np.ndarray
    explained_variance_ratio: np.ndarray
    cumulative_variance: np.ndarray
    loadings: np.ndarray
    n_components: int
    n_components_80pct: int
    variance_threshold_reached: bool
    variance_threshold: float
    scores: DataFrame

    @property
    def components(self) -> list[str]:
        return [f"PC{k + 1}" for k in range(self.n_components)]

    def loadings_df(self, spark: SparkSession) -> DataFrame:
        """``(variable, position, component, loading)``."""
        return table_of_loadings(spark, self.variables, self.components, self.loadings)

    def variance_df(self, spark: SparkSession) -> DataFrame:
        """``(component, eigenvalue, explained, cumulative, kept)`` of every component."""
        rows = [
            (k + 1, float(v), float(e), float(c), k < self.n_components)
            for k, (v, e, c) in enumerate(
                zip(self.eigenvalues, self._all_ratios(), self.cumulative_variance)
            )
        ]
        return small_table(spark, 
            rows, "component int, eigenvalue double, explained double, cumulative double, kept boolean"
        )

    def _all_ratios(self) -> np.ndarray:
        return np.diff(self.cumulative_variance, prepend=0.0)


def table_of_loadings(
    spark: SparkSession, variables: Sequence[str], components: Sequence[str], loadings: np.ndarray
) -> DataFrame:
    rows = [
        (v, i, c, float(loadings[i, k]))
        for i, v in enumerate(variables)
        for k, c in enumerate(components)
    ]
    return small_table(spark, rows, "variable string, position int, component string, loading double")


def linear_scores(
    values: Sequence[Column], mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, names: Sequence[str]
) -> list[Column]:
    """Each score is a weighted sum of the standardised values, as a plain expression."""
    scores = []
    for k, name in enumerate(names):
        total = F.lit(0.0)
        for j, v in enumerate(values):
            total = total + (v - F.lit(float(mean[j]))) / F.lit(float(scale[j])) * F.lit(float(weights[j, k]))
        scores.append(total.alias(name))
    return scores


def pca(
    df: DataFrame,
    values: Mapping[str, Column],
    moments: Moments,
    variance_threshold: float = 0.80,
    key: Sequence[str] = (),
) -> PCAResult:
    """Keep the first components reaching the threshold, at least 2; scores are a lazy narrow projection."""
    p = len(moments.columns)
    eigenvalues, vectors = ordered_eigen(moments.standardized_cov())
    total = eigenvalues.sum()
    ratio = eigenvalues / total if total > 0 else np.zeros(p)
    cumulative = np.cumsum(ratio)
    # the last share is 1 up to rounding; a threshold of exactly 1 must find it
    steps = np.where(cumulative > 1 - 1e-12, 1.0, cumulative)
    reached = first_reaching(steps, variance_threshold)
    n_components = max(1, min(max(2, reached or p), p, moments.n))
    names = [f"PC{k + 1}" for k in range(n_components)]
    weights = vectors[:, :n_components]
    projected = linear_scores([values[c] for c in moments.columns], moments.mean, moments.scale, weights, names)
    return PCAResult(
        moments.columns,
        eigenvalues,
        ratio[:n_components],
        cumulative,
        weights,
        n_components,
        first_reaching(steps, REFERENCE_SHARE) or p,
        reached is not None,
        variance_threshold,
        df.select(*[col(k) for k in key], *projected),
    )


def top_variables(loadings: DataFrame, n_top: int = 5) -> DataFrame:
    """``(component, rank, variable, loading, label)``: strongest loadings first, table order on ties."""
    strongest = Window.partitionBy("component").orderBy(F.abs("loading").desc(), F.col("position"))
    return (
        loadings.withColumn("rank", F.row_number().over(strongest))
        .where(F.col("rank") <= n_top)
        .select(
            "component",
            "rank",
            "variable",
            "loading",
            F.format_string("%s (%+.3f)", F.col("variable"), F.col("loading")).alias("label"),
        )
    )


def top_variables_table(loadings: DataFrame, components: Sequence[str], n_top: int = 5) -> DataFrame:
    """Ranks as rows ``#1``, ``#2``, … and one column of labels per component."""
    return (
        top_variables(loadings, n_top)
        .groupBy("rank")
        .pivot("component", list(components))
        .agg(F.first("label"))
        .orderBy("rank")
        .select(F.concat(F.lit("#"), F.col("rank")).alias("rank"), *components)
    )
