"""Correlations with p-values, and the normality check that chooses between Pearson and Spearman."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablescope.functions.columns import double_array
from tablescope.functions.tables import small_table
from tablescope.functions.normality import p_value, statistic, weights
from tablescope.functions.tails import correlation_p_value
from tablescope.operators.moments import Moments, cross_moments
from tablescope.operators.ranks import average_ranks

#: the Shapiro-Wilk test is run on 3 to 5,000 rows
SHAPIRO_MIN, SHAPIRO_MAX = 3, 5000
ALPHA = 0.05


@dataclass(frozen=True)
class Normality:
    """Shapiro-Wilk result of a variable; ``w`` and ``p`` are None where the test was not run."""

    variable: str
    w: float | None
    p: float | None
    is_normal: bool


def normality(df: DataFrame, values: Mapping[str, Column], n_rows: int) -> list[Normality]:
    """Test each variable. Tables outside the row limits are not read at all.

    One window puts the cells of each variable in order; their weights depend on the number of rows alone and are a
    constant of the plan, 5,000 numbers at most. Three sums a variable reach the driver.
    """
    names = list(values)
    if not SHAPIRO_MIN <= n_rows <= SHAPIRO_MAX:
        return [Normality(c, None, None, False) for c in names]
    cells = df.select(F.posexplode(F.array(*[values[c] for c in names])).alias("position", "value"))
    variable = Window.partitionBy("position")
    ordered = cells.select(
        "position",
        (F.col("value") - F.avg("value").over(variable)).alias("centred"),
        F.row_number().over(variable.orderBy("value")).alias("place"),
    )
    weight = F.get(double_array(weights(n_rows)), F.col("place") - 1)
    sums = ordered.groupBy("position").agg(
        F.sum(weight * F.col("centred")).alias("product"),
        F.var_pop("centred").alias("variance"),
        (F.max("centred") - F.min("centred")).alias("reach"),
    )
    found = {
        r["position"]: statistic(r["product"], r["variance"] * n_rows, r["reach"]) for r in sums.collect()
    }
    tested = [(c, found[i], p_value(found[i], n_rows)) for i, c in enumerate(names)]
    return [Normality(c, w, p, p >= ALPHA) for c, w, p in tested]


def normality_df(spark: SparkSession, results: Sequence[Normality]) -> DataFrame:
    """``(variable, w, p_value, is_normal)``, 4 decimals, NULL where not tested."""
    rows = [
        (r.variable, None if r.w is None else round(r.w, 4), None if r.p is None else round(r.p, 4), r.is_normal)
        for r in results
    ]
    return small_table(spark, rows, "variable string, w double, p_value double, is_normal boolean")


@dataclass(frozen=True)
class CorrelationResult:
    columns: tuple[str, ...]
    n_rows: int
    matrix: np.ndarray
    p_matrix: np.ndarray
    method: str
    normality: list[Normality]
    all_normal: bool

    def to_df(self, spark: SparkSession) -> DataFrame:
        """Long form ``(var_i, var_j, r, p_value)`` of the whole matrix."""
        rows = [
            (a, b, _number(self.matrix[i, j]), _number(self.p_matrix[i, j]))
            for i, a in enumerate(self.columns)
            for j, b in enumerate(self.columns)
        ]
        return small_table(spark, rows, "var_i string, var_j string, r double, p_value double")

    def wide_df(self, spark: SparkSession) -> DataFrame:
        """Square form, one column per variable."""
        fields = ["variable string", *[f"`{c}` double" for c in self.columns]]
        rows = [(c, *map(_number, self.matrix[i])) for i, c in enumerate(self.columns)]
        return small_table(spark, rows, ", ".join(fields))

    def t_statistics(self, spark: SparkSession) -> DataFrame:
        """``(var_i, var_j, t)`` for each pair, first variable before second in table order."""
        rows = []
        for i, a in enumerate(self.columns):
            for j in range(i + 1, len(self.columns)):
                r = float(self.matrix[i, j])
                bounded = not math.isnan(r) and abs(r) < 1.0 and self.n_rows > 2
                rows.append((a, self.columns[j], r * math.sqrt((self.n_rows - 2) / (1 - r * r)) if bounded else None))
        return small_table(spark, rows, "var_i string, var_j string, t double")

    def significant_df(self, spark: SparkSession, alpha: float = ALPHA) -> DataFrame:
        """Strict lower triangle with ``r`` blanked where it is not significant."""
        return lower_triangle(self.to_df(spark), self.columns).select(
            "var_i", "var_j", F.when(F.col("p_value") < alpha, F.col("r")).alias("r"), "p_value"
        )


def lower_triangle(cells: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cells whose row variable comes after their column variable in table order."""
    order = F.array(*[F.lit(c) for c in columns])
    return cells.where(F.array_position(order, F.col("var_i")) > F.array_position(order, F.col("var_j")))


def _number(x: float) -> float | None:
    return None if math.isnan(x) else float(x)


def p_value_matrix(matrix: np.ndarray, n_rows: int) -> np.ndarray:
    """p-value of every pair; the diagonal is 1."""
    p = np.ones_like(matrix)
    for i in range(len(matrix)):
        for j in range(i + 1, len(matrix)):
            p[i, j] = p[j, i] = correlation_p_value(float(matrix[i, j]), n_rows)
    return p


def spearman_moments(df: DataFrame, values: Mapping[str, Column]) -> Moments:
    """Moments of the average ranks."""
    slots = {c: f"r_{i}" for i, c in enumerate(values)}
    _, ranks = average_ranks(df, {slots[c]: values[c] for c in values})
    found = cross_moments(ranks, {s: F.col(s) for s in slots.values()})
    return replace(found, columns=tuple(values))


def correlation(
    df: DataFrame,
    values: Mapping[str, Column],
    method: str | None = None,
    moments: Moments | None = None,
) -> CorrelationResult:
    """Correlation matrix with p-values.

    Without ``method`` every variable is tested for normality first: Pearson only if all pass, else Spearman.
    """
    if method not in (None, "pearson", "spearman"):
        raise ValueError(f"method must be 'pearson' or 'spearman', got {method!r}")
    tested: list[Normality] = []
    n_rows = moments.n if moments is not None else None
    if method is None:
        n_rows = df.count() if n_rows is None else n_rows
        tested = normality(df, values, n_rows)
    all_normal = bool(tested) and all(r.is_normal for r in tested)
    chosen = method or ("pearson" if all_normal else "spearman")
    if chosen == "pearson":
        used = moments if moments is not None else cross_moments(df, values)
    else:
        used = spearman_moments(df, values)
    matrix = used.correlation()
    return CorrelationResult(
        tuple(values), used.n, matrix, p_value_matrix(matrix, used.n), chosen, tested, all_normal
    )
