"""All analyses of one clean table, sharing its statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame

from tablescope.functions.columns import col, filled, pick_numeric
from tablescope.operators import pca as pca_module
from tablescope.operators.correlation import CorrelationResult, correlation
from tablescope.operators.describe import describe
from tablescope.operators.factors import FactorResult, factor_analysis
from tablescope.operators.famd import FAMDResult, famd
from tablescope.operators.mca import MCAResult, mca
from tablescope.operators.moments import Moments, cross_moments
from tablescope.operators.pca import PCAResult, pca


class TableAnalysis:
    """Descriptive and multivariate analyses of the numeric columns of a table.

    Missing and infinite cells of numeric columns count as 0. One scan gives the moments that correlation,
    principal components and factors share. ``key`` columns accompany every row result.
    """

    def __init__(
        self,
        df: DataFrame,
        columns: Sequence[str] | None = None,
        key: Sequence[str] = (),
        variance_threshold: float = 0.80,
        kmo_threshold: float = 0.60,
        moments: Moments | None = None,
    ) -> None:
        if not df.columns:
            raise ValueError("the table is empty")
        self.df = df
        self.key = tuple(key)
        self.columns = [c for c in pick_numeric(df, columns) if c not in self.key]
        if len(self.columns) < 2:
            raise ValueError("at least 2 numeric columns are needed")
        self.variance_threshold = variance_threshold
        self.kmo_threshold = kmo_threshold
        self.values = {c: filled(df, c) for c in self.columns}
        if moments is not None:
            self.__dict__["moments"] = moments

    @cached_property
    def moments(self) -> Moments:
        found = cross_moments(self.df, self.values)
        if not found.n:
            raise ValueError("the table is empty")
        return found

    @property
    def spark(self):
        return self.df.sparkSession

    def standardized(self) -> DataFrame:
        """z-scores with the population deviation; a constant column gives zeros."""
        m = self.moments
        return self.df.select(
            *[col(k) for k in self.key],
            *[((self.values[c] - float(m.mean[i])) / float(m.scale[i])).alias(c) for i, c in enumerate(m.columns)],
        )

    def describe(self) -> DataFrame:
        return describe(self.df, self.columns)

    def correlation(self, method: str | None = None) -> CorrelationResult:
        return correlation(self.df, self.values, method, self.moments)

    def pca(self) -> PCAResult:
        return pca(self.df, self.values, self.moments, self.variance_threshold, self.key)

    def top_variables(self, result: PCAResult, n_top: int = 5) -> DataFrame:
        return pca_module.top_variables_table(result.loadings_df(self.spark), result.components, n_top)

    def factor_analysis(self, n_factors: int | None = None, rotation: str | None = "varimax") -> FactorResult:
        return factor_analysis(self.moments, n_factors, rotation, self.kmo_threshold)

    def mca(self, categorical: Sequence[str], n_components: int = 2, inertia_basis: str = "total") -> MCAResult:
        return mca(self.df, categorical, n_components, self.key, inertia_basis)

    def famd(
        self,
        continuous: Sequence[str],
        categorical: Sequence[str],
        n_components: int = 2,
        inertia_basis: str = "total",
    ) -> FAMDResult:
        return famd(self.df, continuous, categorical, n_components, self.key, inertia_basis)
