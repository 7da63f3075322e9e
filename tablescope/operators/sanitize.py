"""Making a table reliable: numeric columns, constant columns out, gaps filled, outlier rows out, all reported.

Fitting reads the table a fixed number of times and keeps only per-column numbers; the clean table is then one
narrow projection and one filter over the input, so nothing is shuffled or stored to produce it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.functions.tables import small_table
from tablescope.functions.columns import cell, col, data_type, is_whole, measure, numeric_columns
from tablescope.operators.quantiles import exact_quantiles
from tablescope.operators.statistics import ColumnStatistics, column_statistics
from tablescope.operators.values import distinct_counts, value_summary

STRATEGIES = ("median", "mean", "most_frequent")


@dataclass(frozen=True)
class SanitizationReport:
    n_rows_input: int = 0
    n_cols_input: int = 0
    dropped_constant_cols: list[str] = field(default_factory=list)
    dropped_low_variance_cols: list[str] = field(default_factory=list)
    imputed_values: int = 0
    outliers_removed: int = 0
    n_rows_output: int = 0
    n_cols_output: int = 0

    @property
    def pct_rows_retained(self) -> float:
        return self.n_rows_output / self.n_rows_input * 100 if self.n_rows_input else 0.0

    @property
    def pct_missing(self) -> float:
        cells = self.n_rows_input * self.n_cols_input
        return self.imputed_values / cells * 100 if cells else 0.0

    @property
    def low_retention(self) -> bool:
        """More than 30 % of the rows were removed."""
        return self.pct_rows_retained < 70

    def to_dict(self) -> dict[str, object]:
        # display names of the report: fixed values
        return {
            "Lignes (entrée)": self.n_rows_input,
            "Colonnes (entrée)": self.n_cols_input,
            "Colonnes constantes supprimées": len(self.dropped_constant_cols),
            "Colonnes quasi-constantes supprimées": len(self.dropped_low_variance_cols),
            "Valeurs imputées": self.imputed_values,
            "Outliers supprimés": self.outliers_removed,
            "Lignes (sortie)": self.n_rows_output,
            "Colonnes (sortie)": self.n_cols_output,
            "% lignes conservées": f"{self.pct_rows_retained:.1f}%",
            "% valeurs manquantes": f"{self.pct_missing:.2f}%",
        }

    def to_df(self, spark: SparkSession) -> DataFrame:
        """One row with every field."""
        return small_table(spark, 
            [
                (
                    self.n_rows_input,
                    self.n_cols_input,
                    self.dropped_constant_cols,
                    self.dropped_low_variance_cols,
                    self.imputed_values,
                    self.outliers_removed,
                    self.n_rows_output,
                    self.n_cols_output,
                    self.pct_rows_retained,
                    self.pct_missing,
                    self.low_retention,
                )
            ],
            "n_rows_input bigint, n_cols_input bigint, dropped_constant_cols array<string>, "
            "dropped_low_variance_cols array<string>, imputed_values bigint, outliers_removed bigint, "
            "n_rows_output bigint, n_cols_output bigint, pct_rows_retained double, pct_missing double, "
            "low_retention boolean",
        )

    def display_df(self, spark: SparkSession) -> DataFrame:
        """``(metric, value)`` as shown to a reader."""
        return small_table(spark, [(k, str(v)) for k, v in self.to_dict().items()], "metric string, value string")


@dataclass(frozen=True)
class ColumnPlan:
    """What is done to a kept column: gap filling, and the centre and spread of its z-score.

    ``mean`` counts from ``origin``, which is not 0 for whole numbers too large for doubles. A column that keeps its type
    takes its fill rounded, if it holds whole numbers.
    """

    name: str
    fill: float | int | None
    mean: float
    sd: float
    origin: int = 0
    keeps_type: bool = False  # the column had no gap while fitting


@dataclass(frozen=True)
class CleaningPlan:
    """Everything fitted on a table; can be applied to any table with the same columns.

    A gap in a column that had none while fitting, and so no fill, fails the job with the column's name; with
    ``sanitize(..., fill_all=True)`` every column has a fill.
    """

    columns: tuple[ColumnPlan, ...]
    zscore_threshold: float
    remove_outliers: bool

    def cell(self, df: DataFrame, plan: ColumnPlan) -> Column:
        """The filled cell: a column keeps its type unless one of its cells had to be filled."""
        own = cell(df, plan.name)
        if plan.fill is None:
            missing = F.raise_error(F.lit(f"{plan.name} has a missing cell, but had none when the plan was fitted"))
            return F.coalesce(own, missing.cast(data_type(df, plan.name)))
        if plan.keeps_type:
            fill = round(plan.fill) if is_whole(df, plan.name) else plan.fill
            return F.coalesce(own, F.lit(fill).cast(data_type(df, plan.name)))
        return F.coalesce(measure(df, plan.name), F.lit(float(plan.fill)))

    def zscore(self, df: DataFrame, plan: ColumnPlan) -> Column:
        value = self.cell(df, plan)
        if plan.origin:
            value = value.cast("decimal(38,0)") - F.lit(str(plan.origin)).cast("decimal(38,0)")
        return (value.cast("double") - F.lit(plan.mean)) / F.lit(plan.sd)

    def zscores(self, df: DataFrame, key: Sequence[str] = ()) -> DataFrame:
        """z-score of every kept cell."""
        return df.select(*[col(k) for k in key], *[self.zscore(df, p).alias(p.name) for p in self.columns])

    def keep(self, df: DataFrame) -> Column | None:
        """True for rows whose every z-score lies strictly inside the threshold."""
        if not self.remove_outliers or not self.columns:
            return None
        inside = [F.abs(self.zscore(df, p)) < F.lit(float(self.zscore_threshold)) for p in self.columns]
        return reduce(lambda a, b: a & b, inside)

    def apply(self, df: DataFrame, key: Sequence[str] = ()) -> DataFrame:
        kept = self.keep(df)
        rows = df if kept is None else df.where(kept)
        named = {p.name for p in self.columns}
        return rows.select(
            *[col(k) for k in key if k not in named], *[self.cell(df, p).alias(p.name) for p in self.columns]
        )


@dataclass(frozen=True)
class SanitizedTable:
    """The lazy clean table with the plan that makes it; the report counts its rows on first use."""

    df: DataFrame
    plan: CleaningPlan
    n_rows_input: int
    n_cols_input: int
    dropped_constant_cols: list[str]
    dropped_low_variance_cols: list[str]
    imputed_values: int
    #: rows of the clean table where they are known already
    n_rows_kept: int | None = None

    @cached_property
    def n_rows_output(self) -> int:
        if self.n_rows_kept is not None:
            return self.n_rows_kept
        filtered = self.plan.columns and self.plan.remove_outliers
        return self.df.count() if filtered else self.n_rows_input

    @cached_property
    def report(self) -> SanitizationReport:
        return SanitizationReport(
            self.n_rows_input,
            self.n_cols_input,
            list(self.dropped_constant_cols),
            list(self.dropped_low_variance_cols),
            self.imputed_values,
            self.n_rows_input - self.n_rows_output,
            self.n_rows_output,
            len(self.plan.columns),
        )


def fill_values(
    df: DataFrame, statistics: dict[str, ColumnStatistics], strategy: str, fill_all: bool = False
) -> dict[str, float | int | None]:
    """Replacement for the missing cells of each column that has any, or of every column."""
    gaps = [c for c, s in statistics.items() if s.n_present and (s.n_missing or fill_all)]
    if strategy == "mean":
        return {c: statistics[c].origin + statistics[c].mean for c in gaps}
    if strategy == "most_frequent":
        return {c: s.mode for c, s in value_summary(df, gaps).items()}
    slots = {c: f"c_{i}" for i, c in enumerate(gaps)}
    known = {slots[c]: (statistics[c].n_present, float(statistics[c].low), float(statistics[c].high)) for c in gaps}
    medians = exact_quantiles(df.select(*[measure(df, c).alias(slots[c]) for c in gaps]), [0.5], known) if gaps else {}
    return {c: medians[slots[c]][0] for c in gaps}


def sanitize(
    df: DataFrame,
    zscore_threshold: float = 3.0,
    min_unique_ratio: float = 0.01,
    imputation_strategy: str = "median",
    exclude: Sequence[str] = (),
    key: Sequence[str] = (),
    fill_all: bool = False,
) -> SanitizedTable:
    """Fit the cleaning plan and return the lazy clean table.

    ``exclude`` leaves identifier columns out of the analysis; ``key`` columns are carried along untouched.
    ``fill_all`` fits a fill for every column, so that the plan serves tables with other gaps.
    Scans: one for the column statistics; one or two for medians, modes or distinct counts when needed.
    """
    if imputation_strategy not in STRATEGIES:
        raise ValueError(f"imputation_strategy must be one of {STRATEGIES}, got {imputation_strategy!r}")
    names = [c for c in numeric_columns(df) if c not in exclude and c not in key]
    whole = {c: col(c) for c in names if is_whole(df, c)}
    n_rows, statistics = column_statistics(df, {c: measure(df, c) for c in names}, whole)

    constant = [c for c in names if statistics[c].is_constant]
    statistics = {c: s for c, s in statistics.items() if c not in constant}
    imputed = sum(s.n_missing for s in statistics.values())
    fills = fill_values(df, statistics, imputation_strategy, fill_all)
    used = {c: f for c, f in fills.items() if statistics[c].n_missing}

    low_variance = _near_constant(df, statistics, used, n_rows, min_unique_ratio)
    plans = []
    for c, s in statistics.items():
        if c in low_variance:
            continue
        mean, variance = s.after_fill(used.get(c))
        if variance <= 0.0:  # one value left once the gaps are filled: no z-score exists
            low_variance.append(c)
            continue
        plans.append(ColumnPlan(c, fills.get(c), mean, variance**0.5, s.origin, keeps_type=c in fills and c not in used))
    plan = CleaningPlan(tuple(plans), zscore_threshold, remove_outliers=n_rows > 1)
    return SanitizedTable(
        plan.apply(df, key),
        plan,
        n_rows,
        len(df.columns),
        constant,
        [c for c in names if c in low_variance],
        imputed,
    )


def _near_constant(
    df: DataFrame,
    statistics: dict[str, ColumnStatistics],
    fills: dict[str, float | int | None],
    n_rows: int,
    min_unique_ratio: float,
) -> list[str]:
    """Columns whose share of distinct values, gaps filled, is below the ratio."""
    if min_unique_ratio <= 0 or not n_rows:
        return []
    # whole numbers between two bounds cannot take more values than the bounds allow
    near = [
        c
        for c, s in statistics.items()
        if is_whole(df, c) and c not in fills and (s.high - s.low + 1) / n_rows < min_unique_ratio
    ]
    bounds = {c: (int(s.low), int(s.high)) for c, s in statistics.items() if is_whole(df, c)}
    distinct = distinct_counts(df, [c for c in statistics if c not in near], bounds)
    # a fill value that no cell holds adds one distinct value; it matters only right at the cut
    edge = [c for c in fills if c in distinct and distinct[c] / n_rows < min_unique_ratio <= (distinct[c] + 1) / n_rows]
    unseen = _unseen_fills(df, {c: fills[c] for c in edge})
    for c, d in distinct.items():
        if (d + (1 if unseen.get(c) else 0)) / n_rows < min_unique_ratio:
            near.append(c)
    return near


def _unseen_fills(df: DataFrame, fills: dict[str, float | int | None]) -> dict[str, bool]:
    if not fills:
        return {}
    row = df.agg(
        *[F.count_if(measure(df, c) == F.lit(float(v))).alias(f"c_{i}") for i, (c, v) in enumerate(fills.items())]
    ).first()
    return {c: row[f"c_{i}"] == 0 for i, c in enumerate(fills)}


def minimum_requirements(
    n_rows: int, n_cols: int, min_rows: int = 10, min_cols: int = 2
) -> list[tuple[str, int, int, bool]]:
    """``(check, actual, required, ok)`` for rows and columns."""
    return [("rows", n_rows, min_rows, n_rows >= min_rows), ("columns", n_cols, min_cols, n_cols >= min_cols)]


def check_minimum_requirements(df: DataFrame, min_rows: int = 10, min_cols: int = 2) -> dict[str, object]:
    """Whether the table can be analysed, and what is lacking. Looks at no more than ``min_rows`` rows."""
    n_rows = df.limit(min_rows).count() if df.columns else 0
    found = minimum_requirements(n_rows, len(df.columns), min_rows, min_cols)
    issues = [f"too few {what}: {actual}, at least {needed} needed" for what, actual, needed, ok in found if not ok]
    return {"valid": not issues, "issues": issues}


def requirements_df(spark: SparkSession, checks: Sequence[tuple[str, int, int, bool]]) -> DataFrame:
    return small_table(spark, list(checks), "check string, actual bigint, required bigint, ok boolean")
