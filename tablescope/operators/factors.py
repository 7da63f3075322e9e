"""Factor analysis on the correlation matrix: adequacy checks, minimum-residual extraction, rotations.

The rows are read once for the correlation matrix; everything here works on p x p numbers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tablescope.functions.tables import small_table
from tablescope.functions.tails import chi_square_tail
from tablescope.operators.moments import Moments
from tablescope.operators.pca import ordered_eigen, table_of_loadings

ROTATIONS = ("varimax", "promax")
PROMAX_POWER = 4
UNIQUENESS_BOUNDS = (0.005, 1.0)


def kmo(r: np.ndarray) -> float:
    """Kaiser-Meyer-Olkin index: squared correlations against squared partial correlations."""
    inverse = np.linalg.pinv(r)
    d = np.sqrt(np.abs(np.diag(inverse)))
    partial = -inverse / np.outer(d, d)
    off = ~np.eye(len(r), dtype=bool)
    plain, rest = float((r[off] ** 2).sum()), float((partial[off] ** 2).sum())
    return plain / (plain + rest) if plain + rest > 0 else math.nan


@dataclass(frozen=True)
class Bartlett:
    statistic: float
    df: int
    p_value: float
    singular: bool


def bartlett_sphericity(r: np.ndarray, n_rows: int) -> Bartlett:
    """Chi-square test that the correlation matrix is the identity."""
    p = len(r)
    df = p * (p - 1) // 2
    sign, log_det = np.linalg.slogdet(r)
    if sign <= 0 or not math.isfinite(log_det):
        return Bartlett(math.inf, df, 0.0, True)
    statistic = -log_det * (n_rows - 1 - (2 * p + 5) / 6)
    return Bartlett(float(statistic), df, chi_square_tail(float(statistic), df), False)


def kaiser_count(eigenvalues: np.ndarray) -> int:
    return max(1, int((eigenvalues > 1).sum()))


@dataclass(frozen=True)
class Extraction:
    loadings: np.ndarray
    uniqueness: np.ndarray
    converged: bool
    iterations: int


def minimum_residual(r: np.ndarray, k: int, tolerance: float = 1e-10, iterations: int = 500) -> Extraction:
    """Loadings minimising the squared residual correlations (Harman and Jones 1966).

    With the uniquenesses psi on the diagonal taken off, the best k-factor loadings are leading eigenpairs and
    the loss is half the sum of the squared remaining eigenvalues, with gradient -sum(theta * v_i^2). A damped
    Newton step with curvature (V V')^2 lowers the loss; uniquenesses stay within their bounds.
    """
    low, high = UNIQUENESS_BOUNDS
    start = 1.0 / np.maximum(np.diag(np.linalg.pinv(r)), 1e-12)
    psi = np.clip(start, low, high)

    def remainder(u: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        theta, v = np.linalg.eigh(r - np.diag(u))
        theta, v = theta[: len(r) - k], v[:, : len(r) - k]
        return 0.5 * float(theta @ theta), theta, v

    loss, theta, v = remainder(psi)
    converged, step = False, 0
    for step in range(1, iterations + 1):
        gradient = -(v**2) @ theta
        free = ~(((psi <= low) & (gradient > 0)) | ((psi >= high) & (gradient < 0)))
        if not free.any() or np.abs(gradient[free]).max() < tolerance:
            converged = True
            break
        curvature = (v @ v.T) ** 2
        move = np.zeros_like(psi)
        move[free] = -np.linalg.lstsq(curvature[np.ix_(free, free)], gradient[free], rcond=1e-10)[0]
        for direction in (move, np.where(free, -gradient, 0.0)):
            size, lower = 1.0, False
            while size > 1e-8:
                trial = np.clip(psi + size * direction, low, high)
                found = remainder(trial)
                if found[0] < loss:
                    lower = True
                    break
                size /= 2
            if lower:
                break
        if not lower:
            converged = np.abs(gradient[free]).max() < 1e-6
            break
        gain = loss - found[0]
        psi, (loss, theta, v) = trial, found
        if gain <= 1e-16 * max(loss, 1e-16):
            converged = True
            break
    values, vectors = np.linalg.eigh(r - np.diag(psi))
    order = np.argsort(-values)[:k]
    loadings = vectors[:, order] * np.sqrt(np.maximum(values[order], 0.0))
    return Extraction(_column_sums_positive(loadings), psi, bool(converged), step)


def _column_sums_positive(loadings: np.ndarray) -> np.ndarray:
    signs = np.sign(loadings.sum(axis=0))
    return loadings * np.where(signs == 0, 1.0, signs)


def varimax(loadings: np.ndarray, tolerance: float = 1e-12, iterations: int = 1000) -> np.ndarray:
    """Orthogonal rotation (Kaiser 1958), rows scaled to unit communality while rotating."""
    p, k = loadings.shape
    if k < 2:
        return loadings.copy()
    length = np.sqrt((loadings**2).sum(axis=1))
    length[length == 0] = 1.0
    rows = loadings / length[:, None]
    rotation, before = np.eye(k), 0.0
    for _ in range(iterations):
        turned = rows @ rotation
        target = turned**3 - turned * (turned**2).mean(axis=0)
        u, s, vt = np.linalg.svd(rows.T @ target)
        rotation = u @ vt
        if s.sum() <= before * (1 + tolerance):
            break
        before = s.sum()
    return rows @ rotation * length[:, None]


def promax(loadings: np.ndarray, power: int = PROMAX_POWER) -> tuple[np.ndarray, np.ndarray]:
    """Oblique rotation (Hendrickson and White 1964): pattern loadings and factor correlations."""
    if loadings.shape[1] < 2:
        return loadings.copy(), np.eye(loadings.shape[1])
    simple = varimax(loadings)
    target = np.sign(simple) * np.abs(simple) ** power
    transform = np.linalg.lstsq(simple, target, rcond=None)[0]
    transform = transform * np.sqrt(np.diag(np.linalg.inv(transform.T @ transform)))
    inverse = np.linalg.inv(transform)
    return simple @ transform, inverse @ inverse.T


@dataclass(frozen=True)
class FactorResult:
    variables: tuple[str, ...]
    loadings: np.ndarray
    communalities: np.ndarray
    n_factors: int
    factor_rule: str
    eigenvalues: np.ndarray
    kmo_score: float
    bartlett: Bartlett
    fa_valid: bool
    rotation: str
    factor_correlations: np.ndarray
    converged: bool
    dropped: tuple[str, ...]

    @property
    def factors(self) -> list[str]:
        return [f"F{k + 1}" for k in range(self.n_factors)]

    @property
    def bartlett_p_value(self) -> float:
        return self.bartlett.p_value

    def loadings_df(self, spark: SparkSession) -> DataFrame:
        """``(variable, position, component, loading)``."""
        return table_of_loadings(spark, self.variables, self.factors, self.loadings)

    def communalities_df(self, spark: SparkSession) -> DataFrame:
        rows = [(v, float(c)) for v, c in zip(self.variables, self.communalities)]
        return small_table(spark, rows, "variable string, communality double")

    def eigenvalues_df(self, spark: SparkSession) -> DataFrame:
        rows = [(k + 1, float(v)) for k, v in enumerate(self.eigenvalues)]
        return small_table(spark, rows, "rank int, eigenvalue double")

    def adequacy_df(self, spark: SparkSession) -> DataFrame:
        """One row: KMO, Bartlett's statistic and p-value, verdict, factors."""
        b = self.bartlett
        return small_table(spark, 
            [(self.kmo_score, b.statistic, b.df, b.p_value, b.singular, self.fa_valid, self.n_factors, self.factor_rule)],
            "kmo double, bartlett_statistic double, bartlett_df int, bartlett_p_value double, singular boolean, "
            "fa_valid boolean, n_factors int, factor_rule string",
        )


def adequacy(moments: Moments) -> tuple[float, Bartlett]:
    """KMO and Bartlett over the columns that vary; (0, p = 1) where they cannot be computed."""
    varying = moments.subset(moments.varying)
    failed = Bartlett(0.0, 0, 1.0, True)
    if len(varying.columns) < 2:
        return 0.0, failed
    r = varying.correlation()
    try:
        score = kmo(r)
        return (0.0 if math.isnan(score) else score), bartlett_sphericity(r, varying.n)
    except np.linalg.LinAlgError:
        return 0.0, failed


def factor_analysis(
    moments: Moments,
    n_factors: int | None = None,
    rotation: str | None = "varimax",
    kmo_threshold: float = 0.60,
) -> FactorResult:
    """Extract and rotate. Poor adequacy is reported, it never blocks the analysis."""
    if rotation is not None and rotation not in ROTATIONS:
        raise ValueError(f"rotation must be one of {ROTATIONS} or None, got {rotation!r}")
    if n_factors is not None and n_factors < 1:
        raise ValueError(f"n_factors must be at least 1, got {n_factors}")
    score, bartlett = adequacy(moments)
    varying = moments.subset(moments.varying)
    p = len(varying.columns)
    if p < 2:
        raise ValueError("factor analysis needs at least 2 columns that vary")
    r = varying.correlation()
    eigenvalues, _ = ordered_eigen(r)
    rule = "kaiser" if n_factors is None else "manual"
    k = min(kaiser_count(eigenvalues) if n_factors is None else n_factors, p - 1)
    extraction = minimum_residual(r, k)
    correlations = np.eye(k)
    if rotation == "varimax":
        loadings = varimax(extraction.loadings)
    elif rotation == "promax":
        loadings, correlations = promax(extraction.loadings)
    else:
        loadings = extraction.loadings
    order = np.argsort(-(loadings**2).sum(axis=0), kind="stable")
    signs = np.where(loadings[:, order].sum(axis=0) < 0, -1.0, 1.0)
    loadings = loadings[:, order] * signs
    correlations = correlations[np.ix_(order, order)] * np.outer(signs, signs)
    return FactorResult(
        varying.columns,
        loadings,
        (loadings**2).sum(axis=1),
        k,
        rule,
        eigenvalues,
        score,
        bartlett,
        score >= kmo_threshold and bartlett.p_value < 0.05,
        rotation or "none",
        correlations,
        extraction.converged,
        tuple(c for c in moments.columns if c not in varying.columns),
    )
