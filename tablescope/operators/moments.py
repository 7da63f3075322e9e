"""Means and the cross-product matrix of several columns in one scan."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import nullcontext
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame

from tablescope.functions.workers import number_batches


@dataclass(frozen=True)
class Moments:
    """Population moments of ``columns`` over ``n`` rows."""

    columns: tuple[str, ...]
    n: int
    mean: np.ndarray
    cov: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @property
    def constant(self) -> np.ndarray:
        return self.low == self.high

    @property
    def sd(self) -> np.ndarray:
        return np.where(self.constant, 0.0, np.sqrt(np.maximum(np.diag(self.cov), 0.0)))

    @property
    def scale(self) -> np.ndarray:
        """Divisor for standardising: a constant column is divided by 1."""
        sd = self.sd
        return np.where(sd > 0.0, sd, 1.0)

    @property
    def varying(self) -> list[int]:
        return [i for i, s in enumerate(self.sd) if s > 0.0]

    def subset(self, index: Sequence[int]) -> Moments:
        ix = list(index)
        return Moments(
            tuple(self.columns[i] for i in ix),
            self.n,
            self.mean[ix],
            self.cov[np.ix_(ix, ix)],
            self.low[ix],
            self.high[ix],
        )

    def correlation(self) -> np.ndarray:
        """Pearson matrix with unit diagonal; NaN against a constant column."""
        sd = np.where(self.sd > 0.0, self.sd, np.nan)
        r = np.clip(self.cov / np.outer(sd, sd), -1.0, 1.0)
        np.fill_diagonal(r, np.where(np.isnan(sd), np.nan, 1.0))
        return r

    def standardized_cov(self) -> np.ndarray:
        """Covariance of the standardised columns; a constant column contributes zeros."""
        return np.nan_to_num(self.correlation(), nan=0.0)


def cross_moments(df: DataFrame, values: Mapping[str, Column]) -> Moments:
    """Moments of the given non-null double expressions, in one scan for any number of columns.

    Each task folds its rows, block by block, into one centred product matrix; two of them combine around their common
    mean, so a mean that dwarfs the spread costs no digits. The matrices meet in a few tasks before the driver.
    """
    names = tuple(values)
    plain = df.select(*[values[c].cast("double").alias(f"x_{i}") for i, c in enumerate(names)])
    parts = plain.mapInArrow(_fold_rows(len(names)), _PARTIAL).repartition(MERGE_TASKS, "task")
    merged = parts.mapInArrow(_merge_partials(len(names)), _PARTIAL)
    few = 0 < len(names) <= FEW_COLUMNS
    with number_batches(plain, min(BLOCK_ROWS, BLOCK_CELLS // len(names))) if few else nullcontext():
        rows = merged.collect()
    total = _Partial.empty(len(names))
    for r in sorted(rows, key=lambda r: r["task"]):
        total = total.plus(_Partial.read(bytes(r["partial"]), len(names)))
    incomplete = [c for c, gaps in zip(names, total.missing) if gaps]
    if incomplete:
        raise ValueError(f"columns with missing cells: {incomplete}; fill them first")
    if not total.n:
        nothing = np.full(len(names), np.nan)
        return Moments(names, 0, nothing, np.full((len(names), len(names)), np.nan), nothing, nothing)
    flat = total.low == total.high
    cov = np.where(flat[:, None] | flat[None, :], 0.0, total.products / total.n)
    return Moments(names, total.n, total.mean, (cov + cov.T) / 2, total.low, total.high)


_PARTIAL = "task int, partial binary"
MERGE_TASKS = 16
#: rows and cells of a block; more columns, whose product matrices are large, go in Spark's batches
BLOCK_ROWS, BLOCK_CELLS, FEW_COLUMNS = 262_144, 2_000_000, 64


@dataclass(frozen=True)
class _Partial:
    """Rows seen: their number, gaps by column, mean, bounds, and products around the mean."""

    n: int
    missing: np.ndarray
    mean: np.ndarray
    low: np.ndarray
    high: np.ndarray
    products: np.ndarray

    @staticmethod
    def empty(p: int) -> _Partial:
        zero = np.zeros(p)
        return _Partial(0, zero, zero, np.full(p, np.inf), np.full(p, -np.inf), np.zeros((p, p)))

    @staticmethod
    def of(block: np.ndarray) -> _Partial:
        missing = np.isnan(block).sum(axis=0).astype(float)
        mean = block.mean(axis=0)
        centred = block - mean
        return _Partial(len(block), missing, mean, block.min(axis=0), block.max(axis=0), centred.T @ centred)

    def plus(self, other: _Partial) -> _Partial:
        if not self.n or not other.n:
            return other if other.n else self
        n = self.n + other.n
        step = other.mean - self.mean
        return _Partial(
            n,
            self.missing + other.missing,
            self.mean + step * (other.n / n),
            np.minimum(self.low, other.low),
            np.maximum(self.high, other.high),
            self.products + other.products + np.outer(step, step) * (self.n * other.n / n),
        )

    def write(self) -> bytes:
        return np.concatenate(
            [[self.n], self.missing, self.mean, self.low, self.high, self.products.ravel()]
        ).tobytes()

    @staticmethod
    def read(data: bytes, p: int) -> _Partial:
        v = np.frombuffer(data)
        missing, mean, low, high = v[1 : 1 + 4 * p].reshape(4, p)
        return _Partial(int(v[0]), missing, mean, low, high, v[1 + 4 * p :].reshape(p, p))


def _row(task: int, partial: _Partial) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([task], pa.int32()), pa.array([partial.write()], pa.binary())], names=["task", "partial"]
    )


def _fold_rows(p: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _Partial.empty(p)
        for batch in batches:
            if batch.num_rows:
                columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                total = total.plus(_Partial.of(np.stack(columns, axis=1).astype(float)))
        if total.n:
            yield _row(TaskContext.get().partitionId(), total)

    return run


def _merge_partials(p: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(
            (task, data)
            for batch in batches
            for task, data in zip(batch.column("task").to_pylist(), batch.column("partial").to_pylist())
        )
        total = _Partial.empty(p)
        for _, data in found:
            total = total.plus(_Partial.read(data, p))
        if found:
            yield _row(found[0][0], total)

    return run
