"""Exact value-range bins: counting scans that narrow down where rows lie, without moving the rows.

A scan assigns every value of a bracket to one of a few thousand pieces and keeps rows, smallest and largest
value per piece; tasks combine locally, so only the piece counts are shuffled. Pieces that still hold too many
rows become the brackets of the next scan. A value that repeats a lot ends up alone in its own bin.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.columns import at, double_array

#: pieces of the first scan
PIECES = 4096

#: up to this many brackets per column are compared one by one
FEW = 8

#: smaller values share one place on the logarithmic scale
_SMALLEST = 1e-300


@dataclass(frozen=True)
class Bin:
    """Rows with ``low <= value <= high``; both ends occur in the data."""

    low: float
    high: float
    rows: int

    @property
    def single(self) -> bool:
        return self.low == self.high


@dataclass(frozen=True)
class Bracket:
    low: float
    high: float
    pieces: int = PIECES


def bucket_columns(df: DataFrame, splits: Mapping[str, Sequence[float]]) -> DataFrame:
    """Add ``<name>_bin``: index of the last lower end that is not above the value, 0 below the first."""
    columns = [c for c, lows in splits.items() if len(lows) > 1]
    for c in splits:
        if c not in columns:
            df = df.withColumn(f"{c}_bin", F.lit(0))
    if not columns:
        return df
    bucketed = Bucketizer(
        inputCols=[f"{c}_in" for c in columns],
        outputCols=[f"{c}_bucket" for c in columns],
        splitsArray=[[-math.inf, *list(splits[c])[1:], math.inf] for c in columns],
    ).transform(df.withColumns({f"{c}_in": F.coalesce(F.col(c), F.lit(-math.inf)) for c in columns}))
    return bucketed.withColumns({f"{c}_bin": F.col(f"{c}_bucket").cast("int") for c in columns}).drop(
        *[f"{c}_in" for c in columns], *[f"{c}_bucket" for c in columns]
    )


def stacked(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value)``: one row per cell, columns by number."""
    return df.select(F.posexplode(F.array(*[F.col(c) for c in columns])).alias("column", "value"))


def by_column(results: Sequence[Column]) -> Column:
    """The expression that belongs to the row's ``column`` number."""
    if len(results) == 1:
        return results[0]
    chosen = F.when(F.col("column") == 0, results[0])
    for i, result in enumerate(results[1:], start=1):
        chosen = chosen.when(F.col("column") == i, result)
    return chosen


def first_match(conditions: Sequence[Column], results: Sequence[Column]) -> Column:
    """NULL where no condition holds."""
    chosen = F.when(conditions[0], results[0])
    for condition, result in zip(conditions[1:], results[1:]):
        chosen = chosen.when(condition, result)
    return chosen


def _log_place(x: float) -> float:
    """Place on a scale that gives every power of ten the same room, on both sides of zero."""
    size = max(0.0, math.log(abs(x)) - math.log(_SMALLEST)) if x else 0.0
    return math.copysign(size, x)


def _many_decades(b: Bracket) -> bool:
    small, large = sorted((abs(b.low), abs(b.high)))
    return b.low <= 0 <= b.high or large > 16 * small


class _Ruler:
    """The monotone map of a value to its piece, for one bracket or, with ``index``, for many at once.

    Brackets spanning many decades mix an even and a logarithmic scale: half of the resolution of either is
    enough to narrow down both bell-shaped and heavy-tailed columns at every scan.
    """

    def __init__(self, brackets: Sequence[Bracket], index: Column | None = None) -> None:
        self.brackets, self.index = brackets, index

    def number(self, values: Sequence[float]) -> Column:
        return F.lit(float(values[0])) if self.index is None else at(double_array(values), self.index)

    def inside(self, value: Column) -> Column:
        low, high = self.number([b.low for b in self.brackets]), self.number([b.high for b in self.brackets])
        return (value >= low) & (value <= high)

    def piece(self, value: Column) -> Column:
        bs = self.brackets
        # halves keep the width finite for brackets that span the whole double range
        factor = 0.5 if any(math.isinf(b.high - b.low) for b in bs) else 1.0
        width = [b.high * factor - b.low * factor for b in bs]
        begin = [b.low * factor for b in bs]
        scaled = value * factor if factor != 1.0 else value
        share = (scaled - self.number(begin)) / self.number(width)
        if any(_many_decades(b) for b in bs):
            start = [_log_place(b.low) for b in bs]
            length = [max(_log_place(b.high) - s, 1e-9) for b, s in zip(bs, start)]
            size = F.greatest(F.lit(0.0), F.ln(F.abs(value)) - F.lit(math.log(_SMALLEST)))  # ln(0) is NULL
            share = (share + (F.signum(value) * size - self.number(start)) / self.number(length)) / F.lit(2.0)
        last = self.number([b.pieces - 1 for b in bs])
        number = F.floor(share * self.number([b.pieces for b in bs])).cast("double")
        return F.greatest(F.lit(0.0), F.least(number, last)).cast("int")


def split_brackets(df: DataFrame, brackets: Mapping[str, Sequence[Bracket]]) -> dict[str, list[list[Bin]]]:
    """One scan: the occupied pieces of each bracket (brackets of a column are disjoint and ascending)."""
    columns = list(brackets)
    code = _few_codes(df, brackets) if max(map(len, brackets.values())) <= FEW else _many_codes(df, brackets)
    counted = (
        code.where(F.col("code").isNotNull())
        .groupBy("column", "code")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("value").alias("low"), F.max("value").alias("high"))
        .collect()
    )
    found: dict[str, list[list[Bin]]] = {c: [[] for _ in brackets[c]] for c in columns}
    for r in sorted(counted, key=lambda r: (r["column"], r["code"])):
        bins = found[columns[r["column"]]][r["code"] // PIECES]
        piece = Bin(r["low"], r["high"], r["rows"])
        while bins and bins[-1].high >= piece.low:  # neighbours touched by rounding count as one piece
            last = bins.pop()
            piece = Bin(min(last.low, piece.low), max(last.high, piece.high), last.rows + piece.rows)
        bins.append(piece)
    return found


def _few_codes(df: DataFrame, brackets: Mapping[str, Sequence[Bracket]]) -> DataFrame:
    """Bracket and piece as one number, brackets tried one after the other."""
    value = F.col("value")
    codes = []
    for bs in brackets.values():
        rulers = [_Ruler([b]) for b in bs]
        codes.append(
            first_match([r.inside(value) for r in rulers], [r.piece(value) + i * PIECES for i, r in enumerate(rulers)])
        )
    return stacked(df, list(brackets)).withColumn("code", by_column(codes))


def _many_codes(df: DataFrame, brackets: Mapping[str, Sequence[Bracket]]) -> DataFrame:
    """The same with the bracket found by binary search."""
    columns = list(brackets)
    bucketed = bucket_columns(df.select(*columns), {c: [b.low for b in brackets[c]] for c in columns})
    cells = bucketed.select(
        F.array(*[F.col(f"{c}_bin") for c in columns]).alias("indexes"),
        F.posexplode(F.array(*[F.col(c) for c in columns])).alias("column", "value"),
    ).select("column", "value", at(F.col("indexes"), F.col("column")).alias("bracket"))
    value, index = F.col("value"), F.col("bracket")
    rulers = [_Ruler(bs, index) for bs in brackets.values()]
    codes = [F.when(r.inside(value), index * PIECES + r.piece(value)) for r in rulers]
    return cells.withColumn("code", by_column(codes))
