"""One-scan column statistics over the cells that are present."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ColumnStatistics:
    n_rows: int
    n_present: int
    low: float | int | None
    high: float | int | None
    mean: float | None
    variance: float | None  # population
    origin: int = 0  # ``mean`` counts from here: 0 unless whole numbers are too large for doubles

    @property
    def n_missing(self) -> int:
        return self.n_rows - self.n_present

    @property
    def is_constant(self) -> bool:
        """At most one distinct cell content, a missing cell counting as one."""
        if self.n_present == 0:
            return True
        return self.low == self.high and self.n_missing == 0

    def after_fill(self, fill: float | None) -> tuple[float, float]:
        """Mean from ``origin``, and population variance, once missing cells hold ``fill``; no second scan needed."""
        if self.n_missing == 0 or fill is None:
            return self.mean, 0.0 if self.low == self.high else self.variance
        fill = fill - self.origin
        kept, gaps = self.n_present / self.n_rows, self.n_missing / self.n_rows
        spread = 0.0 if self.low == self.high else self.variance
        return self.mean * kept + fill * gaps, spread * kept + kept * gaps * (fill - self.mean) ** 2


#: from here on neighbouring whole numbers can be one double
LARGEST_EXACT = 2**53


def column_statistics(
    df: DataFrame, values: Mapping[str, Column], whole: Mapping[str, Column] | None = None
) -> tuple[int, dict[str, ColumnStatistics]]:
    """Row count, and statistics of each double expression (NULL = missing).

    ``whole`` gives the columns among them that hold whole numbers, in their own type: their bounds are exact. Where
    those exceed what doubles hold exactly, a second scan measures the column from its smallest value.
    """
    if not values:
        return df.count(), {}
    whole = whole or {}
    n, found = _scan(df, values, {c: whole.get(c, v) for c, v in values.items()})
    large = {
        c: s.low
        for c, s in found.items()
        if c in whole and s.n_present and max(abs(s.low), abs(s.high)) >= LARGEST_EXACT
    }
    if large:
        # decimals, since the distance itself may not fit a bigint
        moved = {
            c: (whole[c].cast("decimal(38,0)") - F.lit(str(low)).cast("decimal(38,0)")).cast("double")
            for c, low in large.items()
        }
        _, again = _scan(df, moved, moved)
        for c, low in large.items():
            found[c] = replace(found[c], mean=again[c].mean, variance=again[c].variance, origin=low)
    return n, found


def _scan(
    df: DataFrame, values: Mapping[str, Column], bounds: Mapping[str, Column]
) -> tuple[int, dict[str, ColumnStatistics]]:
    names = list(values)
    row = (
        df.select(
            *[values[c].alias(f"c_{i}") for i, c in enumerate(names)],
            *[bounds[c].alias(f"b_{i}") for i, c in enumerate(names)],
        )
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[
                F.struct(
                    F.count(f"c_{i}").alias("n"),
                    F.min(f"b_{i}").alias("low"),
                    F.max(f"b_{i}").alias("high"),
                    F.avg(f"c_{i}").alias("mean"),
                    F.var_pop(f"c_{i}").alias("variance"),
                ).alias(f"c_{i}")
                for i in range(len(names))
            ],
        )
        .first()
    )
    found = {c: row[f"c_{i}"] for i, c in enumerate(names)}
    return row["n"], {
        c: ColumnStatistics(row["n"], r["n"], r["low"], r["high"], r["mean"], r["variance"]) for c, r in found.items()
    }
