"""Value frequencies: exact distinct counts and modes of many columns with one shuffle.

Distinct whole numbers need no exchange of values: between bounds known from one scan, each is a bit. Tasks set the bits
of 32,768 neighbouring numbers in one map and only maps are shuffled, at most ``BITMAPS`` for a task and column. Wider ranges,
where a task would fill its maps thinly, and doubles are grouped by value.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.columns import cell, col, data_type, is_whole


#: numbers in one map, and maps of a column; beyond this range values are grouped
BITMAP_BITS, BITMAPS = 32_768, 128


def whole_bounds(df: DataFrame, names: Sequence[str]) -> dict[str, tuple[int, int] | None]:
    """Smallest and largest value of whole columns; None without values."""
    if not names:
        return {}
    row = df.agg(*[F.struct(F.min(col(c)).alias("lo"), F.max(col(c)).alias("hi")).alias(f"c_{i}") for i, c in enumerate(names)]).first()
    found = {c: row[f"c_{i}"] for i, c in enumerate(names)}
    return {c: None if r["lo"] is None else (int(r["lo"]), int(r["hi"])) for c, r in found.items()}


def fits_bitmaps(bounds: tuple[int, int]) -> bool:
    return bounds[1] - bounds[0] < BITMAP_BITS * BITMAPS


def distinct_by_bitmaps(df: DataFrame, bounds: dict[str, tuple[int, int]]) -> dict[str, int]:
    """Exact distinct values of whole columns between bounds that ``fits_bitmaps`` accepts; gaps do not count."""
    # the first value is number 1
    place = {c: col(c).cast("bigint") - F.lit(lo) + F.lit(1) for c, (lo, _) in bounds.items()}
    single = [c for c, (lo, hi) in bounds.items() if hi - lo < BITMAP_BITS]
    several = [c for c in bounds if c not in single]
    found = {}
    if single:
        maps = [F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(place[c]))).alias(f"c_{i}") for i, c in enumerate(single)]
        found = dict(zip(single, df.agg(*maps).first()))
    if several:
        cells = df.select(F.posexplode(F.array(*[place[c] for c in several])).alias("position", "v")).where("v IS NOT NULL")
        maps = cells.groupBy("position", F.bitmap_bucket_number("v").alias("bucket")).agg(
            F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("v"))).alias("n")
        )
        counted = {r["position"]: r["n"] for r in maps.groupBy("position").agg(F.sum("n").alias("n")).collect()}
        found |= {c: counted.get(i, 0) for i, c in enumerate(several)}
    return found


def distinct_counts(
    df: DataFrame, names: Sequence[str], bounds: dict[str, tuple[int, int] | None] | None = None
) -> dict[str, int]:
    """Exact numbers of distinct values, whatever the size. ``bounds`` of whole columns save a scan where known."""
    names = list(names)
    whole = [c for c in names if is_whole(df, c)]
    known = {c: b for c, b in (bounds or {}).items() if c in whole}
    known |= whole_bounds(df, [c for c in whole if c not in known])
    mapped = {c: b for c, b in known.items() if b is not None and fits_bitmaps(b)}
    found = distinct_by_bitmaps(df, mapped)
    found |= {c: 0 for c, b in known.items() if b is None}
    rest = value_summary(df, [c for c in names if c not in found], modes=False)
    found |= {c: s.n_distinct for c, s in rest.items()}
    return {c: found[c] for c in names}


def value_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(position, whole, real, rows)``: how often each value of each column occurs.

    Whole numbers keep their own 64-bit key (a double would merge large ids). Equal values collapse before
    the shuffle, so a value that holds a large part of all rows costs each task one row.
    """
    wholes, reals = [], []
    for name in names:
        whole, real = F.lit(None).cast("bigint"), F.lit(None).cast("double")
        if is_whole(df, name):
            whole = col(name).cast("bigint")
        elif isinstance(data_type(df, name), T.BooleanType):
            whole = col(name).cast("int").cast("bigint")
        else:
            real = cell(df, name).cast("double")
        wholes.append(whole)
        reals.append(real)
    cells = df.select(F.array(*wholes).alias("wholes"), F.posexplode(F.array(*reals)).alias("position", "real"))
    return (
        cells.select("position", F.get("wholes", F.col("position")).alias("whole"), "real")
        .groupBy("position", "whole", "real")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


@dataclass(frozen=True)
class ValueSummary:
    n_rows: int
    n_missing: int
    n_distinct: int
    mode: float | int | None


def value_summary(df: DataFrame, names: Sequence[str], modes: bool = True) -> dict[str, ValueSummary]:
    """Rows, missing cells, exact distinct values and, if asked, mode (smallest value on ties) per column."""
    if not names:
        return {}
    present = F.col("whole").isNotNull() | F.col("real").isNotNull()
    top = F.min(F.when(present, F.struct(-F.col("rows"), "whole", "real"))) if modes else F.lit(None)
    found = (
        value_counts(df, names)
        .groupBy("position")
        .agg(
            F.sum("rows").alias("n_rows"),
            F.sum(F.when(present, 0).otherwise(F.col("rows"))).alias("n_missing"),
            F.count_if(present).alias("n_distinct"),
            top.alias("top"),
        )
        .collect()
    )
    summary = {name: ValueSummary(0, 0, 0, None) for name in names}
    for r in found:
        top = r["top"]
        mode = None if top is None else (top["whole"] if top["whole"] is not None else top["real"])
        summary[names[r["position"]]] = ValueSummary(r["n_rows"], r["n_missing"], r["n_distinct"], mode)
    return summary
