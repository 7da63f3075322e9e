"""Exact interpolated quantiles of many columns in two scans: sketches find brackets, a counting scan what lies in them."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tablescope.operators.bins import Bracket, by_column, first_match, split_brackets, stacked
from tablescope.operators.moments import MERGE_TASKS
from tablescope.operators.ranks import prefix_sums, value_places
from tablescope.plans.reuse import release, written

#: rows that may be left in the brackets when their distinct values are fetched
FETCH_ROWS = 100_000

#: size of a sketch (about 90 kB), and the share of rows by which its ranks may be off: twice the published bound for
#: 99 % of sketches of that size. Only a wish: a rank outside its bracket is noticed, and found by further scans
SKETCH_SIZE = 4_000
SKETCH_ERROR = 2 * 2.296 / SKETCH_SIZE**0.9021


@dataclass(frozen=True)
class _Range:
    low: float
    high: float
    rows: int
    below: int


def exact_quantiles(
    df: DataFrame,
    probabilities: Sequence[float],
    known: Mapping[str, tuple[int, float, float]],
    fetch_rows: int = FETCH_ROWS,
) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation between neighbouring order statistics.

    ``known`` maps each double column of ``df`` to (present rows, min, max); NULLs are skipped.
    """
    ranks = {
        c: sorted({k for p in probabilities for k in (math.floor((n - 1) * p), math.ceil((n - 1) * p))})
        for c, (n, _, _) in known.items()
        if n
    }
    value = order_statistics(df, ranks, {c: known[c] for c in ranks}, fetch_rows)
    result: dict[str, list[float | None]] = {}
    for c, (n, _, _) in known.items():
        if not n:
            result[c] = [None] * len(probabilities)
            continue
        quantiles = []
        for p in probabilities:
            h = (n - 1) * p
            a, b = value[c][math.floor(h)], value[c][math.ceil(h)]
            quantiles.append(a + (b - a) * (h - math.floor(h)))
        result[c] = quantiles
    return result


def order_statistics(
    df: DataFrame,
    ranks: Mapping[str, Sequence[int]],
    known: Mapping[str, tuple[int, float, float]],
    fetch_rows: int = FETCH_ROWS,
) -> dict[str, dict[int, float]]:
    """The values at the given 0-based ranks of each column.

    Up to ``fetch_rows`` rows are fetched in one scan. Beyond, sketches bracket the ranks, and one scan counts the rows
    between the brackets and the values inside them. A rank that its sketch has missed lies in a counted gap, which
    further scans divide.
    """
    value: dict[str, dict[int, float]] = {c: {} for c in ranks}
    place: dict[str, dict[int, _Range]] = {}
    for c, wanted in ranks.items():
        n, low, high = known[c]
        place[c] = {k: _Range(low, high, n, 0) for k in wanted}
    wide = {c: list(ranks[c]) for c in ranks if ranks[c] and known[c][1] < known[c][2]}
    if sum(known[c][0] for c in wide) > fetch_rows:
        for c, k, found in _bracketed(df, wide, known, fetch_rows):
            if isinstance(found, _Range):
                place[c][k] = found
            else:
                value[c][k] = found
                del place[c][k]
    while True:
        for c, targets in place.items():
            for k in [k for k, r in targets.items() if r.low == r.high]:
                value[c][k] = targets.pop(k).low
        place = {c: targets for c, targets in place.items() if targets}
        if not place:
            return value
        ranges = {c: sorted(set(t.values()), key=lambda r: r.low) for c, t in place.items()}
        if sum(r.rows for rs in ranges.values() for r in rs) <= fetch_rows:
            counts = _fetch(df, ranges)
            for c, targets in place.items():
                for k, r in targets.items():
                    value[c][k] = _nth(counts[c][ranges[c].index(r)], k - r.below)
            return value
        found = split_brackets(df, {c: [Bracket(r.low, r.high) for r in rs] for c, rs in ranges.items()})
        for c, targets in place.items():
            for k, r in list(targets.items()):
                below = r.below
                for b in found[c][ranges[c].index(r)]:
                    if k < below + b.rows:
                        targets[k] = _Range(b.low, b.high, b.rows, below)
                        break
                    below += b.rows


def _shares(ranks: Sequence[int], n: int) -> list[tuple[float, float]]:
    """Disjoint ascending shares of the rows around the ranks, as wide as a sketch may be off."""
    found: list[tuple[float, float]] = []
    for k in sorted(ranks):
        start, end = max(k / n - SKETCH_ERROR, 0.0), min((k + 1) / n + SKETCH_ERROR, 1.0)
        if found and start <= found[-1][1]:
            found[-1] = found[-1][0], end
        else:
            found.append((start, end))
    return found


def _sketched_brackets(
    df: DataFrame, shares: Mapping[str, Sequence[tuple[float, float]]], known: Mapping[str, tuple[int, float, float]]
) -> dict[str, list[tuple[float, float]]]:
    """Disjoint ascending brackets of each column's values: one scan, sketches merged in two steps."""
    columns = list(shares)
    row = (
        df.select(*columns, F.pmod(F.spark_partition_id(), F.lit(MERGE_TASKS)).alias("__task"))
        .groupBy("__task")
        .agg(*[F.kll_sketch_agg_double(c, SKETCH_SIZE).alias(c) for c in columns])
        .agg(*[F.kll_merge_agg_double(c, SKETCH_SIZE).alias(c) for c in columns])
        .select(
            *[
                F.kll_sketch_get_quantile_double(c, F.array(*[F.lit(p) for pair in shares[c] for p in pair])).alias(c)
                for c in columns
            ]
        )
        .first()
    )
    brackets: dict[str, list[tuple[float, float]]] = {}
    for c in columns:
        found = brackets[c] = []
        for i, (start, end) in enumerate(shares[c]):
            low = row[c][2 * i] if start > 0 else known[c][1]
            high = row[c][2 * i + 1] if end < 1 else known[c][2]
            if found and low <= found[-1][1]:
                found[-1] = found[-1][0], max(high, found[-1][1])
            else:
                found.append((low, high))
    return brackets


def _bracketed(
    df: DataFrame,
    ranks: Mapping[str, Sequence[int]],
    known: Mapping[str, tuple[int, float, float]],
    fetch_rows: int,
) -> list[tuple[str, int, float | _Range]]:
    """For each column and rank its value, or the gap between brackets where it lies."""
    columns = list(ranks)
    shares = {c: _shares(ranks[c], known[c][0]) for c in columns}
    brackets = _sketched_brackets(df, shares, known)
    counted = _region_counts(df, brackets)
    few = sum((end - start) * known[c][0] for c in columns for start, end in shares[c]) <= fetch_rows
    if few:
        cells = counted.collect()
        regions = _regions(cells)
    else:
        counted = written(counted, "brackets")
        by_region = counted.groupBy("column", "region").agg(
            F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high")
        )
        regions = _regions(by_region.collect())
    result: list[tuple[str, int, float | _Range]] = []
    inside: dict[tuple[int, int], list[int]] = {}
    for i, c in enumerate(columns):
        for k in ranks[c]:
            found = [(at, r) for at, r in regions.items() if at[0] == i and r.below <= k < r.below + r.rows]
            if not found:
                raise RuntimeError(_CHANGED)
            at, region = found[0]
            if at[1] % 2:
                inside.setdefault(at, []).append(k)
            else:
                result.append((c, k, region))
    if few:
        counts: dict[tuple[int, int], list[tuple[float, int]]] = {at: [] for at in inside}
        for r in sorted((r for r in cells if r["value"] is not None), key=lambda r: r["value"]):
            if (r["column"], r["region"]) in counts:
                counts[r["column"], r["region"]].append((r["value"], r["rows"]))
        values = {at: [_nth(counts[at], k - regions[at].below) for k in ks] for at, ks in inside.items()}
    else:
        values = _ranged_places(counted, {at: [k - regions[at].below for k in ks] for at, ks in inside.items()})
        release(counted, "table")
    return result + [(columns[at[0]], k, v) for at, ks in inside.items() for k, v in zip(ks, values[at])]


def _regions(rows: Sequence[Row]) -> dict[tuple[int, int], _Range]:
    """Rows, smallest and largest value of each column's regions, and the rows below them."""
    found: dict[tuple[int, int], _Range] = {}
    for r in rows:
        at = r["column"], r["region"]
        seen = found.get(at, _Range(r["low"], r["high"], 0, 0))
        found[at] = _Range(min(seen.low, r["low"]), max(seen.high, r["high"]), seen.rows + r["rows"], 0)
    below: dict[int, int] = {}
    for at in sorted(found):
        found[at] = replace(found[at], below=below.get(at[0], 0))
        below[at[0]] = found[at].below + found[at].rows
    return found


def _region_counts(df: DataFrame, brackets: Mapping[str, Sequence[tuple[float, float]]]) -> DataFrame:
    """Rows in each region of a column: even ones are the gaps around the brackets, odd ones the brackets by value."""
    value, region = F.col("value"), F.col("region")
    numbers = []
    for found in brackets.values():
        conditions = [test for low, high in found for test in (value < F.lit(low), value <= F.lit(high))]
        numbers.append(first_match(conditions, [F.lit(i) for i in range(len(conditions))]))
    cells = stacked(df, list(brackets)).where(value.isNotNull())
    last = by_column([F.lit(2 * len(found)) for found in brackets.values()])
    return (
        cells.withColumn("region", F.coalesce(by_column(numbers), last))
        .withColumn("kept", F.when(region % 2 == 1, value))
        .groupBy("column", "region", "kept")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("value").alias("low"), F.max("value").alias("high"))
        .withColumnRenamed("kept", "value")
    )


def _ranged_places(
    counted: DataFrame, wanted: Mapping[tuple[int, int], Sequence[int]]
) -> dict[tuple[int, int], list[float]]:
    """Values at the ranks inside brackets of any size: put in order by ranges, one look into the range of each rank."""
    if not wanted:
        return {}
    number = {at: i for i, at in enumerate(wanted)}
    position = first_match([(F.col("column") == c) & (F.col("region") == r) for c, r in number], [F.lit(i) for i in number.values()])
    runs = counted.select(position.alias("position"), "value", "rows").where(F.col("position").isNotNull())
    places = written(value_places(runs), "places")
    parts = prefix_sums(places, list(number.values()))
    looks = []
    for at, ks in wanted.items():
        p = number[at]
        for k in ks:
            nth = bisect_right(parts[p].below, k) - 1
            here = (F.col("position") == p) & (F.col("part") == parts[p].first_part + nth)
            looks.append(F.min(F.when(here & (F.col("upto") > k - parts[p].below[nth]), F.col("value"))))
    row = iter(places.agg(*[look.alias(f"v{i}") for i, look in enumerate(looks)]).first())
    found = {at: [next(row) for _ in ks] for at, ks in wanted.items()}
    release(places, "table")
    return found


_CHANGED = "the table changed between scans; write it once and analyse the written table"


def _nth(counts: Sequence[tuple[float, int]], k: int) -> float:
    for v, rows in counts:
        if k < rows:
            return v
        k -= rows
    raise RuntimeError(_CHANGED)


def _fetch(df: DataFrame, ranges: Mapping[str, Sequence[_Range]]) -> dict[str, list[list[tuple[float, int]]]]:
    """Distinct values with counts inside the ranges: at most ``FETCH_ROWS`` entries by construction."""
    columns = list(ranges)
    value = F.col("value")
    found = [
        first_match([value.between(r.low, r.high) for r in rs], [F.lit(i) for i in range(len(rs))])
        for rs in ranges.values()
    ]
    counted = (
        stacked(df, columns)
        .withColumn("range", by_column(found))
        .where(F.col("range").isNotNull())
        .groupBy("column", "range", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
        .collect()
    )
    result: dict[str, list[list[tuple[float, int]]]] = {c: [[] for _ in ranges[c]] for c in columns}
    for r in sorted(counted, key=lambda r: r["value"]):
        result[columns[r["column"]]][r["range"]].append((r["value"], r["rows"]))
    return result
