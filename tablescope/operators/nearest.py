"""The closest pairs among very many points, exactly, with work in proportion to the points.

A grid whose cells hold enough pairs bounds the wanted distances; the points then meet in cells as wide as that bound.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.plans.reuse import written

#: grids halve their cells this often at most; one scan counts every eighth of them, another those between
FINEST, STRIDE = 40, 8

#: axes by whose cells points meet; each doubles the copies of a point
MEETING_AXES = 4


def closest_pairs(points: DataFrame, n_axes: int, n_pairs: int = 10) -> DataFrame:
    """``(name_a, name_b, distance)`` with ``name_a < name_b``, nearest first, ties by name; n log n work, not n * n.

    ``points`` is ``(name string, at array<double>)`` with unique names and ``n_axes`` finite numbers each. The bound:
    a grid cell with c points holds c (c - 1) / 2 pairs no farther apart than its diagonal. Of all grids that hold
    ``n_pairs`` such pairs the finest is taken, so the next finer one, with 2 ** n_axes times as many cells, holds fewer:
    no more than 2 ** n_axes * (n / 2 + n_pairs) pairs are compared to turn its diagonal into a distance. Of points at
    one place the first by name are enough, since their pairs come first.
    """
    same = Window.partitionBy("at").orderBy("name")
    few = points.select("name", "at", F.row_number().over(same).alias("nth")).where(F.col("nth") <= n_pairs + 1)
    few = written(few.drop("nth"), "points")
    apart = distance_bound(few, n_axes, n_pairs)
    if apart is None:
        return few.select(F.col("name").alias("name_a"), F.col("name").alias("name_b"), F.lit(0.0).alias("distance")).limit(0)
    found = meeting_pairs(few, min(n_axes, MEETING_AXES), apart)
    return found.where(F.col("distance") <= apart).orderBy("distance", "name_a", "name_b").limit(n_pairs)


def distance_bound(points: DataFrame, n_axes: int, n_pairs: int) -> float | None:
    """At least the ``n_pairs``-th smallest distance, or that of any two points if there are fewer pairs; None without points."""
    corners = points.agg(
        *[g(F.get("at", F.lit(k))).alias(f"{g.__name__}_{k}") for k in range(n_axes) for g in (F.min, F.max)]
    ).first()
    if corners["min_0"] is None:
        return None
    low = [corners[f"min_{k}"] for k in range(n_axes)]
    span = max(corners[f"max_{k}"] - low[k] for k in range(n_axes))
    least = max(span, max(map(abs, low))) * 1e-12 or 1e-12
    if span == 0.0:
        return least
    unit = [(F.get("at", F.lit(k)) - F.lit(x)) / F.lit(span) for k, x in enumerate(low)]
    held = _pairs_held(points, unit, list(range(0, FINEST + 1, STRIDE)))
    if held[0] < n_pairs:  # there are not that many pairs
        return span * n_axes**0.5 * (1 + 1e-9)
    coarse = max(g for g, pairs in held.items() if pairs >= n_pairs)
    held |= _pairs_held(points, unit, list(range(coarse + 1, coarse + STRIDE)))
    finest = max(g for g, pairs in held.items() if pairs >= n_pairs)
    cells = points.select("name", "at", _cell(unit, F.lit(2.0**finest)).alias("cell"))
    pairs = _distances(cells, cells).orderBy("distance").limit(n_pairs)
    return pairs.agg(F.max("distance")).first()[0] * (1 + 1e-9) + least


def meeting_pairs(points: DataFrame, n_axes: int, apart: float) -> DataFrame:
    """Every pair no farther than ``apart``, once, with others that share a cell of twice that width.

    A point waits in its own cell and visits the cells that its surroundings touch: one or two along each axis.
    """
    width = F.lit(2 * apart)
    axes = [F.get("at", F.lit(k)) for k in range(n_axes)]
    waiting = points.select("name", "at", _cell(axes, 1 / width).alias("cell"))
    sides = [[F.floor((x + F.lit(s)) * (1 / width)) for s in (-apart, apart)] for x in axes]
    touched = F.array_distinct(F.array(*[F.array(*corner) for corner in product(*sides)]))
    return _distances(waiting, points.select("name", "at", F.explode(touched).alias("cell")))


def _pairs_held(points: DataFrame, unit: list[Column], grids: list[int]) -> dict[int, int]:
    """How many pairs share a cell, for each grid of 2 ** grid cells along the longest axis; cells are counted in the tasks first."""
    shifts = F.explode(F.array(*[F.struct(F.lit(g).alias("grid"), F.lit(2.0**g).alias("cells")) for g in grids]))
    placed = points.select("at", shifts.alias("g")).select("g.grid", _cell(unit, F.col("g.cells")).alias("cell"))
    counted = placed.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("c"))
    held = counted.groupBy("grid").agg(F.sum(F.expr("c * (c - 1) div 2")).alias("pairs"))
    return {r["grid"]: r["pairs"] for r in held.collect()}


def _cell(axes: list[Column], cells: Column) -> Column:
    return F.array(*[F.floor(x * cells) for x in axes])


def _distances(waiting: DataFrame, visiting: DataFrame) -> DataFrame:
    """``(name_a, name_b, distance)`` of all that meet in a cell, each pair with its smaller name first."""
    left = waiting.select(F.col("name").alias("x"), F.col("at").alias("here"), "cell")
    right = visiting.select(F.col("name").alias("y"), F.col("at").alias("there"), "cell")
    squares = F.zip_with("here", "there", lambda a, b: (a - b) * (a - b))
    gap = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, s: total + s))
    met = left.join(right, "cell").where(F.col("x") < F.col("y"))
    return met.select(F.col("x").alias("name_a"), F.col("y").alias("name_b"), gap.alias("distance"))
