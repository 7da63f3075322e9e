"""Level counts and level-pair counts (Burt table) of categorical columns."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.columns import at, col, level_text
from tablescope.functions.tables import small_table
from tablescope.plans.reuse import written

#: variables with few levels share one dense matrix of at most this many levels; the others stay in tables
DENSE_LEVELS = 1500

#: rows are first collapsed to distinct level combinations when no more than this many can exist
MAX_COMBINATIONS = 1_000_000


@dataclass(frozen=True)
class Levels:
    """All levels, ordered by variable (table order) and level text, with their rows."""

    variables: tuple[str, ...]
    names: tuple[tuple[int, str], ...]
    rows: np.ndarray
    n: int
    sums: np.ndarray  # levels x continuous columns

    def __len__(self) -> int:
        return len(self.names)

    @property
    def per_variable(self) -> list[int]:
        return [sum(1 for q, _ in self.names if q == v) for v in range(len(self.variables))]

    @property
    def share(self) -> np.ndarray:
        return self.rows / self.n

    def of(self, variable: int) -> list[int]:
        return [i for i, (q, _) in enumerate(self.names) if q == variable]


def level_rows(df: DataFrame, variables: Sequence[str], values: Sequence[Column] = ()) -> DataFrame:
    """``(position, level, rows, x_0, …)``: rows per level, and the sum of each of ``values`` per level, in one scan."""
    texts = F.array(*[level_text(df, v) for v in variables])
    frame = df.select(
        *[v.alias(f"x_{j}") for j, v in enumerate(values)], F.posexplode(texts).alias("position", "level")
    )
    sums = [F.sum(f"x_{j}").alias(f"x_{j}") for j in range(len(values))]
    return frame.groupBy("position", "level").agg(F.count(F.lit(1)).alias("rows"), *sums)


def _collected(rows: Sequence, variables: Sequence[str], n_values: int) -> Levels:
    found = sorted(rows, key=lambda r: (r["position"], r["level"]))
    n = int(sum(r["rows"] for r in found if r["position"] == 0))
    return Levels(
        tuple(variables),
        tuple((r["position"], r["level"]) for r in found),
        np.array([r["rows"] for r in found], dtype=float),
        n,
        np.array([[r[f"x_{j}"] for j in range(n_values)] for r in found], dtype=float).reshape(len(found), n_values),
    )


def count_levels(df: DataFrame, variables: Sequence[str], values: Sequence[Column] = ()) -> Levels:
    """All levels on the driver: for variables known to have few. ``split_levels`` serves any number."""
    return _collected(level_rows(df, variables, values).collect(), variables, len(values))


@dataclass(frozen=True)
class SplitLevels:
    """Variables with few levels, which the driver knows, and ``wide`` ones, whose levels stay in ``table``.

    ``table`` is ``(position, level, rows, x_0, …)`` of all variables, written once.
    """

    variables: tuple[str, ...]
    n: int
    narrow: Levels
    wide: tuple[str, ...]
    n_levels: int
    table: DataFrame


def split_levels(
    df: DataFrame, variables: Sequence[str], values: Sequence[Column] = (), dense_levels: int | None = None
) -> SplitLevels:
    """Count levels in one scan; variables with the fewest levels are narrow while these fit ``dense_levels``."""
    variables = list(variables)
    room = DENSE_LEVELS if dense_levels is None else dense_levels
    table = written(level_rows(df, variables, values), "levels")
    sizes = {
        r["position"]: (r["levels"], r["rows"])
        for r in table.groupBy("position").agg(F.count(F.lit(1)).alias("levels"), F.sum("rows").alias("rows")).collect()
    }
    total, narrow = 0, []
    for q in sorted(sizes, key=lambda q: (sizes[q][0], q)):
        total += sizes[q][0]
        if total > room:
            break
        narrow.append(q)
    names = [v for q, v in enumerate(variables) if q in narrow]
    place = {variables.index(v): i for i, v in enumerate(names)}
    rows = [r.asDict() for r in table.where(F.col("position").isin(*narrow)).collect()] if narrow else []
    for r in rows:
        r["position"] = place[r["position"]]
    n = sizes[0][1] if sizes else 0
    known = _collected(rows, names, len(values))
    return SplitLevels(
        tuple(variables),
        n,
        Levels(known.variables, known.names, known.rows, n, known.sums),
        tuple(v for v in variables if v not in names) if sizes else (),
        sum(size for size, _ in sizes.values()),
        table,
    )


def pair_counts(df: DataFrame, variables: Sequence[str], n_combinations: float) -> DataFrame:
    """``(pair, level_a, level_b, rows)`` of each pair of variables a < b.

    Rows collapse to level combinations before pairs are formed, unless too many combinations could exist.
    Pairs always combine inside the tasks first, so a shuffle carries level pairs and not rows.
    """
    pairs = variable_pairs(variables)
    texts = [level_text(df, v).alias(f"l_{i}") for i, v in enumerate(variables)]
    frame = df.select(*texts)
    names = [f"l_{i}" for i in range(len(variables))]
    if n_combinations <= MAX_COMBINATIONS:
        frame = frame.groupBy(*names).agg(F.count(F.lit(1)).alias("rows"))
    else:
        frame = frame.withColumn("rows", F.lit(1).cast("bigint"))
    first, second = (F.array(*[F.lit(p[side]) for p in pairs]) for side in (0, 1))
    numbers = F.array(*[F.lit(i) for i in range(len(pairs))])
    return (
        frame.select(F.array(*names).alias("levels"), "rows", F.explode(numbers).alias("pair"))
        .select(
            "pair",
            at(F.col("levels"), at(first, F.col("pair"))).alias("level_a"),
            at(F.col("levels"), at(second, F.col("pair"))).alias("level_b"),
            "rows",
        )
        .groupBy("pair", "level_a", "level_b")
        .agg(F.sum("rows").alias("rows"))
    )


def variable_pairs(variables: Sequence[str]) -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(variables)) for j in range(i + 1, len(variables))]


def burt_matrix(df: DataFrame, levels: Levels) -> np.ndarray:
    """J x J counts of rows holding both levels."""
    burt = np.diag(levels.rows)
    if len(levels.variables) < 2:
        return burt
    index = {name: i for i, name in enumerate(levels.names)}
    pairs = variable_pairs(levels.variables)
    cells = pair_counts(df, levels.variables, math.prod(levels.per_variable)).toArrow()
    for pair, a, b, rows in zip(*[cells[c].to_pylist() for c in ("pair", "level_a", "level_b", "rows")]):
        i, j = index[(pairs[pair][0], a)], index[(pairs[pair][1], b)]
        burt[i, j] = burt[j, i] = rows
    return burt


def burt_table(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """``(var_a, level_a, var_b, level_b, rows)`` for each pair of variables in table order, for any number of levels."""
    sizes = [F.count_distinct(level_text(df, v)) for v in variables]
    n_combinations = math.prod(df.agg(*[s.alias(f"n_{i}") for i, s in enumerate(sizes)]).first())
    pairs = variable_pairs(variables)
    names_a, names_b = (F.array(*[F.lit(variables[p[side]]) for p in pairs]) for side in (0, 1))
    return pair_counts(df, variables, n_combinations).select(
        at(names_a, F.col("pair")).alias("var_a"),
        "level_a",
        at(names_b, F.col("pair")).alias("var_b"),
        "level_b",
        "rows",
    )


def level_weights(
    df: DataFrame,
    levels: Levels,
    weights: np.ndarray,
    carried: Mapping[str, Column],
    dims: Sequence[str],
) -> DataFrame:
    """Add, per row, the summed weights of its levels: ``carried`` columns plus one column per dimension.

    Each variable is a broadcast join with its own levels, of which the driver holds few (``DENSE_LEVELS``).
    """
    spark = df.sparkSession
    frame = df.select(
        *[c.alias(n) for n, c in carried.items()],
        *[level_text(df, v).alias(f"__l{q}") for q, v in enumerate(levels.variables)],
    )
    for q in range(len(levels.variables)):
        rows = [(levels.names[i][1], *[float(w) for w in weights[i]]) for i in levels.of(q)]
        schema = ", ".join([f"__l{q} string", *[f"__w{q}_{k} double" for k in range(len(dims))]])
        frame = frame.join(F.broadcast(small_table(spark, rows, schema)), f"__l{q}", "left")
    totals = []
    for k, dim in enumerate(dims):
        total = F.lit(0.0)
        for q in range(len(levels.variables)):
            total = total + F.coalesce(F.col(f"__w{q}_{k}"), F.lit(0.0))
        totals.append(total.alias(dim))
    return frame.select(*[col(n) for n in carried], *totals)


def existing(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [n for n in names if n in df.columns]
