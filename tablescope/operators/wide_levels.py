"""Axes of level matrices with more levels than one dense matrix holds.

The matrix is M = B - r r', B holding rows(a, b) / sqrt(rows(a) rows(b)) for levels a and b, r the square roots of the
level shares; for mixed data the standardised columns stand in front, with the products sqrt(share) * mean as their
cells beside levels. Within one variable B is the identity.

One wide variable is eliminated exactly. Its levels meet the other columns in w, one short row per level, and only
G = sum of w w' is needed: an eigenvector's part u on the wide levels lies in the span of w, so the eigenproblem of M
becomes one of twice the dense size,

    | I          G**(1/2) |
    | G**(1/2)   A        |

with A the block of all other columns, and u = w G**(-1/2) x. Equal eigenvalues 1 beyond those span what is orthogonal
to w and belong to no association.

Several wide variables meet each other in a table of level pairs; there the leading axes come from ``level_krylov``, each
with a bound of its error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.columns import level_text, text_hash
from tablescope.functions.tables import small_table
from tablescope.functions.workers import number_batches
from tablescope.operators.level_krylov import (
    BLOCK_ROWS, LevelMatrix, blocks, dense_rows, fits, leading_axes, pair_blocks, summed,
)
from tablescope.operators.levels import SplitLevels
from tablescope.plans.reuse import written

#: tasks that add up products of the dense columns, one matrix each
PRODUCT_TASKS = 32


@dataclass(frozen=True)
class WideAxes:
    """Leading axes of M: dense part, and ``(variable, level, rows, v_0, …)`` of the wide variables' levels."""

    eigenvalues: np.ndarray
    dense: np.ndarray
    table: DataFrame
    squares: dict[str, np.ndarray]  # by wide variable: sum of its squared entries on each axis
    residuals: np.ndarray  # |M x - value x| of each axis; 0 where axes are solved directly
    converged: bool


def meeting_rows(df: DataFrame, split: SplitLevels, sd: np.ndarray, gapless: bool = False) -> DataFrame:
    """``(id, variable, level, rows, own, place, cells)`` of each wide level; its row w is 0 outside ``place``.

    ``gapless`` numbers few levels from 0. ``own`` are its sums of standardised columns. Pairs combine inside the tasks first, so a level with a third of all
    rows is as short as any other.
    """
    spark, narrow = df.sparkSession, split.narrow
    sums = [F.col(f"x_{j}") / F.lit(float(s)) for j, s in enumerate(sd)]
    levels = split.table.where(
        F.col("position").isin(*[split.variables.index(v) for v in split.wide])
    ).select("position", "level", "rows", F.array(*sums).cast("array<double>").alias("own"))
    levels = levels.coalesce(1) if gapless else levels
    numbered = written(levels.withColumn("id", F.monotonically_increasing_id()), "wide-levels")
    names = F.array(*[F.lit(v) for v in split.variables])
    if not len(narrow):
        nothing = "CAST(array() AS array<int>) AS place", "CAST(array() AS array<double>) AS cells"
        return numbered.selectExpr("*", *nothing).withColumn("variable", F.get(names, F.col("position")))
    wide = F.array(
        *[
            F.struct(F.lit(split.variables.index(v)).alias("position"), level_text(df, v).alias("level"))
            for v in split.wide
        ]
    )
    few = F.array(
        *[F.struct(F.lit(q).alias("q"), level_text(df, v).alias("text")) for q, v in enumerate(narrow.variables)]
    )
    counted = (
        df.select(wide.alias("wide"), few.alias("few"))
        .select(F.explode("wide").alias("w"), "few")
        .select("w", F.explode("few").alias("f"))
        .groupBy("w.position", "w.level", "f.q", "f.text")
        .agg(F.count(F.lit(1)).alias("together"))
    )
    known = small_table(
        spark,
        [(q, text, i, float(narrow.rows[i])) for i, (q, text) in enumerate(narrow.names)],
        "q int, text string, place int, place_rows double",
    )
    met = (
        counted.join(F.broadcast(known), ["q", "text"])  # at most DENSE_LEVELS rows
        .groupBy("position", "level")
        .agg(F.array_sort(F.collect_list(F.struct("place", "together", "place_rows"))).alias("met"))
    )
    joined = numbered.join(met, ["position", "level"])
    cells = F.transform("met", lambda m: m["together"] / F.sqrt(m["place_rows"] * F.col("rows")))
    return joined.select(
        "id", F.get(names, F.col("position")).alias("variable"), "position", "level", "rows", "own",
        F.col("met.place").alias("place"), cells.alias("cells"),
    )


def wide_axes(df: DataFrame, split: SplitLevels, block: np.ndarray, sd: np.ndarray, n_axes: int) -> WideAxes:
    """Leading axes of M. ``block`` is the part of M over the standardised columns and the narrow levels, in that order;
    ``sd`` are the deviations of those columns, by which the level sums in ``split`` are divided."""
    p, m, n = len(sd), len(block), split.n
    root = np.concatenate([np.zeros(p), np.sqrt(split.narrow.rows / n)])
    sent = len(split.wide) > 1 and fits(split.n_levels - len(split.narrow), n_axes)
    met = written(meeting_rows(df, split, sd, gapless=sent), "meeting")
    residuals, converged = np.zeros(n_axes), True
    if len(split.wide) == 1:
        values, dense, table = _eliminated(met, block, root, p, m, n, n_axes)
    else:
        found, table = _iterated(df, split, met, block, root, p, n, n_axes, sent)
        values, dense, residuals, converged = found.values, found.dense, found.residuals, found.converged
    dense, table = _oriented(split, dense, table, p, n_axes)
    table = written(table, "wide-axes")
    sums = [F.sum(F.col(f"v_{k}") ** 2).alias(f"s_{k}") for k in range(n_axes)]
    squares = {
        r["variable"]: np.array([r[f"s_{k}"] for k in range(n_axes)])
        for r in table.groupBy("variable").agg(*sums).collect()
    }
    return WideAxes(values, dense, table, squares, residuals, converged)


def _axis_columns(met: DataFrame, entries: Callable[[pa.RecordBatch], np.ndarray], n_axes: int, m: int) -> DataFrame:
    schema = "variable string, position int, level string, rows bigint, " + ", ".join(
        f"v_{k} double" for k in range(n_axes)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, m):
            names = ["variable", "position", "level", "rows"]
            found = entries(batch)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), *(pa.array(found[:, k]) for k in range(n_axes))],
                names=names + [f"v_{k}" for k in range(n_axes)],
            )

    return met.mapInArrow(run, schema)


def _eliminated(met, block, root, p, m, n, n_axes):
    def products(batch: pa.RecordBatch) -> np.ndarray:
        w = dense_rows(batch, p, m, n)
        return (w.T @ w).ravel()

    found = summed(met.coalesce(PRODUCT_TASKS), products, m) if m else None
    gram = np.zeros((m, m)) if found is None else found.reshape(m, m)
    gram = gram - np.outer(root, root)
    size, turn = np.linalg.eigh(gram)
    kept = size > 1e-12 * max(1.0, float(size.max(initial=0.0)))
    size, turn = size[kept], turn[:, kept]
    k = len(size)
    whole = np.zeros((k + m, k + m))
    whole[:k, :k] = np.eye(k)
    whole[:k, k:] = np.sqrt(size)[:, None] * turn.T
    whole[k:, :k] = whole[:k, k:].T
    whole[k:, k:] = block
    values, vectors = np.linalg.eigh(whole)
    order = np.argsort(-values, kind="stable")[:n_axes]
    inner, dense = vectors[:k, order], vectors[k:, order]
    y = turn @ (inner / np.sqrt(size)[:, None])
    middle = root @ y

    def entries(batch: pa.RecordBatch) -> np.ndarray:
        share = np.sqrt(batch.column("rows").to_numpy() / n)
        return dense_rows(batch, p, m, n) @ y - share[:, None] * middle

    return np.maximum(values[order], 0.0), dense, _axis_columns(met, entries, len(order), m)


def _iterated(df, split, met, block, root, p, n, n_axes, sent):
    wide = split.n_levels - len(split.narrow) if sent else 0
    pairs = _wide_blocks(df, split, met) if sent else written(_wide_pairs(df, split, met), "wide-pairs")
    found = leading_axes(LevelMatrix(met, pairs, block, root, p, n, wide), n_axes)
    kept = met.select("id", "variable", "position", "level", "rows").join(found.wide, "id")
    entries = [F.get("x", F.lit(k)).alias(f"v_{k}") for k in range(n_axes)]
    return found, kept.select("variable", "position", "level", "rows", *entries)


def _wide_blocks(df: DataFrame, split: SplitLevels, met: DataFrame) -> DataFrame:
    """Rows of two wide levels in blocks; the levels are few enough to be sent to every task."""
    known = [{} for _ in split.variables]
    for r in met.select("position", "level", "id").collect():  # at most SENT_NUMBERS / SPARE rows
        known[r["position"]][r["level"]] = r["id"]
    texts = df.select(*[level_text(df, v).alias(f"l_{i}") for i, v in enumerate(split.wide)])
    blocks = pair_blocks(texts, [known[split.variables.index(v)] for v in split.wide])
    with number_batches(texts, BLOCK_ROWS):  # pair_blocks hands over hashes of the texts
        return written(blocks, "wide-pairs")


def _wide_pairs(df: DataFrame, split: SplitLevels, met: DataFrame) -> DataFrame:
    """``(id, other, together)`` for levels of two wide variables that share rows, in both directions."""
    names = [f"l_{i}" for i in range(len(split.wide))]
    texts = df.select(*[level_text(df, v).alias(c) for v, c in zip(split.wide, names)])
    place = {v: split.variables.index(v) for v in split.wide}
    sides = [
        F.struct(
            F.lit(place[a]).alias("pa"), F.col(x).alias("la"), F.lit(place[b]).alias("pb"), F.col(y).alias("lb")
        )
        for i, (a, x) in enumerate(zip(split.wide, names))
        for b, y in list(zip(split.wide, names))[i + 1 :]
    ]
    counted = (
        texts.select(F.explode(F.array(*sides)).alias("s")).groupBy("s.pa", "s.la", "s.pb", "s.lb")
        .agg(F.count(F.lit(1)).alias("together"))
    )
    first = met.select(F.col("id"), F.col("position").alias("pa"), F.col("level").alias("la"))
    second = met.select(F.col("id").alias("other"), F.col("position").alias("pb"), F.col("level").alias("lb"))
    found = counted.join(first, ["pa", "la"]).join(second, ["pb", "lb"]).select("id", "other", "together")
    return found.union(found.select("other", "id", "together"))


def _oriented(split: SplitLevels, dense: np.ndarray, table: DataFrame, p: int, n_axes: int):
    """Flip axes so that the first entry of (nearly) largest size is positive, columns first, then levels in order."""
    table = written(table, "wide-axes")
    tops = table.agg(*[F.max(F.abs(f"v_{k}")).alias(f"t_{k}") for k in range(n_axes)]).first()
    edge = [max(float(tops[k] or 0.0), float(np.abs(dense[:, k]).max(initial=0.0))) * (1 - 1e-9) for k in range(n_axes)]
    at = F.struct("position", "level")
    firsts = table.agg(
        *[
            F.min(F.when(F.abs(f"v_{k}") >= edge[k], F.struct(at.alias("at"), F.col(f"v_{k}").alias("v")))).alias(f"f_{k}")
            for k in range(n_axes)
        ]
    ).first()
    order = [(-1, "")] * p + [(split.variables.index(split.narrow.variables[q]), t) for q, t in split.narrow.names]
    flips = []
    for k in range(n_axes):
        found = [(order[i], dense[i, k]) for i in np.flatnonzero(np.abs(dense[:, k]) >= edge[k])[:1]]
        if firsts[f"f_{k}"] is not None:
            found.append((tuple(firsts[f"f_{k}"]["at"]), firsts[f"f_{k}"]["v"]))
        flips.append(-1.0 if min(found)[1] < 0 else 1.0)
    named = [F.col(c) for c in ("variable", "position", "level", "rows")]
    return dense * np.array(flips), table.select(
        *named, *[(F.col(f"v_{k}") * F.lit(flips[k])).alias(f"v_{k}") for k in range(n_axes)]
    )


def _hash_seed(levels: DataFrame) -> int:
    """A seed with which no two texts ``level`` of a variable share a hash."""
    for seed in count():
        shared = F.count(F.lit(1)) != F.count_distinct(text_hash(F.col("level"), seed))
        if not any(r["shared"] for r in levels.groupBy("variable").agg(shared.alias("shared")).collect()):
            return seed


def add_wide_weights(
    frame: DataFrame, df: DataFrame, axes: WideAxes, split: SplitLevels, factor: float, names: Sequence[str]
) -> DataFrame:
    """``frame`` holds the text of each wide variable as ``__w0``, …; the weights of its level are added to the columns
    ``names``. A weight is ``factor`` * entry / sqrt(share).

    Levels that may be sent to every task go there by the hash of their text, whatever its length, so no row is shuffled.
    """
    sent = fits(split.n_levels - len(split.narrow), len(names))
    seed = _hash_seed(axes.table) if sent else 0
    for i, v in enumerate(split.wide):
        weights = [
            (F.col(f"v_{k}") * F.lit(factor) / F.sqrt(F.col("rows") / F.lit(float(split.n)))).alias(f"__a{k}")
            for k in range(len(names))
        ]
        level = text_hash(F.col("level"), seed) if sent else F.col("level")
        part = axes.table.where(F.col("variable") == v).select(level.alias(f"__w{i}"), *weights)
        if sent:
            frame = frame.withColumn(f"__w{i}", text_hash(F.col(f"__w{i}"), seed)).join(F.broadcast(part), f"__w{i}", "left")
        else:
            frame = frame.join(part, f"__w{i}", "left")
        added = {c: F.col(f"`{c}`") + F.coalesce(F.col(f"__a{k}"), F.lit(0.0)) for k, c in enumerate(names)}
        frame = frame.withColumns(added).drop(f"__w{i}", *[f"__a{k}" for k in range(len(names))])
    return frame


def wide_texts(df: DataFrame, split: SplitLevels) -> dict[str, Column]:
    return {f"__w{i}": level_text(df, v) for i, v in enumerate(split.wide)}


def wide_coordinates(axes: WideAxes, split: SplitLevels, factors: Sequence[float], names: Sequence[str]) -> DataFrame:
    """``(variable, level, share, dim, coordinate)``: factor * entry / sqrt(share) of each wide level on each axis."""
    share = F.col("rows") / F.lit(float(split.n))
    cells = [
        F.struct(F.lit(c).alias("dim"), (F.col(f"v_{k}") * F.lit(float(factors[k])) / F.sqrt(share)).alias("coordinate"))
        for k, c in enumerate(names)
    ]
    return axes.table.select("variable", "level", share.alias("share"), F.explode(F.array(*cells)).alias("c")).select(
        "variable", "level", "share", "c.dim", "c.coordinate"
    )
