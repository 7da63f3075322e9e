"""Leading axes of the level matrix when several wide variables meet in a table of level pairs.

A block Krylov method with short restarts: each round keeps the wanted vectors x, the step p that led to them and their
residuals r, takes the best vectors of that space, and multiplies the matrix with the new residuals alone. The products of
x and p are combinations of known ones, so a round is one product and one scan that adds up the products inside
the space. The residual of each axis, |M x - value x|, bounds how far its value is from one of the matrix; the
axes have converged when that is at most ``TOLERANCE`` for all of them.

Vectors are array columns of one table with a row for each wide level, beside the level's row w of the dense part; that
table is written once a round, and the one before the last is removed. The driver holds the entries on the dense
columns and small products.

Levels whose vectors fit ``SENT_NUMBERS`` go to every task, and rows that meet in a block of ``BLOCK_ROWS`` are held as one
short matrix: full where the block's levels mostly meet, as places and counts elsewhere. A product is then one scan of
the blocks, without a shuffle of pairs. More levels are joined to the table of pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.functions.columns import col, text_hash
from tablescope.functions.tables import small_table
from tablescope.plans.reuse import release, written

#: tasks that add up the sums of others
MERGE_TASKS = 8
TOLERANCE = 5e-7
ROUNDS, SPARE = 60, 22
SHORT = 1e-7
#: numbers of all wide levels' vectors that tasks may be sent at once: 32 MB
SENT_NUMBERS = 4_000_000
#: rows of a block, and the most cells a row may cost for the block's matrix to be full
BLOCK_ROWS, FULL_CELLS = 262_144, 4
#: ranges of levels that add up the tasks' products
RANGES = 32

_CHANGED = "the table changed between scans; write it once and analyse the written table"

LEVEL = ("id", "rows", "own", "place", "cells")
LEVEL_SCHEMA = "id bigint, rows bigint, own array<double>, place array<int>, cells array<double>"


def dense_rows(batch: pa.RecordBatch, p: int, m: int, n: int) -> np.ndarray:
    """The rows w of a batch of wide levels: ``p`` standardised columns, then the narrow levels, ``m`` in all."""
    out = np.zeros((batch.num_rows, m))
    rows = batch.column("rows").to_numpy().astype(float)
    if p:
        own = batch.column("own").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, p)
        out[:, :p] = own / np.sqrt(rows * n)[:, None]
    place = batch.column("place")
    sizes = np.diff(place.offsets.to_numpy())
    out[np.repeat(np.arange(batch.num_rows), sizes), p + place.flatten().to_numpy()] = (
        batch.column("cells").flatten().to_numpy()
    )
    return out


def blocks(batches: Iterator[pa.RecordBatch], m: int) -> Iterator[pa.RecordBatch]:
    """Batches whose dense rows of ``m`` numbers take 32 MB at most."""
    step = max(1, 4_000_000 // max(m, 1))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def summed(df: DataFrame, add: Callable[[pa.RecordBatch], np.ndarray], m: int) -> np.ndarray | None:
    """The sum of an array over all batches: each task adds up its own, a few tasks those of the others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in blocks(batches, m):
            if batch.num_rows:
                total = add(batch) if total is None else total + add(batch)
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()]), pa.array([total.astype(float).tobytes()], pa.binary())],
                names=["task", "total"],
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = sorted(
            part for batch in batches for part in zip(batch.column("task").to_pylist(), batch.column("total").to_pylist())
        )
        if parts:
            total = np.zeros(len(parts[0][1]) // 8)
            for _, data in parts:
                total += np.frombuffer(data)
            yield pa.RecordBatch.from_arrays(
                [pa.array([parts[0][0]]), pa.array([total.tobytes()], pa.binary())], names=["task", "total"]
            )

    schema = "task bigint, total binary"
    found = df.mapInArrow(run, schema).repartition(MERGE_TASKS, "task").mapInArrow(merge, schema).collect()
    parts = [np.frombuffer(bytes(r["total"])) for r in sorted(found, key=lambda r: r["task"])]
    return np.sum(parts, axis=0) if parts else None


@dataclass(frozen=True)
class LevelMatrix:
    """M: the dense ``block``, the rows w of wide levels in ``met``, and what wide levels share in ``pairs``.

    ``pairs`` is ``(id, other, together)`` in both directions; with ``wide`` it is the blocks of ``pair_blocks`` over that many
    levels; ``root`` has the roots of the dense columns' shares, 0 for the ``p`` standardised columns.
    """

    met: DataFrame
    pairs: DataFrame
    block: np.ndarray
    root: np.ndarray
    p: int
    n: int
    wide: int = 0

    @property
    def m(self) -> int:
        return len(self.block)


@dataclass(frozen=True)
class KrylovAxes:
    values: np.ndarray
    dense: np.ndarray
    wide: DataFrame  # (id, x)
    residuals: np.ndarray
    rounds: int

    @property
    def converged(self) -> bool:
        return bool((self.residuals <= TOLERANCE * max(1.0, float(self.values.max(initial=0.0)))).all())


def vectors(batch: pa.RecordBatch, name: str, b: int) -> np.ndarray:
    column = batch.column(name)
    if column.null_count:
        column = column.fill_null([0.0] * b)
    return column.flatten().to_numpy().reshape(batch.num_rows, b)


def lists(values: np.ndarray) -> pa.ListArray:
    n, b = values.shape
    return pa.ListArray.from_arrays(np.arange(0, b * n + 1, b, dtype=np.int32), np.ascontiguousarray(values).ravel())


def space_products(matrix: LevelMatrix, state: DataFrame, names: Sequence[str], b: int):
    """Over the wide levels: products of all columns of the vectors ``names``, and their sums along w and the roots."""
    k, p, m, n = len(names) * b, matrix.p, matrix.m, matrix.n

    def add(batch: pa.RecordBatch) -> np.ndarray:
        v = np.hstack([vectors(batch, c, b) for c in names])
        share = np.sqrt(batch.column("rows").to_numpy() / n)
        return np.concatenate([v.T @ v, dense_rows(batch, p, m, n).T @ v, (share @ v)[None, :]])

    found = summed(state, add, m)
    found = np.zeros((k + m + 1, k)) if found is None else found.reshape(k + m + 1, k)
    return found[:k], found[k:-1], found[-1]


def combined(state: DataFrame, names: Sequence[str], mixes: dict[str, np.ndarray], b: int) -> DataFrame:
    """Beside each level the vectors that the matrices ``mixes`` make of those named; lazy."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.hstack([vectors(batch, c, b) for c in names])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in LEVEL), *(lists(v @ t) for t in mixes.values())], names=[*LEVEL, *mixes]
            )

    return state.mapInArrow(run, LEVEL_SCHEMA + "".join(f", {c} array<double>" for c in mixes))


def fits(n_levels: int, n_axes: int) -> bool:
    """Whether tasks may be sent the vectors of so many wide levels."""
    return n_levels * (n_axes + SPARE) <= SENT_NUMBERS


def level_hashes(spark: SparkSession, levels: Sequence[dict[str, int]]) -> tuple[int, list[tuple[np.ndarray, np.ndarray]]]:
    """A seed with which no two texts of one variable share a hash, and for each variable the hashes in order and the numbers."""
    table = small_table(
        spark, [(k, text, number) for k, known in enumerate(levels) for text, number in known.items()],
        "k int, text string, number bigint",
    )
    for seed in count():
        found = table.select("k", "number", text_hash(F.col("text"), seed).alias("hash")).toArrow()
        k, number, hashed = (found.column(i).to_numpy() for i in range(3))
        result = []
        for i in range(len(levels)):
            order = np.argsort(hashed[k == i])
            result.append((hashed[k == i][order], number[k == i][order]))
        if all((np.diff(h) != 0).all() for h, _ in result):
            return seed, result


def pair_blocks(rows: DataFrame, levels: Sequence[dict[str, int]]) -> DataFrame:
    """Blocks ``(first, other, row, column, together)`` of rows of level texts, a column for each of ``levels``, which number
    the texts.

    ``together`` counts the rows of the levels first[row] and other[column]; without ``row`` it is a full matrix. A pair may
    lie in several blocks. Arrays are bytes, whole numbers of 32 bits, counts of as few bytes as the largest needs.

    Rows reach Python as hashes of their texts, two numbers instead of two strings.
    """
    columns = ("first", "other", "row", "column", "together")
    seed, hashes = level_hashes(rows.sparkSession, levels)
    known = rows.sparkSession.sparkContext.broadcast(hashes)

    def block(first: np.ndarray, i: np.ndarray, other: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        cell, size = i * len(other) + j, len(first) * len(other)
        row = column = np.empty(0)
        if size <= FULL_CELLS * len(cell):
            together = np.bincount(cell, minlength=size)
        else:
            cell, together = np.unique(cell, return_counts=True)
            row, column = np.divmod(cell, len(other))
        kinds = (*["<i4"] * 4, np.min_scalar_type(together.max()).newbyteorder("<"))
        arrays = zip((first, other, row, column, together), kinds)
        data = [pa.array([v.astype(kind).tobytes()], pa.binary()) for v, kind in arrays]
        return pa.RecordBatch.from_arrays(data, names=list(columns))

    def emptied(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for met, (hashed, numbers) in zip(pa.Table.from_batches(held).combine_chunks().columns, known.value):
            coded = met.chunk(0).dictionary_encode()
            seen = coded.dictionary.to_numpy()
            place = np.minimum(np.searchsorted(hashed, seen), len(hashed) - 1)
            if not np.array_equal(hashed[place], seen):
                raise RuntimeError(_CHANGED)
            found.append((numbers[place], coded.indices.to_numpy().astype(np.int64)))
        for k, one in enumerate(found):
            for two in found[k + 1 :]:
                yield block(*one, *two)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= BLOCK_ROWS:
                yield from emptied(held)
                held, n = [], 0
        if n:
            yield from emptied(held)

    texts = rows.select(*[text_hash(col(c), seed).alias(c) for c in rows.columns])
    return texts.mapInArrow(run, ", ".join(f"{c} binary" for c in columns))


def block_product(pairs: DataFrame, t: np.ndarray) -> np.ndarray:
    """For each level the rows of ``t`` of the levels it meets, times the rows they share, added up over all blocks."""
    sent, (n, b) = pairs.sparkSession.sparkContext.broadcast(t), t.shape
    step = -(-n // RANGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, out = sent.value, np.zeros((n, b))
        for batch in batches:
            for at_row in range(batch.num_rows):
                *cells, counts = (c[at_row].as_buffer() for c in batch.columns)
                first, other, row, column = (np.frombuffer(c, "<i4") for c in cells)
                together = np.frombuffer(counts, f"<u{counts.size // (len(row) or len(first) * len(other))}")
                if not len(row):
                    full = together.reshape(len(first), len(other)).astype(float)
                    out[first] += full @ t[other]
                    out[other] += full.T @ t[first]
                    continue
                weight = together[:, None].astype(float)
                for to, by, at, held in ((first, row, column, other), (other, column, row, first)):
                    order = np.argsort(by, kind="stable")
                    starts = np.searchsorted(by[order], np.arange(len(to)))
                    out[to] += np.add.reduceat((t[held][at] * weight)[order], starts, axis=0)
        task = TaskContext.get().partitionId()
        for k in range(RANGES):
            part = out[k * step : (k + 1) * step]
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k]), pa.array([task]), pa.array([part.tobytes()], pa.binary())], names=["k", "task", "total"]
                )

    def merge(parts: pa.Table) -> pa.Table:
        found = sorted(zip(parts.column("task").to_pylist(), parts.column("total").to_pylist()))
        total = np.sum([np.frombuffer(data) for _, data in found], axis=0)
        return pa.table({"k": parts.column("k")[:1], "total": pa.array([total.tobytes()], pa.binary())})

    found = pairs.mapInArrow(run, "k bigint, task bigint, total binary").groupBy("k").applyInArrow(merge, "k bigint, total binary")
    out = np.zeros((n, b))
    for r in found.collect():
        out[r["k"] * step : (r["k"] + 1) * step] = np.frombuffer(bytes(r["total"])).reshape(-1, b)
    sent.destroy()
    return out


def met_vectors(matrix: LevelMatrix, state: DataFrame, b: int) -> tuple[DataFrame, Callable[[pa.RecordBatch], np.ndarray]]:
    """``state``, and what gives for a batch of it the sums of r / sqrt(rows) over the wide levels that each level meets."""
    if matrix.wide:
        held = state.select("id", "rows", "r").toArrow().combine_chunks()
        scaled = np.zeros((matrix.wide, b))
        for batch in held.to_batches():
            scaled[batch.column("id").to_numpy()] = vectors(batch, "r", b) / np.sqrt(batch.column("rows").to_numpy())[:, None]
        sums = state.sparkSession.sparkContext.broadcast(block_product(matrix.pairs, scaled))
        return state, lambda batch: sums.value[batch.column("id").to_numpy()]
    scaled = [(F.get("r", F.lit(i)) / F.sqrt("rows")).alias(f"t_{i}") for i in range(b)]
    # pairs hold both directions; hot levels are split where the join finds them skewed
    crossed = (
        matrix.pairs.join(state.select(F.col("id").alias("other"), *scaled), "other")
        .groupBy("id")
        .agg(F.array(*[F.sum(F.col("together") * F.col(f"t_{i}")) for i in range(b)]).alias("e"))
    )
    return state.join(crossed, "id", "left"), lambda batch: vectors(batch, "e", b)


def with_product(matrix: LevelMatrix, state: DataFrame, dense: np.ndarray, along: np.ndarray, b: int) -> DataFrame:
    """``state`` with ``mr``, the wide part of M times ``r``; ``dense`` is the other part of r, ``along`` its sum by roots."""
    p, m, n, middle = matrix.p, matrix.m, matrix.n, along + matrix.root @ dense
    kept = state.columns
    met, sums = met_vectors(matrix, state, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, m):
            rows, r = batch.column("rows").to_numpy().astype(float), vectors(batch, "r", b)
            y = r + dense_rows(batch, p, m, n) @ dense + sums(batch) / np.sqrt(rows)[:, None]
            y -= np.sqrt(rows / n)[:, None] * middle
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), lists(y)], names=[*kept, "mr"])

    schema = LEVEL_SCHEMA + "".join(f", {c} array<double>" for c in [*kept[len(LEVEL) :], "mr"])
    return met.mapInArrow(run, schema)


def unit_mix(gram: np.ndarray, least: float) -> np.ndarray:
    """What makes orthonormal columns of those with the products ``gram``, in as many columns; zero ones are left over.

    Products of vectors about 1 long are known to 1e-16, so columns shorter than ``SHORT`` are noise and are dropped, and so
    are directions of less than ``least`` of the largest among the columns scaled to 1.
    """
    known = np.diag(gram) > SHORT**2
    scale = np.where(known, 1 / np.sqrt(np.where(known, np.diag(gram), 1.0)), 0.0)
    size, turn = np.linalg.eigh((gram + gram.T) / 2 * np.outer(scale, scale))
    kept = size > least * size.max(initial=1e-300)
    out = np.zeros_like(gram)
    out[:, kept] = scale[:, None] * turn[:, kept] / np.sqrt(size[kept])
    return out


def best_vectors(gram: np.ndarray, product: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """The b largest values of the matrix within a space, and their vectors in its basis, which may be dependent."""
    basis = unit_mix(gram, 1e-6)
    basis = basis[:, basis.any(axis=0)]
    values, inner = np.linalg.eigh(basis.T @ ((product + product.T) / 2) @ basis)
    values, found = values[::-1][:b], (basis @ inner[:, ::-1])[:, :b]
    missing = b - len(values)  # in spaces of fewer dimensions the other vectors are zero
    return np.pad(values, (0, missing)), np.pad(found, ((0, 0), (0, missing)))


def leading_axes(matrix: LevelMatrix, n_axes: int, rounds: int = ROUNDS) -> KrylovAxes:
    """The ``n_axes`` largest values of M and their vectors, with the residual of each."""
    b, m = n_axes + SPARE, matrix.m
    seed = F.transform(
        F.sequence(F.lit(1), F.lit(b)), lambda i: F.xxhash64("position", "level", i) / F.lit(2.0**63)
    )
    start = written(matrix.met.select(*LEVEL, seed.alias("r")), "krylov")
    basis, dense = ["r"], {"r": np.random.default_rng(13).standard_normal((m, b))}
    _, cross, along = space_products(matrix, start, basis, b)
    state, old = start, start
    for done in range(1, rounds + 1):
        dense["mr"] = matrix.block @ dense["r"] + cross - np.outer(matrix.root, along)
        state = written(with_product(matrix, state, dense["r"], along, b), "krylov")
        release(old, "table")
        old = state
        names = [*basis, *(f"m{c}" for c in basis)]
        found, cross, along = space_products(matrix, state, names, b)
        whole = np.hstack([dense[c] for c in names])
        gram, k = found + whole.T @ whole, len(basis) * b
        values, c = best_vectors(gram[:k, :k], gram[:k, k:], b)
        both = np.vstack([-c * values, c])  # what makes the residuals of all columns
        residuals = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", both, gram, both), 0.0))
        axes = np.vstack([c, np.zeros_like(c)])
        enough = (residuals[:n_axes] <= TOLERANCE * max(1.0, values[0])).all()
        if enough or done == rounds:
            break
        none = np.zeros_like(c)
        mixes = {"x": axes, "mx": np.vstack([none, c])}
        if basis[0] == "x":
            step = c.copy()
            step[:b] = 0.0
            step -= c @ (c.T @ gram[:k, :k] @ step)
            step = step @ unit_mix(step.T @ gram[:k, :k] @ step, 1e-8)
            mixes |= {"p": np.vstack([step, none]), "mp": np.vstack([none, step])}
        mixes["r"] = both @ unit_mix(both.T @ gram @ both, 1e-8)
        state = combined(state, names, mixes, b)
        cross, along = cross @ mixes["r"], along @ mixes["r"]
        dense = {name: whole @ mix for name, mix in mixes.items()}
        basis = [name for name in mixes if not name.startswith("m")]
    wide = combined(state, names, {"x": axes}, b).select("id", "x")
    return KrylovAxes(np.maximum(values[:n_axes], 0.0), (whole @ axes)[:, :n_axes], wide, residuals[:n_axes], done)
