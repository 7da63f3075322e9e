"""Average ranks (ties share their mean rank) of several columns, kept on their rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.columns import at, col, double_array
from tablescope.functions.tables import small_table
from tablescope.plans.reuse import release, written

#: values whose ranks are sent to every task, all columns together: 16 bytes each, so 32 MB
LOOKED_UP_VALUES = 2_000_000

#: a value with more rows than this is looked up, its rows are dealt out; at most HOT_VALUES such values a column
HOT_ROWS, HOT_VALUES = 100_000, 1_000

#: cells that a task holds while it counts equal ones
BLOCK_CELLS = 4_000_000

_RUNS = "position int, value double, rows bigint"
_PLACES = "position int, value double, rows bigint, part int, upto bigint"

#: nearly every value occurs once in its file, so dictionaries would only be built and dropped
_DISTINCT = {"parquet.enable.dictionary": "false"}

_CHANGED = "the table changed between scans; write it once and analyse the written table"

#: position under which all rows are counted
_EVERY_ROW = -1


@dataclass(frozen=True)
class ColumnParts:
    """Distinct values of a column in the table of places: how many, and the rows below each of its parts."""

    position: int
    n_values: int
    first_part: int
    below: list[int]
    most_rows: int


def average_ranks(
    df: DataFrame,
    values: Mapping[str, Column],
    key: Sequence[str] = (),
    looked_up_values: int = LOOKED_UP_VALUES,
    hot_rows: int | None = None,
) -> tuple[int, DataFrame]:
    """(rows, DataFrame of ``key`` and one rank column per value). A NULL has no rank and counts for no other.

    Distinct values travel, not cells. Each task counts its equal cells. Columns with few such counts, up to
    ``looked_up_values`` in all, are ranked in sorted arrays that every task gets. The values of the others are put in
    order by ranges and numbered by a running sum inside each range and a prefix sum over the ranges; rows meet those ranks
    by a join on the value, whose frequent values are looked up and dealt out. Nothing depends on the order of
    rows, so a task that is repeated gives the same ranks.
    """
    names = list(values)
    slot = {n: f"__v{i}" for i, n in enumerate(names)}
    columns = list(slot.values())
    # adding 0.0 turns -0.0 into 0.0
    cells = [(values[n].cast("double") + F.lit(0.0)).alias(slot[n]) for n in names]
    frame = df.select(*[col(k) for k in key], *cells)
    runs = written(frame.select(*columns).mapInArrow(_count_cells(len(columns)), _RUNS), "runs", **_DISTINCT)
    sizes = runs.groupBy("position").agg(F.count(F.lit(1)).alias("runs"), F.sum("rows").alias("rows"))
    totals = {r["position"]: r for r in sizes.collect()}
    n_rows = totals[_EVERY_ROW]["rows"] if totals else 0
    n_runs = {i: totals[i]["runs"] if i in totals else 0 for i in range(len(columns))}
    few, room = _fitting(n_runs, looked_up_values)
    tables = [runs.where(F.col("position").isin(few))] if few else []
    # counts of several blocks, added up, may fit where the counts of each do not
    many = [i for i in n_runs if i not in few]
    places, found = None, {}
    if many:
        places = written(value_places(runs.where(F.col("position").isin(many))), "places", **_DISTINCT)
        found = prefix_sums(places, many)
        fitting, _ = _fitting({i: f.n_values for i, f in found.items()}, room)
        tables += [places.where(F.col("position").isin(fitting))] if fitting else []
        found = {i: f for i, f in found.items() if i not in fitting}
    joined = {columns[i] for i in found}
    frame = _looked_up(frame, tables, {c: i for i, c in enumerate(columns) if c not in joined})
    release(runs, "table")
    for i, f in found.items():
        frame = _joined(frame, columns[i], _column_ranks(places, f), f, hot_rows or max(HOT_ROWS, n_rows // HOT_VALUES))
    if many and not found:
        release(places, "table")
    return n_rows, frame.select(*[col(k) for k in key], *[F.col(slot[n]).alias(n) for n in names])


def _fitting(sizes: Mapping[int, int], room: int) -> tuple[list[int], int]:
    """The positions with the smallest sizes that together fit into ``room``, and the room that is left."""
    chosen = []
    for i in sorted(sizes, key=lambda i: (sizes[i], i)):
        if sizes[i] <= room:
            chosen.append(i)
            room -= sizes[i]
    return chosen, room


def value_places(runs: DataFrame) -> DataFrame:
    """``(position, value, rows, part, upto)``: distinct values of each column by ranges, with a running sum of rows.

    ``runs`` holds counts of values, already combined inside the tasks, in a written table: choosing the ranges reads it a
    second time. One shuffle brings each range together; it is sorted on its executor, spilling where it must, and the
    running sum reads it once in batches.
    """
    ordered = runs.repartitionByRange("position", "value").sortWithinPartitions("position", "value")
    return ordered.mapInArrow(_running_sums, _PLACES)


def _count_cells(n_columns: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Distinct values of each block of rows with their counts, and the rows of the block."""
    most = max(1, BLOCK_CELLS // n_columns)

    def counts(block: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(block)
        yield _batch(_RUN_NAMES, np.int32([_EVERY_ROW]), np.zeros(1), np.int64([table.num_rows]))
        for i, column in enumerate(table.columns):
            value, rows = np.unique(column.drop_null().to_numpy(), return_counts=True)
            yield _batch(_RUN_NAMES, np.full(len(value), i, np.int32), value, rows.astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = [], 0
        for batch in batches:
            block.append(batch)
            held += batch.num_rows
            if held >= most:
                yield from counts(block)
                block, held = [], 0
        if held:
            yield from counts(block)

    return run


_RUN_NAMES = ["position", "value", "rows"]
_PLACE_NAMES = [*_RUN_NAMES, "part", "upto"]


def _batch(names: Sequence[str], *arrays: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=list(names))


def _running_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of equal values added up, and the rows of a column up to each value of this partition.

    A batch's last value waits for the next batch, which may hold more of its counts.
    """
    part, waiting, last, carried = TaskContext.get().partitionId(), None, None, 0

    def summed(position: np.ndarray, value: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        nonlocal last, carried
        upto = np.cumsum(rows)
        starts = np.flatnonzero(np.r_[True, position[1:] != position[:-1]])
        before = np.where(starts > 0, upto[starts - 1], 0)
        if position[0] == last:
            before[0] -= carried
        upto = upto - np.repeat(before, np.diff(np.r_[starts, len(position)]))
        last, carried = position[-1], int(upto[-1])
        return _batch(_PLACE_NAMES, position, value, rows, np.full(len(position), part, np.int32), upto)

    for batch in batches:
        if not batch.num_rows:
            continue
        position, value, rows = (batch.column(i).to_numpy() for i in range(3))
        if waiting is not None:
            position, value, rows = (np.concatenate(both) for both in zip(waiting, (position, value, rows)))
        same = (value[1:] == value[:-1]) | (np.isnan(value[1:]) & np.isnan(value[:-1]))
        starts = np.flatnonzero(np.r_[True, (position[1:] != position[:-1]) | ~same])
        position, value, rows = position[starts], value[starts], np.add.reduceat(rows, starts)
        waiting = position[-1:], value[-1:], rows[-1:]
        if len(starts) > 1:
            yield summed(position[:-1], value[:-1], rows[:-1])
    if waiting is not None:
        yield summed(*waiting)


def prefix_sums(places: DataFrame, positions: Sequence[int]) -> dict[int, ColumnParts]:
    """Of each column the rows below its parts: one line a range and column on the driver."""
    totals = (
        places.groupBy("position", "part")
        .agg(F.count(F.lit(1)).alias("n_values"), F.max("upto").alias("rows"), F.max("rows").alias("most"))
        .collect()
    )
    found = {}
    for i in positions:
        mine = sorted((r for r in totals if r["position"] == i), key=lambda r: r["part"])
        rows = {r["part"]: r["rows"] for r in mine}
        first, end = mine[0]["part"], mine[-1]["part"]
        # a column's parts follow each other; a gap is a range without rows
        below = [0, *accumulate(rows.get(p, 0) for p in range(first, end))]
        found[i] = ColumnParts(i, sum(r["n_values"] for r in mine), first, below, max(r["most"] for r in mine))
    return found


def _column_ranks(places: DataFrame, found: ColumnParts) -> DataFrame:
    """``(__value, __rank, __rows)`` of one column."""
    below = at(double_array(found.below), F.col("part") - F.lit(found.first_part))
    rank = below + F.col("upto") - (F.col("rows") - F.lit(1)) / F.lit(2.0)
    return places.where(F.col("position") == found.position).select(F.col("value").alias("__value"), rank.alias("__rank"), F.col("rows").alias("__rows"))


def _looked_up(frame: DataFrame, tables: Sequence[DataFrame], columns: Mapping[str, int]) -> DataFrame:
    """Values of the columns replaced by their ranks, found in sorted arrays; no row moves.

    ``tables`` hold all counts of the columns' values. The caller has counted them: LOOKED_UP_VALUES at most.
    """
    if not columns:
        return frame
    counts = [t.select("position", "value", "rows").toArrow() for t in tables]
    position, value, rows = (
        np.concatenate([np.empty(0, kind), *[t.column(i).to_numpy() for t in counts]])
        for i, kind in enumerate((np.int32, np.float64, np.int64))
    )
    sorted_ranks = {}
    for c, i in columns.items():
        mine = position == i
        values, which = np.unique(value[mine], return_inverse=True)
        total = np.zeros(len(values), np.int64)
        np.add.at(total, which, rows[mine])
        sorted_ranks[c] = values, np.cumsum(total) - (total - 1) / 2.0
    shared = frame.sparkSession.sparkContext.broadcast(sorted_ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = dict(zip(batch.schema.names, batch.columns))
            for c, (values, ranks) in shared.value.items():
                present = np.asarray(arrays[c].is_valid())
                cells = arrays[c].to_numpy(zero_copy_only=False)[present]
                found = np.searchsorted(values, cells)
                met = values[np.minimum(found, len(values) - 1)] if len(values) else cells[:0]
                if not np.array_equal(met, cells, equal_nan=True):
                    raise RuntimeError(_CHANGED)
                rank = np.full(len(present), np.nan)
                rank[present] = ranks[found]
                arrays[c] = pa.array(rank, mask=~present)
            yield pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))

    return frame.mapInArrow(run, frame.schema)


def _joined(frame: DataFrame, column: str, ranks: DataFrame, found: ColumnParts, hot_rows: int) -> DataFrame:
    """The same for more values than fit on every executor: a join on the value.

    Frequent values, at most as many as ``hot_rows`` go into the table, are looked up; their rows match nothing in the
    join and are dealt out by a hash and the number of their task, so a repeated task deals them as before.
    """
    hot = []
    if found.most_rows > hot_rows:
        hot = ranks.where(F.col("__rows") > hot_rows).collect()
    if not hot:
        met = frame.join(ranks.drop("__rows"), F.col(column) == F.col("__value"), "left")
        return met.withColumn(column, F.col("__rank")).drop("__value", "__rank")
    table = [(r["__value"], r["__rank"], -(-r["__rows"] // hot_rows)) for r in hot]
    known = small_table(frame.sparkSession, table, "__hot double, __known double, __parts bigint")
    mixed = F.xxhash64(*[col(c) for c in frame.columns], F.spark_partition_id())
    salt = F.when(F.col("__parts").isNull(), F.lit(0)).otherwise(F.lit(1) + F.pmod(mixed, F.col("__parts")))
    salted = frame.join(F.broadcast(known), F.col(column) == F.col("__hot"), "left").withColumn("__salt", salt)
    cold = ranks.where(F.col("__rows") <= hot_rows).select("__value", "__rank", F.lit(0).cast("bigint").alias("__cold"))
    met = salted.join(cold, (F.col(column) == F.col("__value")) & (F.col("__salt") == F.col("__cold")), "left")
    return met.withColumn(column, F.coalesce("__known", "__rank")).drop(
        "__hot", "__known", "__parts", "__salt", "__value", "__rank", "__cold"
    )
