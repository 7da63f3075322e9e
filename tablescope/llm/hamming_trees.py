"""SimHash fingerprints, and exact links between them through vantage-point trees.

Equal fingerprints are one point. A tree over a bounded sample of the points (``sample_rows``) only decides how points
are dealt to shards; every point is then indexed. At a node with vantage point v and bound t, points with d(v, x) <= t
go left and points with d(v, x) > t go right; points with t < d(v, x) <= t + radius, near the boundary, go left as
well. By the triangle inequality two points within ``radius`` of each other then meet on at least one side, whatever v
and t are, and so in at least one shard. Inside a shard the same rule splits the points down to small blocks, which
are compared directly. So links are exact; only the amount of copying near boundaries depends on v and t, which are
chosen to make it small.

A block returns for each point with a link its smallest linked point of the block, so that a dense group of m points
gives m rows and never m * m. Links across blocks and shards meet in ``components``, which runs on Spark.

Only few different fingerprints lie close together (2,081 within two bits of any point), so even a group of near
copies that holds a third of all documents spreads over a bounded number of points near each centre.

NULL texts count as empty; empty texts have fingerprint zero and are linked like any other. Rows whose key is NULL take
part; a component of such rows alone has a NULL id. Repeated rows are returned as often as they occur.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.shared import as_text, slices, utf8, written

SEED = 42
SHINGLE = 3
RADIUS = 2
SHARD_ROWS = 20_000
SAMPLE_ROWS = 65_536
BLOCK = 256
#: hashes whose bits are spread at a time, so that the longest text takes little more memory than its words
SPREAD = 100_000
#: rows of two numbers that may go to every task
SMALL_TABLE = 2_000_000

#: Byte b spread over eight byte lanes, its lowest bit in the lowest lane.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def shingle_hashes(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """Hashes of all shingles of ``width`` words, repeats included; shorter texts are one shingle, blank ones none."""
    words = text.lower().split()  # of bytes: A to Z only, and blanks as SPACE_CLASS has them
    if not words:
        return np.empty(0, dtype="<u8")
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have; zero without hashes."""
    if not len(hashes):
        return 0
    sums = np.zeros(64, dtype=np.int64)
    for a in range(0, len(hashes), SPREAD):
        lanes = _LANES[hashes[a : a + SPREAD].view(np.uint8).reshape(-1, 8)]
        # a lane holds sums up to 255
        sums += np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0).view(np.uint8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * sums > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """Majority of the hashes' bits over all shingles of ``width`` words, repeats included; zero without words."""
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, fp); ``fp`` holds the 64 bits as a signed number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = np.array([fingerprint(t, width) for t in utf8(batch.column("text"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(found.view(np.int64))], names=["doc_id", "fp"]
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), as_text(text).alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def distances(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


def best_split(points: np.ndarray, radius: int, rng: np.random.Generator, trials: int = 6) -> tuple | None:
    """Vantage point and bound with the least work below it; None when no bound makes both sides smaller."""
    n, best = len(points), None
    for vantage in points[rng.integers(0, n, trials)]:
        upto = np.cumsum(np.bincount(distances(points, vantage), minlength=65 + radius))
        left = upto[radius : 65 + radius]
        right = n - upto[:65]
        work = left * np.log2(left + 1) + right * np.log2(right + 1)
        work[(left >= 0.95 * n) | (right >= 0.95 * n) | (right == 0)] = np.inf
        t = int(np.argmin(work))
        if np.isfinite(work[t]) and (best is None or work[t] < best[0]):
            best = (work[t], vantage, t)
    return best and best[1:]


def build_tree(points: np.ndarray, leaf: int, radius: int = RADIUS):
    """Nested (vantage, bound, left, right); leaves are numbers from 0. Also the number of leaves."""
    rng, count = np.random.default_rng(7), 0

    def grow(p: np.ndarray):
        nonlocal count
        found = best_split(p, radius, rng) if len(p) > leaf else None
        if found is None:
            count += 1
            return count - 1
        vantage, t = found
        d = distances(p, vantage)
        return vantage, t, grow(p[d <= t + radius]), grow(p[d > t])

    return grow(points), count


def route(points: np.ndarray, tree, radius: int = RADIUS) -> Iterator[tuple[int, np.ndarray]]:
    """Shards and the places of the points that belong there."""
    todo = [(tree, np.arange(len(points)))]
    while todo:
        node, at = todo.pop()
        if isinstance(node, int):
            yield node, at
            continue
        vantage, t, left, right = node
        d = distances(points[at], vantage)
        todo += [(left, at[d <= t + radius]), (right, at[d > t])]


def block_links(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Points of a block that chains of near points connect, each with the first point of its chain."""
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= radius
    linked = np.flatnonzero(near.sum(axis=1) > 1)
    if not len(linked):
        return points[:0], points[:0]
    near, points = near[np.ix_(linked, linked)], points[linked]
    label = np.arange(len(points))
    while True:
        lower = np.where(near, label[None, :], len(points)).min(axis=1)
        if (lower == label).all():
            break
        label = lower
    at = np.flatnonzero(label < np.arange(len(points)))
    return points[at], points[label[at]]


def links(points: np.ndarray, radius: int = RADIUS, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect exactly the points of one shard that chains of near points connect."""
    rng = np.random.default_rng(11)
    todo, found = [np.unique(points)], [(points[:0], points[:0])]
    while todo:
        p = todo.pop()
        if len(p) <= block:
            found.append(block_links(p, radius))
            continue
        split = best_split(p, radius, rng, trials=4)
        if split is None:  # no bound helps: each pair of half blocks together
            half = block // 2
            parts = [p[i : i + half] for i in range(0, len(p), half)]
            found += [
                block_links(np.concatenate([x, y]), radius) for i, x in enumerate(parts) for y in parts[i + 1 :]
            ]
            continue
        vantage, t = split
        d = distances(p, vantage)
        todo += [p[d <= t + radius], p[d > t]]
    a, b = (np.concatenate(x) for x in zip(*found))
    pairs = np.unique(np.stack([a, b], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def near_links(
    points: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """Rows (a, b) that connect the distinct values of ``points.fp`` within ``radius`` bits of each other."""
    n = points.count()
    share = min(1.0, sample_rows / max(n, 1))
    chosen = points.select("fp").where(F.pmod(F.xxhash64("fp"), F.lit(1_000_003)) < F.lit(round(share * 1_000_003)))
    sample = np.array([r.fp for r in chosen.collect()], dtype=np.int64).view(np.uint64)
    shards = max(1, -(-n // shard_rows))
    tree, n_leaves = build_tree(np.sort(sample), max(1, len(sample) // shards), radius)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            for shard, at in route(fps.view(np.uint64), tree, radius):
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), shard)), pa.array(fps[at])], names=["shard", "fp"]
                    )

    def inside(table: pa.Table) -> pa.Table:
        a, b = links(table.column("fp").to_numpy().view(np.uint64), radius)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    dealt = points.select("fp").mapInArrow(deal, "shard bigint, fp bigint")
    return dealt.groupBy("shard").applyInArrow(inside, "a bigint, b bigint").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """Rows (node, label): every node of ``pairs(a, b)`` with the smallest node that it is connected to.

    Each round takes the smallest label among the neighbours, then the label of the label, so that long chains halve.
    The labels of a round are a table in the shared folder.
    """
    edges = written(pairs.union(pairs.select("b", "a")).distinct(), "edges")
    start = edges.groupBy("a").agg(F.min("b").alias("m"))
    labels = written(start.select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        seen = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        lower = labels.join(seen.withColumnRenamed("a", "node"), "node").select(
            "node", F.least("label", "m").alias("near"), F.col("label").alias("old")
        )
        parents = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        moved = lower.join(parents, "near").select("node", F.least("near", "far").alias("label"), "old")
        moved = written(moved, "labels")
        labels = moved.select("node", "label")
        if moved.where("label <> old").isEmpty():
            return labels


def document_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE, radius: int = RADIUS,
    shard_rows: int = SHARD_ROWS, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Rows (doc_id, fp, group_fp, component_id), one for each document; equal ``group_fp`` means one component."""
    found = written(fingerprints(docs, key, text, width), "fingerprints")
    points = written(found.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "points")
    labels = components(near_links(points, radius, shard_rows, sample_rows))
    grouped = points.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("label", "fp").alias("group_fp")
    )
    smallest = grouped.groupBy("group_fp").agg(F.min("first_id").alias("component_id"))
    named = written(grouped.select("fp", "group_fp").join(smallest, "group_fp"), "components")
    return found.join(named, "fp").select("doc_id", "fp", "group_fp", "component_id")


def hex_digits(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the document with the smallest key, once.

    Keys that leave are sent to every task while there are ``SMALL_TABLE`` of them at most, so that texts are not
    shuffled; beyond that both sides are sorted. Rows without a key, and keys on several rows, are decided by their
    texts: one row stays of each component that has no other key, or whose smallest key is theirs.
    """
    found = written(document_components(docs, key, text, **how), "members")
    width = how.get("width", SHINGLE)
    return keep_first(docs, found, lambda texts: fingerprints(texts, "id", "text", width), key, text)


def keep_first(
    docs: DataFrame, found: DataFrame, marks: Callable[[DataFrame], DataFrame], key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row of each component of ``found``, whose columns are those of ``document_components``.

    ``marks`` gives for rows (id, text) their ``fp`` as rows (doc_id, fp).
    """
    kept = docs.columns
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    counted = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(first).alias("first"))
    odd = F.col("doc_id").isNull() | (F.col("n") > 1)
    away = written(counted.where(odd | ~F.col("first")).select(F.col("doc_id").alias("__id"), odd.alias("odd")), "away")
    gone = away.where("__id IS NOT NULL").select("__id")
    if away.count() <= SMALL_TABLE:
        gone = F.broadcast(gone)
    plain = docs.where(F.col(key).isNotNull()).join(gone, F.col(key) == F.col("__id"), "left_anti")
    unclear = away.where("odd").select("__id")
    if unclear.isEmpty():
        return plain.select(*kept)
    rows = docs.join(unclear, F.col(key).eqNullSafe(F.col("__id")), "left_semi").withColumn("__text", as_text(text))
    texts = rows.select(F.col("__text").alias("id"), F.col("__text").alias("text")).distinct()
    groups = found.select("fp", "group_fp", "component_id").distinct()
    marked = marks(texts).join(groups, "fp").select(
        F.col("doc_id").alias("__same"), F.col("group_fp").alias("__group"), F.col("component_id").alias("__first")
    )
    picked = rows.join(marked, F.col("__text") == F.col("__same")).where(F.col(key).eqNullSafe(F.col("__first")))
    return plain.select(*kept).unionByName(picked.dropDuplicates(["__group"]).select(*kept))
