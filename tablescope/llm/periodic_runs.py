"""Runs of repeated word sequences: maximal stretches whose period fits into them twice.

Suffix trees of a document's words and of their reversal (Ukkonen), an Euler tour over each with a table of range minima,
and so the common extension of any two places to the right and to the left in constant time. The longest Lyndon word
from each place, under the order of words and under its opposite, is found from the next smaller and the next greater
suffix; by the runs theorem the root of every run is among them, so each candidate is extended once in both directions
and kept if it holds its period twice.

Trees are built over the parts of a document that can hold a run: a run of ``least`` words (12) repeats a sequence of
``least // 2`` words (6) at each of its places, so all of it is covered by such sequences that occur twice in the
document. Those are found first, with vectors over a batch of documents; equal hashes can only add a part, and no run
crosses the end of one. Documents without a repeated sequence need no tree.

NULL and blank texts have no words and no run. A document is handled by one task; the trees take memory in proportion to
its longest repeated parts. Rows are independent: repeated rows and NULL keys are answered each, other columns are not
read, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.shared import as_text, slices
from tablescope.llm.tokens import Words

LEAST = 12


def suffix_tree(word: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Ukkonen's tree of words that end in one that occurs nowhere else: start and end of each node's edge, and its parent.

    Node 0 is the root; the end of a leaf's edge is the length of the text. ``word`` numbers are from 0.
    """
    n, width = len(word), max(word) + 1
    start, end, parent, link = [0], [0], [0], [0]
    child: dict[int, int] = {}  # by node * width + word
    node = length = edge = rest = 0
    for i in range(n):
        w = word[i]
        rest += 1
        last = 0
        while rest:
            if not length:
                edge = i
            key = node * width + word[edge]
            below = child.get(key)
            if below is None:
                child[key] = len(start)
                start.append(i), end.append(n), parent.append(node), link.append(0)
                if last:
                    link[last] = node
                last = 0
            else:
                size = min(end[below], i + 1) - start[below]
                if length >= size:
                    edge += size
                    length -= size
                    node = below
                    continue
                middle = start[below] + length
                if word[middle] == w:
                    if last and node:
                        link[last] = node
                    length += 1
                    break
                fork = len(start)
                start.append(start[below]), end.append(middle), parent.append(node), link.append(0)
                child[key] = fork
                child[fork * width + w] = fork + 1
                start.append(i), end.append(n), parent.append(fork), link.append(0)
                start[below], parent[below] = middle, fork
                child[fork * width + word[middle]] = below
                if last:
                    link[last] = fork
                last = fork
            rest -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - rest + 1
    return start, end, parent


class CommonExtension:
    """Common extensions of pairs of places, and the order of all suffixes, of words whose last occurs once."""

    def __init__(self, word: list[int]):
        start, end, parent = map(np.array, suffix_tree(word))
        n, nodes = len(word), len(start)
        # children of a node side by side, in the order of their words; the root is nobody's child
        kids = 1 + np.lexsort((np.array(word)[start[1:]], parent[1:]))
        above = parent[kids]
        count = np.bincount(above, minlength=nodes)
        begin = np.cumsum(count) - count
        levels, depth = [np.zeros(1, dtype=np.int64)], np.zeros(nodes, dtype=np.int64)
        while True:
            size = count[levels[-1]]
            place = np.repeat(begin[levels[-1]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            if not len(place):
                break
            below = kids[place]
            depth[below] = depth[parent[below]] + end[below] - start[below]
            levels.append(below)
        # the Euler tour where it turns: at every leaf, and at a node between two of its children
        turns = np.where(count, count - 1, 1)
        for below in levels[:0:-1]:
            np.add.at(turns, parent[below], turns[below])
        before = np.cumsum(turns[kids] + 1) - turns[kids] - 1
        offset = np.zeros(nodes, dtype=np.int64)
        offset[kids] = before - np.repeat(before[begin[count > 0]], count[count > 0])
        at = np.zeros(nodes, dtype=np.int64)
        for below in levels[1:]:
            at[below] = at[parent[below]] + offset[below]
        tour = np.zeros(int(turns[0]), dtype=np.int32)
        leaves = np.flatnonzero(count == 0)
        tour[at[leaves]] = depth[leaves]
        later = np.flatnonzero(offset)
        tour[at[later] - 1] = depth[parent[later]]
        suffix = n - depth[leaves]
        self.at = np.empty(n, dtype=np.int64)
        self.at[suffix] = at[leaves]
        self.rank = np.empty(n, dtype=np.int64)
        self.rank[suffix[np.argsort(at[leaves])]] = np.arange(n)
        self.least = [tour]
        while 2 << (len(self.least) - 1) <= len(tour):
            low, reach = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(low[:-reach], low[reach:]))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at ``a`` and ``b``, which differ."""
        x, y = self.at[a], self.at[b]
        x, y = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((y - x + 1).astype(float))[1] - 1
        out = np.empty(len(x), dtype=np.int64)
        for k in np.unique(level).tolist():
            use = level == k
            low = self.least[k]
            out[use] = np.minimum(low[x[use]], low[y[use] - (1 << k) + 1])
        return out


def next_beyond(rank: list[int]) -> tuple[list[int], list[int]]:
    """For each place the next one with a smaller rank, and the next one with a greater; the length where none is."""
    n = len(rank)
    smaller, greater = [n] * n, [n] * n
    low: list[int] = []
    high: list[int] = []
    for i, r in enumerate(rank):
        while low and rank[low[-1]] > r:
            smaller[low.pop()] = i
        low.append(i)
        while high and rank[high[-1]] < r:
            greater[high.pop()] = i
        high.append(i)
    return smaller, greater


def runs_of(numbers: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of all runs of at least ``least`` numbers, by start, then period."""
    n = len(numbers)
    if n < max(least, 2):
        return np.empty((0, 3), dtype=np.int64)
    plain = (np.unique(numbers, return_inverse=True)[1] + 1).tolist()
    right, left = CommonExtension([*plain, 0]), CommonExtension([*plain[::-1], 0])
    smaller, greater = next_beyond(right.rank.tolist())
    i = np.tile(np.arange(n), 2)
    j = np.concatenate([smaller[:n], greater[:n]])
    i, j = i[j < n], j[j < n]
    period = j - i
    to_right = right.common(i, j)
    to_left = np.zeros(len(i), dtype=np.int64)
    inner = i > 0
    to_left[inner] = left.common(n - i[inner], n - j[inner])
    found = np.stack([i - to_left, to_left + period + to_right, period], axis=1)
    found = found[(found[:, 1] >= 2 * period) & (found[:, 1] >= least)]
    return np.unique(found[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def repeated_parts(index: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the stretches of a batch's words covered by sequences of ``width`` words found twice in a text."""
    n, places = len(index), len(index) - width + 1
    if places < 1:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        word = (index.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        word ^= word >> np.uint64(29)
        value = np.zeros(places, dtype=np.uint64)
        for k in range(width):
            value = value * np.uint64(0xBF58476D1CE4E5B9) + word[k : k + places]
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        value += text[:places].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        value ^= value >> np.uint64(32)
    inside = text[:places] == text[width - 1 :]
    ordered = np.sort(value[inside])
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    near = np.minimum(np.searchsorted(twice, value), len(twice) - 1)
    at = np.flatnonzero(inside & (twice[near] == value))
    # a new stretch where the last sequence has ended or another text begins
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] > at[:-1] + width) | (text[at[1:]] != text[at[:-1]])
    begin = at[new]
    end = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)] + width
    return begin, np.minimum(end, n)


def runs_in_batch(index: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> dict[int, np.ndarray]:
    """The runs of each text that has some, by its place in the batch; starts count from the text's first word."""
    begin, end = repeated_parts(index, bounds, least // 2)
    long = end - begin >= least
    begin, end = begin[long], end[long]
    owner = np.searchsorted(bounds, begin, side="right") - 1
    out: dict[int, np.ndarray] = {}
    cuts = np.flatnonzero(np.diff(owner)) + 1
    for group in np.split(np.arange(len(owner)), cuts) if len(owner) else []:
        # one tree for the parts of a text; a number of its own ends each part
        joined, where, extra = [], [], -1
        for a, b in zip(begin[group].tolist(), end[group].tolist()):
            joined += [index[a:b], np.array([extra])]
            where += [np.arange(a, b), np.array([-1])]
            extra -= 1
        found = runs_of(np.concatenate(joined), least)
        if len(found):
            text = int(owner[group[0]])
            found[:, 0] = np.concatenate(where)[found[:, 0]] - bounds[text]
            out[text] = found
    return out


def left_over(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay when every run keeps its first period alone."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(step[:n]) == 0


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """Rows (doc_id, runs, collapsed): runs as (start, length, period) by start, and the words left, joined by a space."""
    if least < 2:
        raise ValueError("a run has two words at least")
    kind = docs.schema[key].dataType.simpleString()
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2_000_000):
            words = Words(batch.column("text"))
            found = runs_in_batch(words.index, words.bounds, least)
            distinct = np.array(words.distinct, dtype=object)
            texts = []
            for t, (a, b) in enumerate(zip(words.bounds[:-1], words.bounds[1:])):
                at = words.index[a:b]
                if t in found:
                    at = at[left_over(b - a, found[t])]
                texts.append(" ".join(distinct[at]))
            sizes = [len(found[t]) if t in found else 0 for t in range(batch.num_rows)]
            rows = np.concatenate([np.empty((0, 3), dtype=np.int64), *(found[t] for t in sorted(found))])
            runs = pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in range(3)], fields=list(run_type))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.ListArray.from_arrays(offsets, runs), pa.array(texts, pa.string())],
                names=["doc_id", "runs", "collapsed"],
            )

    schema = f"doc_id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return docs.select(F.col(key).alias("key"), as_text(text).alias("text")).mapInArrow(run, schema)


def with_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, text) in which a tenth of the documents repeat themselves, as the crc32 of their key says.

    Where it is divisible by ten, words from a = g % n on come in turn from the p words there, g being a tenth of it and
    p = 1 + floor((n - a) / (3 + g % 8)). Documents without a key or a word stay as they are.
    """
    checksum = F.crc32(F.col(key).cast("string").cast("binary"))
    words = F.filter(F.split(as_text(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select(F.col(key).alias("doc_id"), as_text(text).alias("text"), checksum.alias("h"))
    kept = rows.where("h IS NULL OR h % 10 <> 0").select("doc_id", "text")
    chosen = rows.where("h % 10 = 0").withColumn("w", words.alias("w")).selectExpr(
        "doc_id", "w", "size(w) AS n", "h DIV 10 AS g"
    )
    placed = chosen.selectExpr("doc_id", "w", "n", "g", "if(n > 0, g % n, 0) AS a").selectExpr(
        "doc_id", "w", "n", "a", "1 + (n - a) DIV (3 + g % 8) AS p"
    )
    turned = F.expr("transform(w, (x, i) -> if(i < a, x, element_at(w, cast(a + (i - a) % p + 1 AS int))))")
    return kept.unionAll(placed.select("doc_id", F.array_join(turned, " ").alias("text")))
