"""Packing of documents into windows of fixed length by the sum-of-squares rule.

Every partition packs its own documents, one after another. A document longer than a window fills whole windows first;
its last part, shorter than a window, is placed where the sum over all fill levels h of N(h)**2 becomes least, N(h)
being the number of open windows filled to h. The counts stand in one array of levels, so a placement is one pass over
that array however many windows are open. Equal sums go to the fullest window.

At the end of a partition, and whenever more than ``max_open`` windows are open, open windows are poured into each
other: documents are cut there so that all but the last window are full.

Rows: one per piece. NULL and empty texts hold the closing id alone. Repeated rows are packed as documents of their
own. Only the key and the text are read, so other columns may have any name. An empty table gives no piece.
The window numbers are unique but not consecutive: the partition's number stands in the upper bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.shared import as_text, slices
from tablescope.llm.tokens import word_ids

WINDOW = 2048
CLOSING_ID = 1
#: text encoded at once; the numbers beside its ids take about ten times as much
SLICE_BYTES = 2_000_000
PIECES = (
    "doc_id {key}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
    "offset bigint"
)


class LevelArray:
    """Open windows by fill level; ``place`` names the window that takes an item."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, dtype=np.int64)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def place(self, size: int) -> int | None:
        """Take the best open window for ``size`` ids out of the array; None asks for a new one."""
        room = self.window - size
        before = self.count[1 : room + 1]
        after = self.count[1 + size : self.window + 1].copy()
        # moving one window from h to h + size changes the sum by 2 (N(h + size) - N(h)) + 2; a full one leaves it
        growth = 2 * (after - before) + 2
        if room >= 1:
            growth[-1] = 1 - 2 * before[-1]
        growth = np.where(before > 0, growth, np.iinfo(np.int64).max)
        opening = 2 * self.count[size] + 1
        if not len(growth) or growth.min() > opening:
            return None
        level = len(growth) - int(np.argmin(growth[::-1]))
        self.count[level] -= 1
        return self.open[level].pop()

    def keep(self, window: int, level: int) -> None:
        self.count[level] += 1
        self.open[level].append(window)


class Packer:
    """Packs the documents of one partition; pieces of open windows are kept with their ids until the window closes."""

    def __init__(self, first: int, window: int = WINDOW, max_open: int = 4096):
        self.next, self.window, self.max_open = first, window, max_open
        self.levels = LevelArray(window)
        self.held: dict[int, list[tuple]] = {}
        self.done: list[tuple] = []

    def new(self) -> int:
        self.next += 1
        return self.next - 1

    def emit(self, window: int, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.done.append((doc, start, len(ids), crc32(ids), total, window, offset))
            offset += len(ids)

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.window:
            self.emit(self.new(), [(doc, start, ids[start : start + self.window], total)])
            start += self.window
        if start == total:
            return
        piece = (doc, start, ids[start:].copy(), total)
        size = total - start
        window = self.levels.place(size)
        if window is None:
            window = self.new()
            self.held[window] = []
        held = self.held[window]
        held.append(piece)
        level = sum(len(p[2]) for p in held)
        if level == self.window:
            self.emit(window, self.held.pop(window))
        else:
            self.levels.keep(window, level)
            if len(self.held) > self.max_open:
                self.pour()

    def pour(self) -> None:
        """Cut the pieces of all open windows into full windows and one last window."""
        pieces = [p for w in sorted(self.held) for p in self.held[w]]
        self.held, self.levels = {}, LevelArray(self.window)
        filling, level = [], 0
        for doc, start, ids, total in pieces:
            while len(ids):
                part = ids[: self.window - level]
                filling.append((doc, start, part, total))
                level, start, ids = level + len(part), start + len(part), ids[len(part) :]
                if level == self.window:
                    self.emit(self.new(), filling)
                    filling, level = [], 0
        if filling:
            self.emit(self.new(), filling)

    def take(self) -> list[tuple]:
        done, self.done = self.done, []
        return done


def pack(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, max_open: int = 4096,
    vocabulary: str | None = None,
) -> DataFrame:
    """Pieces of ``docs`` with their windows; ``vocabulary`` is a tokenizer file, by default the public word one."""
    kind = docs.schema[key].dataType
    schema = PIECES.format(key=kind.simpleString())
    names = [x.split()[0] for x in schema.split(", ")]
    arrow = [pa.field(n, pa.int64()) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(vocabulary)
        packer = Packer(TaskContext.get().partitionId() << 33, window, max_open)

        def rows() -> pa.RecordBatch:
            columns = list(zip(*packer.take())) or [[] for _ in names]
            keys = pa.array(list(columns[0]), type=key_type)
            return pa.RecordBatch.from_arrays(
                [keys, *(pa.array(list(c), type=f.type) for c, f in zip(columns[1:], arrow[1:]))], names=names
            )

        key_type = pa.int64()
        for batch in slices(batches, "text", SLICE_BYTES):
            key_type = batch.schema.field("key").type
            ids, bounds = words.of_texts(batch.column("text"))
            for doc, a, b in zip(batch.column("key").to_pylist(), bounds[:-1], bounds[1:]):
                whole = np.empty(b - a + 1, dtype="<u4")
                whole[:-1] = ids[a:b]
                whole[-1] = CLOSING_ID
                packer.add(doc, whole)
            yield rows()
        packer.pour()
        if packer.done:
            yield rows()

    return docs.select(F.col(key).alias("key"), as_text(text).alias("text")).mapInArrow(run, schema)
