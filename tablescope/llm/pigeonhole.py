"""Benchmark passages inside documents, with a share of edits allowed.

A passage of m characters may differ by k = floor(``edit_share`` * m) edits. It is cut into k + 1 pieces: k edits
cannot touch all of them, so a document with the passage holds one piece exactly. All pieces of a block of passages are
searched in one walk over each text (Aho-Corasick). Where a piece is found, Myers' bit-parallel recurrence verifies the
passage in the text around it, of m + 2k characters at most; places on one diagonal are verified once.

Both sides are compared in lower case with runs of blanks as one space. Passages of fewer than ``least_chars``
characters have no budget and match at word bounds alone: what stands beside them is no letter, digit or underscore.
NULL and blank passages match nothing; equal passages keep each their own item. NULL texts count as empty. Repeated
documents are searched each. Texts of any length are searched whole.

The passages are a stated query set. They are taken in blocks of about ``block_chars`` characters by a hash of the item,
and each block is searched in all documents. A task holds one block: searches of several blocks are tasks of their own,
and a filter by several blocks writes what each has kept before the next one starts.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.shared import as_text, slices, written

EDIT_SHARE = 0.08
LEAST_CHARS = 20
BLOCK_CHARS = 4_000_000


def plain(text: str) -> str:
    return " ".join(text.lower().split())


def budget(passage: str, edit_share: float, least_chars: int = LEAST_CHARS) -> int:
    """Edits that a passage may have; none for short ones."""
    if len(passage) < least_chars:
        return 0
    # the small term keeps shares such as 0.1 * 30 from falling below their whole number
    return int(edit_share * len(passage) + 1e-9)


def at_word_bounds(text: str, a: int, b: int) -> bool:
    """Whether no word goes on beyond either end of ``text[a:b]``."""
    inside = lambda i: 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")
    return not (inside(a - 1) and inside(a)) and not (inside(b - 1) and inside(b))


def pieces(passage: str, k: int) -> Iterator[tuple[int, str]]:
    """k + 1 pieces that cover the passage, their lengths as equal as possible."""
    bounds = [i * len(passage) // (k + 1) for i in range(k + 2)]
    for a, b in zip(bounds, bounds[1:]):
        yield a, passage[a:b]


def myers(masks: dict[str, int], m: int, text: str, most: int) -> tuple[int, int] | None:
    """Least edits with which a pattern ends inside ``text``, and the first such end; None above ``most``.

    ``masks`` has for each character the bits of its places in the pattern of ``m`` characters.
    """
    every, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = every, 0, m, most + 1, -1
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        plus = down | (every & ~(xh | up))
        minus = up & xh
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        if score < best:
            best, end = score, j
        plus = (plus << 1) & every
        minus = (minus << 1) & every
        up = minus | (every & ~(xv | plus))
        down = plus & xv
    return (best, end) if best <= most else None


class Passages:
    """The passages of a block, their pieces in one automaton."""

    def __init__(self, items: list[tuple[int, str]], edit_share: float, least_chars: int = LEAST_CHARS):
        import ahocorasick

        self.least_chars = least_chars
        self.items = [(i, t, budget(t, edit_share, least_chars)) for i, t in items if t]
        where = defaultdict(list)
        for n, (_, t, k) in enumerate(self.items):
            for a, piece in pieces(t, k):
                where[piece].append((n, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()
        self.empty = not where
        self.masks: dict[int, dict[str, int]] = {}

    def mask(self, n: int) -> dict[str, int]:
        if n not in self.masks:
            bits = defaultdict(int)
            for j, c in enumerate(self.items[n][1]):
                bits[c] |= 1 << j
            self.masks[n] = dict(bits)
        return self.masks[n]

    def search(self, text: str) -> dict[int, tuple[int, int]]:
        """Least edits and end of each passage that ``text`` holds, by its place in the block."""
        found: dict[int, tuple[int, int]] = {}
        if self.empty:
            return found
        tried = set()
        for last, (size, places) in self.automaton.iter(text):
            for n, a in places:
                if n in found and found[n][0] == 0:
                    continue
                _, passage, k = self.items[n]
                start = last - size + 1 - a  # where the passage begins if nothing before was inserted or lost
                if len(passage) < self.least_chars:
                    if at_word_bounds(text, start, start + size):
                        found[n] = (0, start + size)
                    continue
                if text.startswith(passage, max(start, 0)):
                    found[n] = (0, max(start, 0) + len(passage))
                    continue
                diagonal = (n, start // (k + 1))
                if k == 0 or diagonal in tried:
                    continue
                tried.add(diagonal)
                # all starts of this diagonal's cell share one window
                low = max(0, diagonal[1] * (k + 1) - k)
                high = diagonal[1] * (k + 1) + k + len(passage) + k
                hit = myers(self.mask(n), len(passage), text[low:high], k)
                if hit and (n not in found or hit[0] < found[n][0]):
                    found[n] = (hit[0], low + hit[1])
        return found


_BLOCKS: dict[str, Passages] = {}


def passage_blocks(benchmark: DataFrame, key: str, text: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The passages, plain, in blocks that the driver holds one at a time."""
    rows = benchmark.select(F.col(key).alias("item_id"), as_text(text).alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()
        yield sorted(((r.item_id, plain(r.text)) for r in part), key=str)


def held_block(name: str, items: list[tuple[int, str]], edit_share: float, least_chars: int) -> Passages:
    """The passages ``name`` in this worker; those of another block are given up first."""
    if name not in _BLOCKS:
        _BLOCKS.clear()
        _BLOCKS[name] = Passages(items, edit_share, least_chars)
    return _BLOCKS[name]


def find_passages(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", edit_share: float = EDIT_SHARE, least_chars: int = LEAST_CHARS,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Rows (doc_id, item_id, edits, end): passages in documents, ``end`` counting characters of the plain text."""
    kinds = (docs.schema[key].dataType.simpleString(), benchmark.schema[item_key].dataType.simpleString())
    rows = docs.select(F.col(key).alias("key"), as_text(text).alias("text"))
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, edits int, end bigint"

    def searching(items: list[tuple[int, str]]):
        name = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = held_block(name, items, edit_share, least_chars)
            for batch in slices(batches, "text"):
                at, out = [], []
                for r, t in enumerate(batch.column("text").to_pylist()):
                    for n, (edits, end) in block.search(plain(t)).items():
                        at.append(r)
                        out.append((block.items[n][0], edits, end))
                ids, edits, ends = zip(*out) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").take(pa.array(at, pa.int64())), pa.array(ids, item_type),
                        pa.array(edits, pa.int32()), pa.array(ends, pa.int64()),
                    ],
                    names=["doc_id", "item_id", "edits", "end"],
                )

        return run

    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(benchmark.schema[item_key].dataType)
    found = None
    for items in passage_blocks(benchmark, item_key, item_text, block_chars):
        part = rows.mapInArrow(searching(items), schema)
        found = part if found is None else found.unionAll(part)
    return found


def without_passages(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
    edit_share: float = EDIT_SHARE, least_chars: int = LEAST_CHARS, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The documents that hold none of the passages, with all their columns; each block filters what the last kept."""
    def keeping(items: list[tuple[int, str]]):
        name = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = held_block(name, items, edit_share, least_chars)
            for batch in slices(batches, text):
                texts = batch.column(text).to_pylist()
                yield batch.filter(pa.array([not block.search(plain(t or "")) for t in texts], pa.bool_()))

        return run

    kept = None
    for items in passage_blocks(benchmark, item_key, item_text, block_chars):
        kept = docs if kept is None else written(kept, "searched")
        kept = kept.mapInArrow(keeping(items), docs.schema)
    return kept
