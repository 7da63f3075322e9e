"""Folders and tables that all operators of this subpackage use."""

from __future__ import annotations

import posixpath
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column
from pyspark.sql import functions as F

from tablescope.functions.workers import import_path
from tablescope.plans.reuse import new_folder, written

__all__ = [
    "SPACE_CLASS", "WORD_CLASS", "as_text", "import_path", "join_path", "new_folder", "open_store", "slices", "utf8",
    "written",
]

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def open_store(uri: str):
    """File system and path of a URI, for range reads inside tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def join_path(folder: str, name: str) -> str:
    return posixpath.join(folder, name)


def as_text(name: str) -> Column:
    """A text column with NULL read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Cells of a string column as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], text: str, max_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``max_bytes`` of text, one row at least."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(text)).fill_null(0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)
