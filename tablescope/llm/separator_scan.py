"""Token counts of documents in flat files that hold ids and nothing else.

A file is a run of little-endian unsigned 16-bit ids; each document ends with the separator id, and no index says
where. The files are read in blocks of ``block_ids`` ids, each block by range and by itself. One pass gives for every
block its separators, the ids before the first and after the last of them. A prefix scan over those few numbers tells
what each block inherits: the documents ended before it, and the ids of the document that is under way. A second pass
gives a row for each document where its separator stands.

A text may hold the string of the separator, whose id is then one of its own ids. Inside texts that id is written as
``ESCAPED_ID``, which no text has: it counts like any other and never ends a document.

The separator belongs to no document's length. Ids after the last separator of a file are a document without an end:
a row with ``ended`` false. An empty file gives no row. Files and blocks are spread over the tasks, so the size of one
file bounds nothing; the scan sorts one row per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablescope.llm.shared import as_text, join_path, new_folder, open_store, slices, written
from tablescope.llm.tokens import END_ID, word_ids

BLOCK_IDS = 2_000_000
ID = np.dtype("<u2")
#: Stands for ``END_ID`` inside a text; the vocabulary ends far below.
ESCAPED_ID = 65_535
FILES = "doc_id {key}, file string, ordinal bigint"


def write_flat(
    docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", vocabulary: str | None = None
) -> DataFrame:
    """Write the ids of all texts, one file for each partition; rows tell which document is the n-th of which file.

    A task that runs again writes a file of its own name; only the files of the rows kept by Spark are named. NULL
    texts are empty documents: a separator alone. Write the rows before using them twice.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = join_path(folder, f"ids-{context.partitionId():06d}-{context.taskAttemptId()}.bin")
        words, store, n, out = word_ids(vocabulary), None, 0, None
        for batch in slices(batches, "text"):
            if out is None:
                store, path = open_store(name)
                store.create_dir(path.rpartition("/")[0], recursive=True)
                out = store.open_output_stream(path)
            ids, bounds = words.of_texts(batch.column("text"))
            flat = np.insert(np.where(ids == END_ID, ESCAPED_ID, ids).astype(ID), bounds[1:], END_ID)
            out.write(flat.tobytes())
            order = np.arange(n, n + batch.num_rows)
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array([name] * batch.num_rows), pa.array(order)],
                names=["doc_id", "file", "ordinal"],
            )
        if out is not None:
            out.close()

    return docs.select(F.col(key).alias("key"), as_text(text).alias("text")).mapInArrow(run, FILES.format(key=kind))


def blocks_of(files: DataFrame, block_ids: int = BLOCK_IDS) -> DataFrame:
    """A row for each block of the named files, spread evenly."""
    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("file").to_pylist()
            found = []
            for name in names:
                store, path = open_store(name)
                found.append(store.get_file_info(path).size // ID.itemsize)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(found, pa.int64())], names=["file", "n_ids"])

    sized = files.select("file").distinct().mapInArrow(sizes, "file string, n_ids bigint").where("n_ids > 0")
    step = F.lit(block_ids)
    return sized.select(
        "file", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_ids") - 1) / step))).alias("block"), "n_ids"
    ).select("file", "block", F.least(step, F.col("n_ids") - F.col("block") * step).alias("n"))


def read_block(name: str, block: int, n: int, block_ids: int) -> np.ndarray:
    store, path = open_store(name)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read_at(n * ID.itemsize, block * block_ids * ID.itemsize), dtype=ID)


def document_lengths(files: DataFrame, separator: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Rows (file, ordinal, n_tokens, ended) of every document in the files named by ``files``."""
    blocks = written(blocks_of(files, block_ids), "blocks")

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for r in rows:
                at = np.flatnonzero(read_block(r["file"], r["block"], r["n"], block_ids) == separator)
                out.append((len(at), r["n"] - 1 - int(at[-1]) if len(at) else r["n"]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("file", "block", "n")), *(pa.array(c, pa.int64()) for c in zip(*out))],
                names=["file", "block", "n", "ends", "tail"],
            )

    found = written(
        spread(blocks).mapInArrow(summary, "file string, block bigint, n bigint, ends bigint, tail bigint"), "summary"
    )
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    # ids since the last separator: the tail of the last block with one, and all of the blocks after it
    n_before = F.coalesce(F.sum("n").over(before), F.lit(0))
    resets = F.max(F.when(F.col("ends") > 0, F.struct("block", F.col("until"), "tail"))).over(before)
    upto = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, 0)
    carried = (
        found.withColumn("until", F.sum("n").over(upto))
        .withColumn("n_before", n_before)
        .withColumn("reset", resets)
        .select(
            "file", "block", "n",
            F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("first"),
            F.coalesce(F.col("n_before") - F.col("reset.until") + F.col("reset.tail"), F.col("n_before")).alias("carry"),
            (F.lead("block").over(W.partitionBy("file").orderBy("block")).isNull()).alias("last"),
        )
    )

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                at = np.flatnonzero(read_block(r["file"], r["block"], r["n"], block_ids) == separator)
                sizes = np.diff(at, prepend=-1) - 1
                if len(at):
                    sizes[0] += r["carry"]
                tail = r["n"] - 1 - int(at[-1]) if len(at) else r["n"] + r["carry"]
                ended = np.ones(len(at), dtype=bool)
                if r["last"] and tail:
                    sizes, ended = np.append(sizes, tail), np.append(ended, False)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["file"]] * len(sizes), pa.string()),
                        pa.array(r["first"] + np.arange(len(sizes))),
                        pa.array(sizes.astype(np.int64)),
                        pa.array(ended),
                    ],
                    names=["file", "ordinal", "n_tokens", "ended"],
                )

    schema = "file string, ordinal bigint, n_tokens bigint, ended boolean"
    return spread(written(carried, "carried")).mapInArrow(lengths, schema)


def spread(blocks: DataFrame) -> DataFrame:
    """Blocks dealt over the tasks by their place, whichever file they belong to."""
    n = max(1, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return blocks.repartition(n, "file", "block")


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Rows (doc_id, n_tokens): the texts written to flat files in the shared folder, and counted from them."""
    spark = docs.sparkSession
    files = written(write_flat(docs, new_folder(spark, "flat"), key, text, vocabulary), "flat-files")
    found = document_lengths(files)
    # the files compress so well that Spark would take them for a small table
    return files.join(found.hint("merge"), ["file", "ordinal"], "left").select("doc_id", "n_tokens")
