"""Web archives of pages, and a two-level index that finds their records again.

Archives. Each task writes its pages as WARC records, every record a gzip member of its own, into files of about
``ARCHIVE_BYTES``. Of pages with equal payloads of at least ``LEAST_BYTES`` bytes the one with the smallest id is a
response, the others are revisits that name it and carry no payload.

Index. Lines (reversed-host key, page id, archive, offset, length) are sorted by key over all tasks. Each index file
holds compressed blocks of ``BLOCK_LINES`` sorted lines, then a directory with each block's first key, offset and length,
then the directory's own place. Looking up keys: the first and last keys of the files (one row per file) route a key
to its file; a binary search of the file's directory names the block, which is read by range; a binary search in the
block gives the lines; the records are read by range from the archives, in order of their offsets.

A key with very many captures spreads over several files, because lines are dealt by (key, page id). Files written by a
task that runs again have names of their own, and only those that Spark kept rows of are ever read.

NULL pages have an empty payload, NULL urls the empty key; pages without an id are responses unless an equal payload has
an id. Rows repeated with the smallest id are each a response. An empty table gives no archive and no row.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.shared import as_text, join_path, new_folder, open_store, slices, written

LEAST_BYTES = 100
ARCHIVE_BYTES = 64_000_000
BLOCK_LINES = 300
FILE_LINES = 100_000
SMALL_TABLE = 200_000
DATE = "2026-01-01T00:00:00Z"
RECORDS = "page_id bigint, key string, file string, offset bigint, length bigint"


def reversed_host(url: str | None) -> str:
    """Sort key of a URL: host parts from the right, then path and query; scheme, port 80/443 and fragment go."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return url.strip()
    if not host:
        return url.strip()
    name = host if ":" in host or host.replace(".", "").isdigit() else ",".join(reversed(host.split(".")))
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{name}{f':{port}' if port not in (None, 80, 443) else ''}){rest}"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    number = "" if page_id is None else str(page_id)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{number}>",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + " ".join((url or "").split()),
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += [
            f"WARC-Refers-To: <urn:page:{refers_to}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 4, mtime=0)


def parse(member: bytes) -> dict:
    """The fields of a record and its payload; a response whose digest does not fit raises ValueError."""
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(": "), "") for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    sizes = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
    return {
        "page_id": number(fields["WARC-Record-ID"]), "payload_bytes": int(sizes["Content-Length"]),
        "payload_digest": digest, "record_type": kind,
        "refers_to": number(fields["WARC-Refers-To"]) if kind == "revisit" else None,
        "url": fields["WARC-Target-URI"], "payload": payload,
    }


class Output:
    """A file that a task writes from front to back."""

    def __init__(self, folder: str, label: str, number: int):
        context = TaskContext.get()
        self.name = join_path(folder, f"{label}-{context.partitionId():06d}-{context.taskAttemptId()}-{number:04d}")
        store, path = open_store(self.name)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.stream, self.size = store.open_output_stream(path), 0

    def write(self, data: bytes) -> int:
        """Where the data begins."""
        self.stream.write(data)
        self.size += len(data)
        return self.size - len(data)


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Archive all pages; rows (page_id, key, file, offset, length) are a table in the shared folder."""
    rows = pages.select(
        F.col(key).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), as_text(html).alias("html")
    ).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    large = F.octet_length("html") >= LEAST_BYTES
    same = rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    same = written(same.where("n > 1 AND first_id IS NOT NULL").select("digest", "first_id"), "equal-payloads")
    if same.count() <= SMALL_TABLE:
        same = F.broadcast(same)
    # payloads below the bound have no row here, since equal digests mean equal sizes
    marked = rows.join(same, "digest", "left").withColumn(
        "refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, number = None, 0
        for batch in slices(batches, "html"):
            found = []
            for r in batch.to_pylist():
                if out is None or out.size >= ARCHIVE_BYTES:
                    if out:
                        out.stream.close()
                    out, number = Output(folder, "pages.warc.gz", number), number + 1
                data = record(r["page_id"], r["url"], r["html"].encode(), r["digest"], r["refers_to"])
                found.append((r["page_id"], reversed_host(r["url"]), out.name, out.write(data), len(data)))
            yield batch_of(found, RECORDS)
        if out:
            out.stream.close()

    chosen = marked.select("page_id", "url", "html", "digest", "refers_to")
    return written(chosen.mapInArrow(run, RECORDS), "records")


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields]
    )


def pack_block(lines: list[tuple]) -> bytes:
    return zlib.compress(json.dumps(lines, ensure_ascii=False, separators=(",", ":")).encode(), 6)


def unpack_block(data: bytes) -> list[list]:
    return json.loads(zlib.decompress(data))


_FOOTER = "<QQ"
_FILES = "index_file string, first_key string, last_key string, n_lines bigint"


def build_index(records: DataFrame, folder: str) -> DataFrame:
    """Write the index files; rows (index_file, first_key, last_key, n_lines), one for each, are the upper level."""
    files = max(1, -(-records.count() // FILE_LINES))
    # with the place as a second column, captures of one key can lie in several files
    ordered = records.repartitionByRange(files, "key", "file", "offset").sortWithinPartitions("key", "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, directory, lines = None, [], []
        first = last = None
        total = 0

        def close_block() -> None:
            data = pack_block(lines)
            directory.append((lines[0][0], out.write(data), len(data)))

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "file", "offset", "length"))):
                if out is None:
                    out, first = Output(folder, "captures.idx", 0), r[0]
                lines.append(r)
                last, total = r[0], total + 1
                if len(lines) == BLOCK_LINES:
                    close_block()
                    lines = []
        if out is not None:
            if lines:
                close_block()
            data = pack_block(directory)
            out.write(struct.pack(_FOOTER, out.write(data), len(data)))
            out.stream.close()
            yield batch_of([(out.name, first, last, total)], _FILES)

    return written(ordered.select("key", "page_id", "file", "offset", "length").mapInArrow(run, _FILES), "index-files")


class IndexFile:
    """Binary search in one index file; only the footer, the directory and the blocks asked for are read."""

    def __init__(self, name: str):
        store, path = open_store(name)
        self.file = store.open_input_file(path)
        at, size = struct.unpack(_FOOTER, self.file.read_at(16, self.file.size() - 16))
        self.directory = unpack_block(self.file.read_at(size, at))
        self.keys = [d[0] for d in self.directory]
        self.block_at, self.block = -1, []

    def lines(self, block: int) -> list[list]:
        if block != self.block_at:  # keys are asked for in order, so a block is read once
            _, at, size = self.directory[block]
            self.block_at, self.block = block, unpack_block(self.file.read_at(size, at))
        return self.block

    def find(self, key: str) -> Iterator[list]:
        """Lines of a key; they may begin in the block before the first one that starts with the key."""
        block = max(0, bisect.bisect_left(self.keys, key) - 1)
        while block < len(self.keys) and self.keys[block] <= key:
            lines = self.lines(block)
            at = bisect.bisect_left(lines, key, key=lambda x: x[0])
            while at < len(lines) and lines[at][0] == key:
                yield lines[at]
                at += 1
            block += 1


def look_up(index_files: DataFrame, keys: DataFrame) -> DataFrame:
    """Captures of all ``keys.key``: rows (key, page_id, file, offset, length); keys without one give none."""
    upper = sorted((r.first_key, r.last_key, r.index_file) for r in index_files.collect())
    firsts = [u[0] for u in upper]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key in batch.column("key").to_pylist():
                at = bisect.bisect_right(firsts, key) - 1
                while at >= 0 and upper[at][1] >= key:
                    out.append((upper[at][2], key))
                    at -= 1
            yield batch_of(out, "index_file string, key string")

    schema = "key string, page_id bigint, file string, offset bigint, length bigint"

    def search(table: pa.Table) -> pa.Table:
        batches, out = [], []
        index = IndexFile(table.column("index_file")[0].as_py())
        for key in sorted(table.column("key").to_pylist()):
            for line in index.find(key):
                out.append(tuple(line))
                if len(out) == 20_000:
                    batches.append(batch_of(out, schema))
                    out = []
        index.file.close()
        return pa.Table.from_batches([*batches, batch_of(out, schema)])

    routed = keys.select("key").where("key IS NOT NULL").distinct().mapInArrow(route, "index_file string, key string")
    return routed.groupBy("index_file").applyInArrow(search, schema)


_PAGES = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read_records(captures: DataFrame) -> DataFrame:
    """Read the records at the captures' places by range; one row of fields for each."""
    names = [x.split()[0] for x in _PAGES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = file = None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["file"] != name:
                    if file:
                        file.close()
                    store, path = open_store(r["file"])
                    name, file = r["file"], store.open_input_file(path)
                found = parse(file.read_at(r["length"], r["offset"]))
                out.append(tuple(found[n] for n in names))
            yield batch_of(out, _PAGES)
        if file:
            file.close()

    # neighbours in an archive are read together; the cell keeps one archive from being one task
    cell = F.floor(F.col("offset") / F.lit(8_000_000))
    n = max(1, int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    near = captures.select("file", "offset", "length").repartition(n, "file", cell)
    return near.sortWithinPartitions("file", "offset").mapInArrow(run, _PAGES)


def archive_and_read_back(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Archive the pages, index the archives, find every page's key in the index and read its records."""
    folder = new_folder(pages.sparkSession, "archives")
    records = write_archives(pages, folder, key, url, html)
    index = build_index(records, folder)
    return read_records(look_up(index, records.select("key")))
