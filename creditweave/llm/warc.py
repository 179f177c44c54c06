"""WARC archives: a writer of gzip members, one per record, and a splittable reader.

Writer. Rows are compared by their payload's SHA-1 and length. Of those that are equal and have
at least `least_bytes`, the one with the smallest id is written as a response, the others as
revisits without payload. Each task writes one file under a name of its own attempt; only the
names in the stored manifest count, so a lost or repeated task leaves no trace in the archive.

Reader. Files are cut into byte ranges, and ranges are dealt out to tasks. A task scans its
range for the magic of a gzip member, takes a candidate as a record if its header decodes,
starts with a WARC version line and has the mandatory fields, if the whole member decodes with
the right check sum, and if it is followed by another member or the end of the file. A header may be of any
length: what begins with the version line is read on until it ends. A record belongs to the range it starts in, and is read
beyond the range's end where it has to be. Memory is in proportion to a range and a record. `verified` compares
what was read with the manifest and with the stated digests, and raises where a record is lost or damaged.

A null payload is empty. Rows without id are responses unless an equal row has an id. Rows that
repeat the smallest id are all responses. An empty table gives an empty archive. Extra columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditweave.sources.workspace import new_path, store

MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES = 8 << 20
# A record that is not closed within so many compressed bytes is read further in such steps.
STEP_BYTES = 1 << 20
HEADER_BYTES = 1 << 16
MANDATORY = ("WARC-Record-ID", "WARC-Date", "WARC-Type", "Content-Length")
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def _file_system(path: str):
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:"):
            return fs.LocalFileSystem(), urlsplit(path).path
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(text: str | None) -> str:
    """A header value stays on one line."""
    return "".join(" " if c in "\r\n" else c for c in text or "")


def record(page: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool) -> bytes:
    """One record as a gzip member."""
    block = HTTP_HEAD + (b"" if revisit else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Target-URI: {_line(url)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head.append(f"WARC-Refers-To: <urn:page:{first}>")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _file_system(folder)
        path, sink, size, count = f"{root}/{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if sink is None:
                    sink = system.open_output_stream(path, compression=None)
                payload = (row["payload"] or "").encode()
                member = record(row["page"], row["url"], payload, row["first"], row["revisit"])
                sink.write(member)
                size, count = size + len(member), count + 1
        if sink is not None:
            sink.close()
            names = [path.rsplit("/", 1)[1]]
            yield pa.RecordBatch.from_pydict({"file": names, "bytes": [size], "records": [count]})

    return write


def write_archive(
    pages: DataFrame,
    folder: str | None = None,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least_bytes: int = 0,
) -> DataFrame:
    """Write the rows as WARC files below `folder`; return the manifest: path, bytes, records."""
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    system, root = _file_system(folder)
    system.create_dir(root, recursive=True)
    rows = pages.select(
        F.col(key).cast("long").alias("page"), F.col(url).alias("url"), F.col(payload).alias("payload")
    )
    text = F.coalesce("payload", F.lit(""))
    rows = rows.withColumns(
        {"sha": F.unhex(F.sha1(text)), "length": F.octet_length(text)}
    )
    large = F.col("length") >= least_bytes
    equal = (
        rows.filter(large)
        .groupBy("sha", "length")
        .agg(F.min("page").alias("first"), F.count("*").alias("n"))
        .filter((F.col("n") > 1) & F.col("first").isNotNull())
        .select("sha", "length", "first")
    )
    equal = store(equal, "warc-equal").frame
    marked = rows.join(equal, ["sha", "length"], "left").select(
        "page", "url", "payload", "first",
        (F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))).alias("revisit"),
    )
    written = marked.mapInArrow(_writer(folder), "file string, bytes bigint, records bigint")
    manifest = store(written, "warc-manifest").frame
    return manifest.withColumn("path", F.concat(F.lit(folder + "/"), "file"))


class _Window:
    """Bytes of a file, read on as they are asked for and dropped once passed."""

    def __init__(self, source, start: int, size: int):
        self.source, self.start, self.size = source, start, size
        self.data = bytearray()

    def upto(self, end: int) -> None:
        end = min(end, self.size)
        held = self.start + len(self.data)
        if end > held:
            self.source.seek(held)
            self.data += self.source.read(end - held)

    def bytes(self, start: int, end: int) -> bytes:
        self.upto(end)
        return bytes(self.data[start - self.start : end - self.start])

    def find(self, start: int, end: int) -> int:
        """The first magic that starts in [start, end), or -1."""
        while start < end:
            stop = min(end + len(MAGIC) - 1, start + STEP_BYTES)
            self.upto(stop)
            place = self.data.find(MAGIC, start - self.start, stop - self.start)
            if place >= 0:
                return self.start + place
            start = stop - len(MAGIC) + 1 if stop < end + len(MAGIC) - 1 else end
        return -1

    def forget(self, before: int) -> None:
        if before - self.start > STEP_BYTES:
            del self.data[: before - self.start]
            self.start = before


def _header(data: bytes) -> dict[str, str] | None:
    """The named fields of a record that begins here; None if none does."""
    if not data.startswith(b"WARC/1."):
        return None
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = data[:end].decode("utf-8", "replace").split("\r\n")[1:]
    if any(":" not in line for line in lines):
        return None
    fields = {name.strip(): value.strip() for name, value in (line.split(":", 1) for line in lines)}
    if not all(name in fields for name in MANDATORY) or not fields["Content-Length"].isdigit():
        return None
    fields[""] = str(end + 4)
    return fields


def _member(window: _Window, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """Header fields, block and end of the record whose member starts at `at`, if there is one."""
    flags = window.bytes(at + 3, at + 4)
    if not flags or flags[0] & 0xE0:
        return None
    unpack, place, parts, fields, held = zlib.decompressobj(31), at, [], None, 0
    while not unpack.eof:
        step = max(HEADER_BYTES, held) if fields is None else STEP_BYTES
        compressed = window.bytes(place, place + step)
        if not compressed:
            return None
        try:
            parts.append(unpack.decompress(compressed))
        except zlib.error:
            return None
        place += len(compressed)
        held += len(parts[-1])
        if fields is None:
            start = b"".join(parts)
            fields = _header(start)
            if fields is None and (unpack.eof or b"\r\n\r\n" in start or not b"WARC/1.".startswith(start[:7])):
                return None
    end = place - len(unpack.unused_data)
    after = window.bytes(end, end + len(MAGIC))
    content = b"".join(parts)
    first = int(fields[""]) if fields else 0
    last = first + int(fields["Content-Length"]) if fields else 0
    if not fields or (after and after != MAGIC) or last > len(content):
        return None
    return fields, content[first:last], end


def read_range(path: str, size: int, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records that start in [start, end) of a file of `size` bytes."""
    system, name = _file_system(path)
    with system.open_input_file(name) as source:
        window = _Window(source, start, size)
        at = start
        while (at := window.find(at, end)) >= 0:
            found = _member(window, at)
            if found is None:
                at += 1
                continue
            yield found[0], found[1]
            at = found[2]
            window.forget(at)
            if at >= end:
                return


def _page(text: str | None) -> int | None:
    number = (text or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


_TYPES = (
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("intact", pa.bool_()),
)
_SCHEMA = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, "
    "payload_bytes bigint, payload binary, intact boolean"
)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for task in batch.to_pylist():
            rows, held = [], 0
            for fields, block in read_range(task["path"], task["bytes"], task["start"], task["end"]):
                rows.append(_row(fields, block))
                held += len(block)
                if held > STEP_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _TYPES]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, (_, t) in zip(columns, _TYPES, strict=True)], names=[n for n, _ in _TYPES]
    )


def _row(fields: dict[str, str], block: bytes) -> tuple:
    """A response's payload is measured; a revisit has what its header says."""
    stated = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    kind = fields["WARC-Type"]
    page, url = _page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI")
    if kind != "response":
        length = fields.get("X-Payload-Length", "")
        return page, url, kind, _page(fields.get("WARC-Refers-To")), stated, int(length) if length.isdigit() else None, None, True
    payload = block.partition(b"\r\n\r\n")[2]
    found = digest(payload)
    return page, url, kind, None, found, len(payload), payload, found == stated


def read_archive(spark: SparkSession, manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All records of the files in the manifest (columns path and bytes), by byte ranges."""
    starts = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))
    ranges = (
        manifest.filter("bytes > 0")
        .select("path", "bytes", F.explode(starts).alias("start"))
        .withColumn("end", F.least(F.col("start") + range_bytes, F.col("bytes")))
    )
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return ranges.repartition(tasks, "path", "start").mapInArrow(_read, _SCHEMA)


class ArchiveError(ValueError):
    """Records are missing from an archive, or their payloads are not those that were written."""


def verified(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """The records read, stored, once their number is the manifest's and every payload has its stated digest."""
    kept = store(found, "warc-records")
    wanted = manifest.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    damaged = kept.frame.where(~F.coalesce(F.col("intact"), F.lit(False))).count()
    if kept.rows != wanted or damaged:
        raise ArchiveError(f"{kept.rows} records of {wanted} were read; {damaged} do not have their stated digest")
    return kept.frame
