"""WARC archives: one gzip member per record, written in parallel and read back in byte ranges.

Writer: payloads of at least ``MIN_SHARED`` bytes that equal an earlier page's become revisit records of the page with
the smallest identifier. Each task writes one archive under a temporary name and then moves it to its own, so a task
that runs again replaces its file. Files go through ``pyarrow.fs``, which reaches local, HDFS and object stores.

Reader: archives are cut into byte ranges. A task looks for the gzip magic in its range, takes a candidate for a member
only if it decodes to a WARC header, and owns the records that start inside its range, to their ends beyond it. Bytes
that don't decode are passed over. (An archive that holds another one as a stored, uncompressed payload could show
its inner records at the start of a range; text payloads can't.)

Defined results: a null payload is empty. Pages that share the smallest identifier are all responses. A null
identifier revisits any page with one; pages without one are responses among themselves. A null address is empty, and
line ends in addresses are percent-encoded. An empty table writes no archive and reads as no records.
"""

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankarena.sources.scratch import written

MIN_SHARED = 100
#: Bytes of an archive that one task looks after.
RANGE_BYTES = 8 << 20
_BLOCK = 1 << 18
_MAGIC = b"\x1f\x8b\x08"
_DATE = "2024-01-01T00:00:00Z"
_MANIFEST = "file string, size bigint, records bigint"
_RECORDS = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, "
    "file string, offset bigint, payload binary"
)


def with_revisits(pages: DataFrame, *, id_col: str = "page_id", text_col: str = "html") -> DataFrame:
    """``id, url, payload, digest, bytes, refers_to``; ``refers_to`` is null for responses."""
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.col("url").cast("string").alias("url") if "url" in pages.columns else F.lit("").alias("url"),
        F.encode(F.coalesce(text_col, F.lit("")), "UTF-8").alias("payload"),
    ).select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("bigint").alias("bytes"))
    # Counted from narrow rows; only payloads that occur again meet the pages.
    firsts = (
        rows.where(F.col("bytes") >= MIN_SHARED)
        .groupBy("digest")
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND first IS NOT NULL")
        .drop("n")
    )
    refers = F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(firsts, "digest", "left").withColumn("refers_to", refers).drop("first")


def record_bytes(page: Any, url: str | None, payload: bytes, digest: str, size: int, refers_to: Any) -> bytes:
    """One record, compressed as a gzip member of its own."""
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines[2:2] = [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
        ]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    record = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return packer.compress(record) + packer.flush()


def write_archives(pages: DataFrame, path: str) -> DataFrame:
    """Write rows of ``with_revisits`` under ``path``; gives the manifest (file, size, records)."""
    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        name = f"part-{TaskContext.get().partitionId():05d}.warc.gz"
        temporary, count, out = f"{root}/.{name}.{uuid.uuid4().hex}", 0, None
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("id", "url", "payload", "digest", "bytes", "refers_to")), strict=True):
                if out is None:
                    out = store.open_output_stream(temporary)
                out.write(record_bytes(*(v.as_py() for v in row)))
                count += 1
        if out is not None:
            size = out.tell()
            out.close()
            store.move(temporary, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict(
                {"file": [name], "size": pa.array([size], pa.int64()), "records": pa.array([count], pa.int64())}
            )

    return written(pages.select("id", "url", "payload", "digest", "bytes", "refers_to").mapInArrow(write, _MANIFEST), "manifest")


def member(file: Any, at: int) -> tuple[bytes, int] | None:
    """The decoded gzip member that starts at ``at`` if it is a WARC record, and where it ends."""
    file.seek(at)
    unpacker, parts, taken = zlib.decompressobj(31), [], 0
    while not unpacker.eof:
        block = file.read(_BLOCK)
        if not block:
            return None
        taken += len(block)
        try:
            parts.append(unpacker.decompress(block))
        except zlib.error:
            return None
        if parts[0] and not parts[0].startswith(b"WARC/1."[: len(parts[0])]):
            return None
    record = b"".join(parts)
    return (record, at + taken - len(unpacker.unused_data)) if record.startswith(b"WARC/1.") else None


def next_magic(file: Any, at: int, end: int) -> int | None:
    """The first place in [at, end) where a gzip header may start."""
    while at < end:
        file.seek(at)
        block = file.read(min(_BLOCK, end - at) + len(_MAGIC) - 1)
        found = block.find(_MAGIC)
        if found >= 0:
            return at + found if at + found < end else None
        at += _BLOCK
    return None


def records_from(file: Any, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of the records that start in [start, end)."""
    at = next_magic(file, start, end)
    while at is not None:
        found = member(file, at)
        if found:
            yield at, found[0]
        at = next_magic(file, found[1] if found else at + 1, end)


def parsed(record: bytes) -> dict[str, Any]:
    head, _, block = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")

    def page(name: str) -> int | None:
        found = re.search(r"<urn:page:(-?\d+)>", fields.get(name, ""))
        return int(found[1]) if found else None

    out = {"page_id": page("WARC-Record-ID"), "url": fields.get("WARC-Target-URI", ""), "record_type": fields["WARC-Type"],
           "refers_to": page("WARC-Refers-To")}
    if fields["WARC-Type"] == "revisit":
        length = re.search(rb"(?i)content-length: (\d+)", http)
        told = fields["WARC-Payload-Digest"].partition(":")[2]
        return out | {"payload_bytes": int(length[1]) if length else 0, "payload_digest": told, "payload": None}
    return out | {"payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest(), "payload": payload}


def read_archives(manifest: DataFrame, path: str, *, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of all archives that the manifest names, with file and offset; revisits have no payload of their own."""
    ranges = manifest.select(
        "file", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(range_bytes))).alias("start")
    )
    tasks = manifest.agg(F.sum(F.ceil(F.col("size") / range_bytes))).first()[0] or 1
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
         ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("file", pa.string()), ("offset", pa.int64()),
         ("payload", pa.binary())]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for row in batch.to_pylist():
                rows, held = [], 0
                with store.open_input_file(f"{root}/{row['file']}") as file:
                    end = min(row["start"] + range_bytes, row["size"])
                    for offset, record in records_from(file, row["start"], end):
                        rows.append(parsed(record) | {"file": row["file"], "offset": offset})
                        held += len(record)
                        if held >= _BLOCK:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    # As many tasks as ranges: so few rows would otherwise be put together again.
    return ranges.repartition(int(tasks)).mapInArrow(read, _RECORDS)
