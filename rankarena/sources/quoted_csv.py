"""A reader for CSV files with quoted line breaks that splits a file over many tasks.

Whether a line break ends a record depends on all quotes before it. So each byte range first counts its quotes; what comes
before a range, added up file by file, says whether it begins inside of quotes. Then each range finds the records that
start in it, and reads on behind its end to finish the last one. Ranges are fixed by file sizes alone, so both passes and
tasks that run again see the same ones.

A quote inside of quotes is doubled, as :func:`rankarena.sources.sinks.write_csv_table` does; a field that isn't quoted has
none. Files are listed by Spark and read by pyarrow, whose stores must know their addresses.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankarena.sources.scratch import written

RANGE_BYTES = 32 << 20
#: Tasks at most; beyond that a task has several ranges.
MAX_TASKS = 20_000
_CHUNK = 4 << 20
_BATCH_BYTES = 4 << 20
_QUOTE, _LINE_END = ord('"'), ord("\n")


def _opened(uri: str) -> pa.NativeFile:
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def _chunks(file: pa.NativeFile, start: int, stop: int) -> Iterator[bytes]:
    file.seek(start)
    while start < stop:
        data = file.read(min(_CHUNK, stop - start))
        if not data:
            return
        yield data
        start += len(data)


def file_ranges(spark: SparkSession, path: str | list[str], range_bytes: int) -> DataFrame:
    """(file, start, stop, size): the byte ranges of all files."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "length")
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(range_bytes).cast("bigint"))).alias("start")
    ranges = files.select(F.col("path").alias("file"), F.col("length").alias("size"), starts)
    return ranges.select("file", "start", F.least(F.col("start") + range_bytes, "size").alias("stop"), "size")


def _spread(ranges: DataFrame, count: int) -> DataFrame:
    """Ranges are few and small rows; each is work for a task of its own."""
    return ranges.repartition(max(1, min(count, MAX_TASKS)))


def with_quotes_before(ranges: DataFrame) -> DataFrame:
    """``ranges`` with ``inside``: whether the range begins inside of quotes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            quotes = []
            for r in batch.to_pylist():
                with _opened(r["file"]) as file:
                    quotes.append(sum(chunk.count(b'"') for chunk in _chunks(file, r["start"], r["stop"])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(quotes, pa.int64())], [*batch.schema.names, "quotes"])

    counted = written(ranges.mapInArrow(count, "file string, start bigint, stop bigint, size bigint, quotes bigint"), "csv-quotes")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).drop("quotes")


def records_from(file: pa.NativeFile, start: int, stop: int, size: int, inside: bool) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of each record that starts in a range, without its line break."""
    # The byte before the range decides whether a record starts with it.
    at, held, offset = start, b"", start
    if start:
        file.seek(start - 1)
        previous = file.read(1)
        skipping = not (previous == b"\n" and not inside)
    else:
        skipping = False
    state = int(inside)
    while at < size:
        data = next(_chunks(file, at, size), b"")
        if not data:
            break
        values = np.frombuffer(data, np.uint8)
        quotes = np.flatnonzero(values == _QUOTE)
        breaks = np.flatnonzero(values == _LINE_END)
        ends = breaks[(np.searchsorted(quotes, breaks) + state) % 2 == 0].tolist()
        state = (state + len(quotes)) % 2
        begin = 0
        for end in ends:
            if skipping:
                skipping = False
            else:
                yield offset, (held + data[begin:end]).removesuffix(b"\r")
            held, begin, offset = b"", end + 1, at + end + 1
            if offset >= stop:
                return
        if not skipping:
            held += data[begin:]
        at += len(data)
        if skipping and at >= stop:
            return
    if held:
        yield offset, held.removesuffix(b"\r")


def read_records(spark: SparkSession, path: str | list[str], *, header: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(value): the records of all files as text, with their line breaks inside; empty ones and headers are left out."""
    ranges = written(file_ranges(spark, path, range_bytes), "csv-ranges")
    count = ranges.count()
    known = written(with_quotes_before(_spread(ranges, count)), "csv-states")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                values, held = [], 0
                with _opened(r["file"]) as file:
                    for offset, record in records_from(file, r["start"], r["stop"], r["size"], r["inside"]):
                        if record and (offset or not header):
                            values.append(record)
                            held += len(record)
                        if held >= _BATCH_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary()).cast(pa.string())], ["value"])
                            values, held = [], 0
                if values:
                    yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary()).cast(pa.string())], ["value"])

    return _spread(known, count).mapInArrow(read, "value string")


def read_quoted_csv(
    spark: SparkSession, path: str | list[str], columns: T.StructType, *, header: bool = True, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """A CSV table whose texts may have line breaks and quotes: the rows of the whole-file reader, by many tasks a file.

    Columns are known by their order. A header is the first record of each file.
    """
    records = read_records(spark, path, header=header, range_bytes=range_bytes)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.fields)
    return records.select(F.from_csv("value", kinds, {"escape": '"', "multiLine": "true"}).alias("row")).select("row.*")
