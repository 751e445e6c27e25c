"""Epoch states as files of one field each: ``id_<query>_ep_<epoch>_<bot>_texts.json`` and ``…_rankings.json``.

Each file is one JSON map of authors, with an entry on each line. A task gets the rows of its fields in order and appends
entry by entry, so a field may be larger than a task's memory. Files are written under another name and moved when they are
whole; a task that runs again replaces them. Reading takes lines, not files, so a large file is split over tasks.
"""

import io
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankarena.functions.ids import canonical_query_id
from rankarena.sources.scratch import written

KINDS = {"texts": "text", "rankings": "rank"}
_FIELD = ["query_id", "epoch", "bot"]
#: Entries of a field that one task reads; the files of a larger one are cut by lines.
LARGE_ENTRIES = 100_000
_FIELDS_IN_TASK = 1000
_BATCH_CHARACTERS = 1 << 20
_MANIFEST = "query_id string, epoch int, bot string, entries bigint, texts_file string, rankings_file string"
_FILE = r"id_([^/]+)_ep_([0-9]+)_([^/_]+)_{kind}\.json$"


class _MapFile:
    """A map that grows by one entry a line."""

    def __init__(self, store: fs.FileSystem, root: str, name: str) -> None:
        self._store, self.name = store, name
        self._whole, self._part = f"{root}/{name}", f"{root}/.{name}.{uuid.uuid4().hex}"
        self._out = store.open_output_stream(self._part)
        self._before = "{\n"

    def add(self, key: str, value: object) -> None:
        self._out.write(f"{self._before}{json.dumps(key)}: {json.dumps(value)}".encode())
        self._before = ",\n"

    def close(self) -> None:
        self._out.write(b"\n}\n")
        self._out.close()
        self._store.move(self._part, self._whole)


def write_epoch_map_files(states: DataFrame, path: str) -> DataFrame:
    """Write two files for each field under ``path``; returns one row a field with its number of entries and its files.

    Of rows with the same author in a field the one with the best rank counts, a null rank last, then the smallest text.
    Names of queries and bots must not have a slash, nor bots an underscore.
    """
    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        files: list[_MapFile] = []
        field, author, entries = None, None, 0

        def close() -> Iterator[pa.RecordBatch]:
            if field is not None:
                for file in files:
                    file.close()
                row = [*field, entries, *(file.name for file in files)]
                names = [*_FIELD, "entries", "texts_file", "rankings_file"]
                types = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        for batch in batches:
            for row in batch.to_pylist():
                here = tuple(row[c] for c in _FIELD)
                if here != field:
                    yield from close()
                    query, epoch, bot = here
                    if "/" in query or "/" in bot or "_" in bot:
                        raise ValueError(f"{query!r} and {bot!r} can't be told by a file's name")
                    files = [_MapFile(store, root, f"id_{query}_ep_{epoch}_{bot}_{kind}.json") for kind in KINDS]
                    field, author, entries = here, None, 0
                if row["author_id"] == author:
                    continue
                author, entries = row["author_id"], entries + 1
                for file, column in zip(files, KINDS.values(), strict=True):
                    file.add(author, row[column])
        yield from close()

    rows = states.where("author_id IS NOT NULL").select(
        F.col("query_id").cast("string"), F.col("epoch").cast("int"), F.col("bot").cast("string"), "author_id", "text", F.col("rank").cast("int")
    )
    order = [*_FIELD, "author_id", F.asc_nulls_last("rank"), "text"]
    return written(rows.repartition(*_FIELD).sortWithinPartitions(*order).mapInArrow(run, _MANIFEST), "map-files")


def _entries(lines: DataFrame, kind: str, value_type: str) -> DataFrame:
    """(field, author_id, value) from files whose entries are on lines of their own, or all on one line."""
    pattern = _FILE.format(kind=kind)
    parts = [F.regexp_extract("file", pattern, i) for i in (1, 2, 3)]
    line = F.trim("value")
    body = F.when(line.startswith("{") & line.endswith("}"), line).when(
        ~line.isin("", "{", "}"), F.concat(F.lit("{"), F.regexp_replace(F.regexp_replace(line, r"^\{|\}$", ""), r",$", ""), F.lit("}"))
    )
    return lines.where(F.col("file").rlike(pattern)).select(
        canonical_query_id(parts[0]).alias("query_id"),
        parts[1].cast("int").alias("epoch"),
        parts[2].alias("bot"),
        F.explode(F.from_json(body, f"map<string,{value_type}>")).alias("author_id", KINDS[kind]),
    )


def _read_fields(fields: DataFrame, path: str, tasks: int) -> DataFrame:
    """The entries of ``fields``; both files of a field are read side by side, as they have the same authors in the same order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        rows: list[tuple] = []
        held = 0

        def lines(name: str) -> Iterator[str]:
            with store.open_input_stream(f"{root}/{name}") as stream:
                for line in io.TextIOWrapper(io.BufferedReader(stream), "utf-8", newline="\n"):
                    if line not in ("{\n", "}\n"):
                        yield line.rstrip("\n").removesuffix(",")

        def flush() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32()]
            columns = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, [*_FIELD, "author_id", "text", "rank"])

        for batch in batches:
            for field in batch.to_pylist():
                for told, ranked in zip(lines(field["texts_file"]), lines(field["rankings_file"]), strict=True):
                    ((author, text),) = json.loads(f"{{{told}}}").items()
                    (rank,) = json.loads(f"{{{ranked}}}").values()
                    rows.append((*(field[c] for c in _FIELD), author, text, rank))
                    held += len(told)
                    if held > _BATCH_CHARACTERS:
                        yield flush()
                        held = 0
        if rows:
            yield flush()

    entries = "query_id string, epoch int, bot string, author_id string, text string, rank int"
    return fields.repartition(tasks, *_FIELD).mapInArrow(run, entries).withColumn("query_id", canonical_query_id(F.col("query_id")))


def read_epoch_map_lines(
    spark: SparkSession, path: str | list[str], *, fields: DataFrame | None = None, large_entries: int = LARGE_ENTRIES
) -> DataFrame:
    """Epoch states from such files; a text without a rank has a null one, and the other way round.

    ``fields`` is what :func:`write_epoch_map_files` returned for ``path``. With it no folder is listed, and tasks read the
    files of many fields each; those of a field with more than ``large_entries`` entries are still cut by lines.
    """
    if fields is not None:
        large = F.col("entries") > large_entries
        tasks = max(spark.sparkContext.defaultParallelism, -(-fields.count() // _FIELDS_IN_TASK))
        made = _read_fields(fields.where(~large), path, tasks)
        names = [f"{path.rstrip('/')}/{name}" for r in fields.where(large).select("texts_file", "rankings_file").collect() for name in r]
        return made.unionByName(read_epoch_map_lines(spark, names)) if names else made
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"))
    keys = [*_FIELD, "author_id"]

    def value(column: str) -> Column:
        return F.col(column)

    joined = _entries(lines, "texts", "string").join(_entries(lines, "rankings", "int"), keys, "full")
    return joined.select(*keys, value("text"), value("rank"))
