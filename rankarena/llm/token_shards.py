"""Token ids in training order: fixed-stride binary shards that are read sequentially and resumed anywhere.

Texts are tokenized once and packed, task by task, into sequences of ``length`` ids, with a separator after each text; the
last sequence of a task is filled up with separators. They are written as they are, compressed across neighbours; on their
way to their slots each is compressed by itself, with a dictionary from a bounded sample of them. Sequences are numbered through all tasks, and a keyed Feistel
permutation of those numbers (walking cycles until a number falls inside the range) gives each its slot, so the order is
known without a sort of random keys, for any number of sequences. Rows are dealt into ranges of slots and sorted, and
each shard of ``per_shard`` slots is a file of unsigned 16-bit ids in which slot s starts at a multiple of the stride.

Defined results: a null or empty text is its separator alone; an empty table gives no sequences and no files. Files
are written under a temporary name and moved, so a task that runs again replaces its files. Ids must be under 65,536.
"""

import base64
import hashlib
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankarena.llm.bpe import SPLIT
from rankarena.sources.scratch import scratch_path, written

LENGTH = 1024
PER_SHARD = 4096
KEY = 20240229
ROUNDS = 6
#: Sequences that the dictionary for shuffled ones is made from, and its bytes. They change sizes, never results.
SAMPLED, DICTIONARY_BYTES = 2000, 112_640
LEVEL = 6
SEPARATOR = 50256
#: Shards that a task writes, one after another.
SHARDS_PER_TASK = 4


def encoder(file: str) -> tiktoken.Encoding:
    lines = Path(file).read_bytes().splitlines()
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def slots_of(numbers: np.ndarray, total: int, key: int = KEY) -> np.ndarray:
    """A permutation of 0 … total-1."""
    half = np.uint64(max(1, -(-max(total - 1, 1).bit_length() // 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = np.random.default_rng(key).integers(1, 1 << 63, ROUNDS, dtype=np.uint64)
    out = numbers.astype(np.uint64)
    walking = np.ones(len(out), bool)
    while walking.any():
        left, right = out[walking] >> half, out[walking] & mask
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        out[walking] = left << half | right
        walking[walking] = out[walking] >= total
    return out.astype(np.int64)


def sequences(docs: DataFrame, *, file: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(part, k, doc_ids, n_tokens, body): packed sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        encode = encoder(file).encode_ordinary
        held: list[int] = []
        owners: list[tuple[int, int | None]] = []  # how many of the held ids come before a text, and its identifier

        def cut(last: bool) -> Iterator[dict]:
            nonlocal k, held, owners
            start, ends = 0, [*(at for at, _ in owners[1:]), len(held)]
            # A text has a separator at least, so each owner has ids, and without ids there is no owner.
            texts = list(zip(owners, ends, strict=True)) if held else []
            while len(held) - start >= length or (last and start < len(held)):
                ids, stop = held[start : start + length], start + length
                inside = [i for (at, i), end in texts if at < stop and end > start]
                body = np.full(length, SEPARATOR, "<u2")
                body[: len(ids)] = ids
                yield {"part": part, "k": k, "doc_ids": inside, "n_tokens": len(ids), "body": body.tobytes()}
                k, start = k + 1, stop
            owners = [(max(at - start, 0), i) for (at, i), end in texts if end > start]
            held = held[start:]

        schema = pa.schema([("part", pa.int64()), ("k", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("body", pa.binary())])
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                some = batch.slice(start, 64)
                for i, text in zip(some.column("id").to_pylist(), some.column("text").to_pylist(), strict=True):
                    owners.append((len(held), i))
                    held += encode(text or "")
                    held.append(SEPARATOR)
                rows = list(cut(False))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
        rows = list(cut(True))
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "part bigint, k bigint, doc_ids array<bigint>, n_tokens bigint, body binary")


def dictionary_of(packed: DataFrame) -> bytes:
    """A compression dictionary; empty if there are too few sequences for one."""
    samples = [bytes(row["body"]) for row in packed.select("body").limit(SAMPLED).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_shards(
    docs: DataFrame, path: str, *, file: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
    per_shard: int = PER_SHARD, key: int = KEY
) -> DataFrame:
    """Write the shards under ``path``; one row per sequence: slot, shard, offset, n_tokens, doc_ids and sha256."""
    spark = docs.sparkSession
    made = sequences(docs, file=file, id_col=id_col, text_col=text_col, length=length)
    place = scratch_path(spark, "sequences")
    made.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", LEVEL).parquet(place)
    packed = spark.read.schema(made.schema).parquet(place)
    # One row for each task that has packed.
    parts = packed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(parts.select("part", "n", before.alias("before")), "starts")
    total = starts.agg(F.sum("n")).first()[0] or 0

    trained = dictionary_of(packed)

    def shared() -> zstandard.ZstdCompressionDict | None:
        return zstandard.ZstdCompressionDict(trained) if trained else None

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared()).compress
        for batch in batches:
            slots = pa.array(slots_of(batch.column("number").to_numpy(), total, key))
            bodies = pa.array([pack(body.as_buffer()) for body in batch.column("body")], pa.binary())
            yield pa.RecordBatch.from_arrays([slots, batch.column("n_tokens"), batch.column("doc_ids"), bodies], ["slot", "n_tokens", "doc_ids", "body"])

    placed = packed.join(F.broadcast(starts), "part").select((F.col("before") + F.col("k")).alias("number"), "n_tokens", "doc_ids", "body")
    numbered = placed.mapInArrow(number, "slot bigint, n_tokens bigint, doc_ids array<bigint>, body binary")
    ranged = numbered.withColumn("shard", F.expr(f"slot div {per_shard}")).select("slot", "shard", "n_tokens", "doc_ids", "body")
    # The permutation spreads sequences evenly, so equal ranges of slots are equal work; nothing has to be sampled.
    tasks = -(-(1 + total // per_shard) // SHARDS_PER_TASK)
    sorted_rows = ranged.repartitionById(tasks, F.expr(f"CAST(shard div {SHARDS_PER_TASK} AS INT)")).sortWithinPartitions("slot")
    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)
    stride = 2 * length

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        unpack = zstandard.ZstdDecompressor(dict_data=shared()).decompress
        shard, out, temporary = None, None, ""

        def close() -> None:
            if out is not None:
                out.close()
                store.move(temporary, f"{root}/shard-{shard:08d}.bin")

        for batch in batches:
            digests, offsets = [], []
            for row_shard, row_slot, body in zip(*(batch.column(c) for c in ("shard", "slot", "body")), strict=True):
                if row_shard.as_py() != shard:
                    close()
                    shard = row_shard.as_py()
                    temporary = f"{root}/.shard-{shard:08d}.{uuid.uuid4().hex}"
                    out = store.open_output_stream(temporary)
                data = unpack(body.as_py())
                out.write(data)
                digests.append(hashlib.sha256(data).hexdigest())
                offsets.append(row_slot.as_py() % per_shard * stride)
            columns = [batch.column("slot"), batch.column("shard"), pa.array(offsets, pa.int64()), batch.column("n_tokens"), batch.column("doc_ids"), pa.array(digests)]
            yield pa.RecordBatch.from_arrays(columns, ["slot", "shard", "offset", "n_tokens", "doc_ids", "sha256"])
        close()

    schema = "slot bigint, shard bigint, offset bigint, n_tokens bigint, doc_ids array<bigint>, sha256 string"
    return written(sorted_rows.mapInArrow(write, schema), "slots")


def read_slots(path: str, start: int, count: int, *, length: int = LENGTH, per_shard: int = PER_SHARD) -> Iterator[np.ndarray]:
    """The ids of ``count`` slots from ``start`` on, in training order."""
    store, root = fs.FileSystem.from_uri(path)
    while count > 0:
        shard, place = divmod(start, per_shard)
        some = min(count, per_shard - place)
        with store.open_input_file(f"{root}/shard-{shard:08d}.bin") as file:
            file.seek(place * 2 * length)
            for _ in range(some):
                yield np.frombuffer(file.read(2 * length), "<u2")
        start, count = start + some, count - some
