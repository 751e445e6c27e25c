"""Exact duplicates by a content sort.

Rows are dealt into ranges of their normalised bytes, each range is sorted (spilling to disk as needed), and equal
texts then stand next to each other, where they are compared in full. The splitters are sampled from a bounded key, the
first bytes of the text, its hash and the identifier. So a text that a third of all rows share is cut into several
ranges; only the runs at the ends of a range, two at most, are put together afterwards.

Defined results: null counts as the empty text, and empty texts equal one another. Of equal texts the row with the
largest identifier stays; a null identifier is the smallest, and of rows that share the largest one, one stays. Columns
besides the identifier and the text are ignored. An empty table gives an empty result.
"""

import hashlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankarena.llm.batches import lean, pieces
from rankarena.sources.scratch import written

_HEAD_BYTES = 32
_OUT_ROWS = 20_000
_RUNS = "id bigint, digest binary, run_keep bigint, run_size bigint, at_end boolean, first boolean"
_RUNS_ARROW = pa.schema(
    [("id", pa.int64()), ("digest", pa.binary()), ("run_keep", pa.int64()), ("run_size", pa.int64()),
     ("at_end", pa.bool_()), ("first", pa.bool_())]
)


def _lower_ascii(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            text = pc.ascii_lower(pc.fill_null(piece.column("text"), "")).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([piece.column("id"), text], ["id", "body"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each row's bytes with those of the row before; a run ends where they differ."""
    out: list[tuple[Any, ...]] = []
    before: bytes | None = None
    ids: list[int | None] = []
    at_end = True

    def finished() -> Iterator[tuple[Any, ...]]:
        digest = hashlib.sha256(before or b"").digest()
        for k, i in enumerate(ids):
            yield i, digest, ids[0], len(ids), at_end, k == 0

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _RUNS_ARROW, strict=True)], schema=_RUNS_ARROW
        )

    for batch in batches:
        for i, body in zip(batch.column("id").to_pylist(), batch.column("body"), strict=True):
            now = body.as_py()
            if ids and now != before:
                for row in finished():
                    out.append(row)
                    if len(out) >= _OUT_ROWS:
                        yield packed()
                        out.clear()
                ids.clear()
                at_end = False
            before = now
            ids.append(i)
    if ids:
        at_end = True
        for row in finished():
            out.append(row)
            if len(out) >= _OUT_ROWS:
                yield packed()
                out.clear()
    if out:
        yield packed()


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the identifier, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    bodies = rows.mapInArrow(lean(_lower_ascii), "id bigint, body binary")
    keyed = bodies.withColumn("head", F.substring("body", 1, _HEAD_BYTES)).withColumn("hash", F.xxhash64("body"))
    last_first = F.col("id").desc_nulls_last()
    runs = (
        keyed.repartitionByRange("head", "hash", last_first)
        .sortWithinPartitions("head", "hash", "body", last_first)
        .select("id", "body")
        .mapInArrow(lean(_neighbours), _RUNS)
    )
    runs = written(runs, "exact-runs")
    # Two runs per range at most: a bound that comes from the number of partitions, not from the rows.
    ends = (
        runs.where("at_end AND first")
        .groupBy("digest")
        .agg(F.max("run_keep").alias("all_keep"), F.sum("run_size").alias("all_size"))
        .withColumn("at_end", F.lit(True))
    )
    whole = runs.join(F.broadcast(ends), ["digest", "at_end"], "left")
    keep = F.when(F.col("all_size").isNull(), F.col("run_keep")).otherwise(F.col("all_keep"))
    return whole.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("all_size", "run_size").alias("group_size"),
        (F.col("first") & F.col("run_keep").eqNullSafe(keep)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each text. Rows with an identifier of their own move nowhere."""
    flags = written(exact_duplicates(docs, id_col=id_col, text_col=text_col), "flags")
    by_id = flags.groupBy(F.col(id_col).alias("_id")).agg(F.count(F.lit(1)).alias("_n"), F.max("kept").alias("_kept"))
    by_id = written(by_id.where("_n > 1 OR NOT _kept"), "by-id")
    same = docs[id_col].cast("bigint").eqNullSafe(F.col("_id"))
    single = docs.join(by_id.select("_id"), same, "left_anti")
    # Rows that share an identifier are told apart by their texts.
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    digest = F.sha2(F.translate(F.coalesce(text_col, F.lit("")), upper, lower), 256)
    shared = docs.join(by_id.where("_n > 1").select("_id"), same, "left_semi").withColumn("_digest", digest)
    stay = flags.where("kept").select(F.col(id_col).alias("_stays"), "text_sha256")
    shared = shared.join(stay, shared[id_col].cast("bigint").eqNullSafe(F.col("_stays")) & (F.col("_digest") == F.col("text_sha256")), "left_semi")
    return single.unionByName(shared.dropDuplicates([id_col, "_digest"]).drop("_digest"))
