"""SimHash near-duplicates: documents whose fingerprints differ in two bits at most, and the groups this makes.

1. A fingerprint has 64 bits; a bit is set if more than half of the document's shingle hashes set it. Equal fingerprints
   are one point from here on.
2. A point is mapped to the counts of set bits in its 16 segments of four bits. Two points that differ in two bits are
   at a Manhattan distance of two at most, so there is a cell of the grid of counts that is one step or none from both.
   Each point goes to its own cell and to those one step away, 33 at most. Points that meet in a cell are candidates:
   the distance bounds the number of differing bits from below only.
3. Candidates are verified by counting the bits that differ.
4. A cell with more than ``CELL_POINTS`` points isn't worked out. Its points go to the finest grid, whose segments are
   single bits: there a cell holds at most a point and those one bit away from it, 65 points that are all linked. So no
   group is unbounded, and no link is lost. Rows of a cell stream through a task; it never holds more than a cell's bound.
5. The components of the links are the result.

Defined results: letters A-Z are lower-cased; words are runs of bytes other than space and 09-0D. A text of fewer words
than a shingle has its whole sequence as one; one without words, or null, has the fingerprint zero and is linked like any
other. Rows with equal fingerprints are linked, also with the same identifier. A component's id is its smallest
identifier; null identifiers are passed over there. Other columns are left out, whatever their names.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankarena.llm.batches import lean, text_bytes
from rankarena.llm.components import components
from rankarena.sources.scratch import written

SHINGLE_WORDS = 3
#: Bits in which linked fingerprints may differ; the grids are made for this number.
DISTANCE = 2
#: Seed of the shingles' XXH64.
SEED = 42
#: Bits of a segment of the coarse grid.
SEGMENT_BITS = 4
#: Points of a cell that are compared with one another; more go to the finest grid.
CELL_POINTS = 32
#: Points that a task sends to their cells.
POINTS_PER_TASK = 1 << 15
#: Bytes of a text that are cut into words at a time, and shingles whose bits are counted at a time.
SLICE_BYTES = 4 << 20
_SHINGLES = 1 << 16

# Fixed value: what separates words.
_SPACE = regex.compile(rb"[\x20\x09-\x0D]")


def shingle_hashes(body: bytes, words: int = SHINGLE_WORDS, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of each shingle of a text, some at a time."""
    carried: list[bytes] = []
    at, seen = 0, 0
    while at < len(body):
        space = _SPACE.search(body, at + SLICE_BYTES)
        end = space.start() if space else len(body)
        # Without an argument, bytes are split at space and 09-0D; only A-Z are lower-cased.
        some = carried + body[at:end].lower().split()
        at = end
        count = len(some) - words + 1
        if count > 0:
            yield _hashed(some, words, count, seed)
            seen += count
            some = some[count:]
        carried = some
    if carried and not seen:
        yield _hashed(carried, len(carried), 1, seed)


def _hashed(some: list[bytes], words: int, count: int, seed: int) -> np.ndarray:
    joined = b" ".join(some)
    lengths = np.fromiter(map(len, some), np.int64, len(some))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:count].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)), np.uint64, count)


def fingerprint(body: bytes, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The fingerprint of a text as a signed number of 64 bits."""
    ones, total = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(body, words, seed):
        for start in range(0, len(hashes), _SHINGLES):
            some = hashes[start : start + _SHINGLES].astype(">u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(some, axis=1).sum(axis=0, dtype=np.uint32)
        total += len(hashes)
    return int(np.packbits(2 * ones > total).view(">i8")[0])


def fingerprint_table(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(fp, ids): the rows of each batch that have a fingerprint. Many copies are few rows."""
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            found = np.array([fingerprint(data[a:b].tobytes(), words, seed) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.int64)
            order = np.argsort(found, kind="stable")
            points, first = np.unique(found[order], return_index=True)
            cuts = pa.array(np.append(first, len(found)).astype(np.int32))
            ids = pa.ListArray.from_arrays(cuts, batch.column("id").take(pa.array(order)))
            yield pa.RecordBatch.from_arrays([pa.array(points), ids], ["fp", "ids"])

    return rows.mapInArrow(lean(run), "fp bigint, ids array<bigint>")


def coarse_cells(fp: Column, segment_bits: int = SEGMENT_BITS) -> Column:
    """The cells that a point goes to: its counts by segment, and those with one count more or less."""
    shifts = range(0, 64, segment_bits)
    counts = [F.bit_count(F.shiftrightunsigned(fp, s).bitwiseAND((1 << segment_bits) - 1)).cast("bigint") for s in shifts]
    own = F.lit(0).cast("bigint")
    for s, count in zip(shifts, counts, strict=True):
        own = own.bitwiseOR(F.shiftleft(count, s))
    less = [F.when(n > 0, own - (1 << s)) for s, n in zip(shifts, counts, strict=True)]
    more = [F.when(n < segment_bits, own + (1 << s)) for s, n in zip(shifts, counts, strict=True)]
    return F.array_compact(F.array(own, *less, *more))


def fine_cells(fp: Column) -> Column:
    """The cells of single bits: the point itself, and those one bit away."""
    return F.array(fp, *[fp.bitwiseXOR(F.lit(1 << s if s < 63 else -(1 << 63))) for s in range(64)])


def _met(batches: Iterator[pa.RecordBatch], points: int) -> Iterator[pa.RecordBatch]:
    """Verified links (u, v) of the cells, which come in order; (u, null) for a point of a cell with more than ``points``."""
    none = np.zeros(0, np.int64)
    cell, fp, over = none, none, None

    def links(stop: int) -> pa.RecordBatch:
        c, p = cell[:stop], fp[:stop]
        new = np.concatenate(([True], c[1:] != c[:-1]))
        size = np.bincount(np.cumsum(new) - 1)
        crowded = np.repeat((size > points) | (c[new] == over if over is not None else False), size)
        found = [(np.unique(p[crowded]), None)]
        c, p = c[~crowded], p[~crowded]
        for apart in range(1, points):
            at = np.flatnonzero(c[apart:] == c[:-apart])
            if not len(at):
                break
            a, b = p[at], p[at + apart]
            near = np.bitwise_count((a ^ b).view(np.uint64)) <= DISTANCE
            found.append((a[near], b[near]))
        pairs = np.unique(np.concatenate([np.column_stack(f) for f in found[1:]] or [np.zeros((0, 2), np.int64)]), axis=0)
        u = np.concatenate((found[0][0], pairs[:, 0]))
        v = pa.array(np.concatenate((found[0][0], pairs[:, 1])), mask=np.arange(len(u)) < len(found[0][0]))
        return pa.RecordBatch.from_arrays([pa.array(u), v], ["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cell = np.concatenate((cell, batch.column("cell").to_numpy()))
        fp = np.concatenate((fp, batch.column("fp").to_numpy()))
        # The last cell may go on in the next batch; a crowded one is sent on as it comes.
        last, begins = cell[-1], int(np.searchsorted(cell, cell[-1]))
        stop = len(cell) if last == over or len(cell) - begins > points else begins
        if stop:
            yield links(stop)
        over = last if stop == len(cell) else None
        cell, fp = cell[stop:], fp[stop:]
    if len(cell):
        yield links(len(cell))


def links_between(points: DataFrame, *, cell_points: int = CELL_POINTS) -> DataFrame:
    """Edges (u, v) that connect the different fingerprints ``fp`` which differ in ``DISTANCE`` bits at most.

    Of the pairs within a crowded part of the space only so many are given as connect it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _met(batches, cell_points)

    # A point is a short row but makes 33: without dealing, all would come from a few tasks.
    dealt = points.repartition(1 + points.count() // POINTS_PER_TASK)
    grid = dealt.select("fp", F.explode(coarse_cells(F.col("fp"))).alias("cell"))
    ordered = grid.repartition("cell").sortWithinPartitions("cell")
    met = written(ordered.mapInArrow(lean(run), "u bigint, v bigint"), "met")
    crowded = met.where("v IS NULL").select("u").distinct()
    fine = crowded.select("u", F.explode(fine_cells(F.col("u"))).alias("cell"))
    # At most 65 points, all linked.
    least = fine.select("u", F.min("u").over(Window.partitionBy("cell")).alias("v")).where("u <> v")
    return met.where("v IS NOT NULL").unionByName(least.distinct())


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, cell_points: int = CELL_POINTS
) -> DataFrame:
    """One row per row of ``docs``: identifier, ``fingerprint`` (hexadecimal) and ``component_id``."""
    table = written(fingerprint_table(docs, id_col=id_col, text_col=text_col, words=words), "fingerprints")
    points = written(table.groupBy("fp").agg(F.min(F.array_min("ids")).alias("least")), "points")
    links = written(links_between(points.select("fp"), cell_points=cell_points), "links")
    roots = components(links).select(F.col("node").alias("fp"), "root")
    rooted = points.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return table.join(named, "fp").select(
        F.explode("ids").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
