"""Ranked lexical search by Block-Max MaxScore over shards of an inverted index.

Items are asked in blocks of bounded size; the terms of a block are sent to all tasks. One pass over the documents makes
the index: shards of a few megabytes of text, each with the lists of the asked terms, and counts over all terms. A list
is cut into blocks of ``BLOCK_POSTINGS`` documents, packed into as few bytes as their numbers need, and each block says
its largest count and its shortest document. These bound a block's scores whatever the corpus is like, so an index stays
right when the statistics of the whole corpus, which are summed up afterwards, are known.

A shard answers an item with its lists ordered by bound. Lists are essential as long as their bounds and the later ones'
together reach the least score that still enters the heap; their documents are the candidates. The other lists make no
candidates: from the largest bound down, a candidate is rejected if what it has, the maximum of the block that it would
be in, and the bounds of the lists to come don't reach the heap; only blocks with candidates left are unpacked. A task
keeps one heap an item over its shards; heaps are merged in two rounds, so an item's are never all in one task.

Scores are whole numbers, so results don't depend on the order of sums. Terms are compared by 64-bit hashes.

Defined results: only A-Z are lower-cased; terms are runs of digits, letters and all characters beyond ASCII. A null or
empty text has no terms, isn't counted and is never found; an item without terms, or whose terms no document has, has no
rows; rows with the same item id are one item. Each row of the documents is ranked by itself, also if it repeats an
identifier; of equal scores the smaller identifier comes first, null at last. Other columns are left out, whatever their names.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankarena.llm.batches import lean, lower_ascii, pieces, span_hashes, text_bytes, word_spans
from rankarena.sources.scratch import written

TOP = 50
#: Bytes of text in a shard of the index; a longer text makes a shard of its own.
SHARD_BYTES = 16 << 20
#: Postings of a block.
BLOCK_POSTINGS = 128
#: Different (item, term) rows that are asked at a time, about; each is sent to all tasks (16 bytes).
ASKED_TERMS = 500_000
#: Shards that a task searches; their rows are short, but each is work.
SHARDS_PER_TASK = 4
#: Heaps of so many slices of tasks are merged before those of an item are.
SLICES = 64

# Fixed value: the bytes of terms, which are digits, letters and all characters beyond ASCII.
TERM_BYTES = np.zeros(256, bool)
TERM_BYTES[0x30:0x3A] = TERM_BYTES[0x41:0x5B] = TERM_BYTES[0x61:0x7B] = TERM_BYTES[0x80:] = True

_WIDTHS = [np.dtype(t) for t in ("u1", "<u2", "<u4", "<u8")]
_FILTER_BITS = 20
_INDEX = (
    "shard bigint, n_docs bigint, n_terms bigint, ids array<bigint>, lengths array<bigint>, terms array<bigint>, dfs array<bigint>, "
    "first_block array<bigint>, last_doc array<bigint>, max_tf array<bigint>, least_n array<bigint>, blocks array<binary>"
)


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each term of all rows, and its row."""
    data, offsets = text_bytes(texts)
    data = lower_ascii(data)
    starts, ends, row = word_spans(data, offsets, TERM_BYTES)
    return span_hashes(data, starts, ends), row


@dataclass
class Asked:
    """The sorted hashes of the terms that are asked, and the terms of each item as places in them."""

    terms: np.ndarray
    items: list[np.ndarray]

    def __post_init__(self) -> None:
        self._maybe = np.zeros(1 << _FILTER_BITS, bool)
        self._maybe[self.terms >> np.uint64(64 - _FILTER_BITS)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``hashes`` are asked, and their places among the terms."""
        at = np.flatnonzero(self._maybe[hashes >> np.uint64(64 - _FILTER_BITS)])
        place = np.minimum(np.searchsorted(self.terms, hashes[at]), len(self.terms) - 1)
        same = self.terms[place] == hashes[at]
        return at[same], place[same]


def _narrowest(values: np.ndarray) -> int:
    return next(k for k, t in enumerate(_WIDTHS) if int(values.max()) <= np.iinfo(t).max)


def pack_block(gaps: np.ndarray, counts: np.ndarray) -> bytes:
    """Two bytes for the widths of both, the gaps between documents, and the counts."""
    a, b = _narrowest(gaps), _narrowest(counts)
    return bytes([a, b]) + gaps.astype(_WIDTHS[a]).tobytes() + counts.astype(_WIDTHS[b]).tobytes()


def unpack_block(block: bytes, before: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and counts of a block; ``before`` is the last document of the block before it."""
    a, b = _WIDTHS[block[0]], _WIDTHS[block[1]]
    size = (len(block) - 2) // (a.itemsize + b.itemsize)
    gaps = np.frombuffer(block, a, size, 2).astype(np.int64)
    return before + np.cumsum(gaps), np.frombuffer(block, b, size, 2 + size * a.itemsize).astype(np.int64)


class _Builder:
    """Postings of the asked terms of a shard."""

    def __init__(self) -> None:
        self.ids: list[pa.Array] = []
        self.lengths: list[np.ndarray] = []
        self.postings: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.docs = self.bytes = 0

    def add(self, ids: pa.Array, texts: pa.Array, asked: Asked) -> None:
        hashes, row = terms_of(texts)
        at, term = asked.find(hashes)
        keys, counts = np.unique(term * len(texts) + row[at], return_counts=True)
        self.postings.append((keys // len(texts), keys % len(texts) + self.docs, counts))
        self.ids.append(ids)
        self.lengths.append(np.bincount(row, minlength=len(texts)))
        self.docs += len(texts)
        self.bytes += texts.nbytes

    def row(self, shard: int, asked: Asked, block_postings: int) -> pa.RecordBatch:
        term, doc, tf = (np.concatenate(parts) for parts in zip(*self.postings, strict=True))
        lengths = np.concatenate(self.lengths)
        order = np.argsort(term, kind="stable")
        term, doc, tf = term[order], doc[order], tf[order]
        starts = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, np.int64)
        dfs = np.diff(np.append(starts, len(term)))
        n_blocks = -(-dfs // block_postings)
        first_block = np.concatenate(([0], np.cumsum(n_blocks)))
        inside = np.arange(first_block[-1]) - np.repeat(first_block[:-1], n_blocks)
        begins = np.repeat(starts, n_blocks) + inside * block_postings
        ends = np.minimum(begins + block_postings, np.repeat(starts + dfs, n_blocks))
        gaps = np.diff(doc, prepend=-1)
        gaps[starts] = doc[starts] + 1
        blocks = [pack_block(gaps[a:b], tf[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
        none = np.zeros(0, np.int64)
        columns = {
            "ids": pa.chunked_array(self.ids).combine_chunks(),
            "lengths": lengths,
            "terms": asked.terms[term[starts]].view(np.int64),
            "dfs": dfs,
            "first_block": first_block,
            "last_doc": doc[ends - 1] if len(ends) else none,
            "max_tf": np.maximum.reduceat(tf, begins) if len(begins) else none,
            "least_n": np.minimum.reduceat(lengths[doc], begins) if len(begins) else none,
            "blocks": pa.array(blocks, pa.binary()),
        }
        numbers = {"shard": shard, "n_docs": int((lengths > 0).sum()), "n_terms": int(lengths.sum())}
        lists = {name: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for name, v in columns.items()}
        return pa.RecordBatch.from_pydict({**{k: pa.array([v], pa.int64()) for k, v in numbers.items()}, **lists})


def build_index(
    docs: DataFrame, asked: Asked, *, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES,
    block_postings: int = BLOCK_POSTINGS
) -> DataFrame:
    """One row per shard: how many documents and terms it has, and the lists of the asked terms.

    ``dfs`` and ``first_block`` are by list; ``last_doc``, ``max_tf``, ``least_n`` and ``blocks`` by block. Documents are
    numbered within their shard.
    """
    sent = docs.sparkSession.sparkContext.broadcast(asked)
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, part, shards, held = sent.value, TaskContext.get().partitionId(), 0, _Builder()
        for batch in batches:
            for piece in pieces(batch, "text"):
                held.add(piece.column("id"), piece.column("text"), asked)
                if held.bytes >= shard_bytes:
                    yield held.row(part << 32 | shards, asked, block_postings)
                    shards, held = shards + 1, _Builder()
        if held.docs:
            yield held.row(part << 32 | shards, asked, block_postings)

    return rows.mapInArrow(lean(run), _INDEX)


class Shard:
    """A row of the index, with the statistics of the whole corpus."""

    def __init__(self, row: dict[str, pa.Scalar], asked: Asked, weights: np.ndarray, n_docs: int, n_terms: int) -> None:
        def numbers(name: str) -> np.ndarray:
            return row[name].values.to_numpy()

        self.ids = row["ids"].values
        self._norm = 20 * self._length_norm(numbers("lengths"), n_docs, n_terms)
        self._dfs, self.first_block, self.last_doc = numbers("dfs"), numbers("first_block"), numbers("last_doc")
        self._blocks = row["blocks"].values
        term = np.searchsorted(asked.terms, numbers("terms").view(np.uint64))
        self.list_of = np.full(len(asked.terms), -1)
        self.list_of[term] = np.arange(len(term))
        self.weight = weights[term]
        max_tf, norm = numbers("max_tf"), 20 * self._length_norm(numbers("least_n"), n_docs, n_terms)
        self.block_bound = np.repeat(self.weight, np.diff(self.first_block)) * self._gain(max_tf, norm)
        self.bound = np.maximum.reduceat(self.block_bound, self.first_block[:-1]) if len(term) else self.weight
        self._unpacked: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @staticmethod
    def _length_norm(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
        return 100 - 50 + (50 * lengths * n_docs) // n_terms

    @staticmethod
    def _gain(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
        return (1_000_000_000 * tf) // (1000 * tf + norm)

    def block(self, k: int, of: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of a block of a list; unpacked once."""
        known = self._unpacked.get(k)
        if known is None:
            before = int(self.last_doc[k - 1]) if k > self.first_block[of] else -1
            docs, tf = unpack_block(self._blocks[k].as_py(), before)
            known = self._unpacked[k] = docs, self.weight[of] * self._gain(tf, self._norm[docs])
        return known

    def postings(self, of: int, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        docs, scores = zip(*(self.block(k, of) for k in blocks.tolist()), strict=True)
        return np.concatenate(docs), np.concatenate(scores)

    def best(self, terms: np.ndarray, top: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of the shard that may enter a heap whose worst score is ``least``, and their scores.

        None is missing that has a positive score of at least ``least`` and is among the shard's ``top`` with ties.
        """
        lists = self.list_of[terms]
        lists = lists[lists >= 0]
        lists = lists[np.argsort(-self.bound[lists], kind="stable")]
        rest = np.append(np.cumsum(self.bound[lists][::-1])[::-1], 0)
        score = np.zeros(len(self.ids), np.int64)
        least, at = max(least, 1), 0
        while at < len(lists) and rest[at] >= least:
            of = int(lists[at])
            docs, gained = self.postings(of, np.arange(self.first_block[of], self.first_block[of + 1]))
            score[docs] += gained
            at += 1
            least = self._raised(score, top, least)
        candidates = np.flatnonzero(score)
        for k in range(at, len(lists)):
            of = int(lists[k])
            low, high = int(self.first_block[of]), int(self.first_block[of + 1])
            block = low + np.searchsorted(self.last_doc[low:high], candidates)
            there = block < high
            reach = score[candidates] + rest[k + 1]
            reach[there] += self.block_bound[block[there]]
            open_still = reach >= least
            candidates, block = candidates[open_still], block[open_still & there]
            if len(block):
                docs, gained = self.postings(of, np.unique(block))
                place = np.minimum(np.searchsorted(docs, candidates), len(docs) - 1)
                found = docs[place] == candidates
                score[candidates[found]] += gained[place[found]]
                least = self._raised(score[candidates], top, least)
        candidates = candidates[score[candidates] >= least]
        return candidates, score[candidates]

    @staticmethod
    def _raised(scores: np.ndarray, top: int, least: int) -> int:
        """Scores only grow, so the one at the heap's end bounds what enters it."""
        return max(least, int(np.partition(scores, -top)[-top])) if len(scores) >= top else least


class Heap:
    """The best of an item so far: by score, then by identifier, null last."""

    def __init__(self, top: int) -> None:
        self.top, self.least = top, 0
        self.scores, self.ids, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        self.scores = np.concatenate((self.scores, scores))
        self.ids = np.concatenate((self.ids, ids.fill_null(0).to_numpy(zero_copy_only=False)))
        self.null = np.concatenate((self.null, ids.is_null().to_numpy(zero_copy_only=False)))
        order = np.lexsort((self.ids, self.null, -self.scores))[: self.top]
        self.scores, self.ids, self.null = self.scores[order], self.ids[order], self.null[order]
        if len(order) == self.top:
            self.least = int(self.scores[-1])


def corpus_statistics(index: DataFrame, asked: Asked) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the weight of each asked term."""
    n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    counted = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).groupBy("t.terms").agg(F.sum("t.dfs").alias("df"))
    # One row for each term that is asked, at most.
    found = counted.toArrow()
    dfs = np.zeros(len(asked.terms), np.int64)
    dfs[np.searchsorted(asked.terms, found.column("terms").to_numpy().view(np.uint64))] = found.column("df").to_numpy()
    weights = [math.floor(1000 * math.log((2 * (n_docs or 0) + 2) / (2 * df + 1))) for df in dfs.tolist()]
    return n_docs or 0, n_terms or 0, np.array(weights, np.int64)


def search(index: DataFrame, asked: Asked, *, top: int = TOP) -> DataFrame:
    """(part, item, score, doc_id): the heaps of each task; ``item`` is a place in ``asked.items``."""
    n_docs, n_terms, weights = corpus_statistics(index, asked)
    sent = index.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, part = sent.value, TaskContext.get().partitionId()
        heaps = [Heap(top) for _ in asked.items]
        for batch in batches:
            for k in range(batch.num_rows):
                shard = Shard({name: batch.column(name)[k] for name in batch.schema.names}, asked, weights, n_docs, n_terms)
                for heap, terms in zip(heaps, asked.items, strict=True):
                    docs, scores = shard.best(terms, top, heap.least)
                    if len(docs):
                        heap.add(scores, shard.ids.take(pa.array(docs)))
        for item, heap in enumerate(heaps):
            if len(heap.scores):
                columns = [np.full(len(heap.scores), part), np.full(len(heap.scores), item), heap.scores]
                ids = pa.array(heap.ids, mask=heap.null)
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), ids], ["part", "item", "score", "doc_id"])

    dealt = index.drop("shard", "n_docs", "n_terms").repartition(1 + index.count() // SHARDS_PER_TASK)
    return dealt.mapInArrow(lean(run), "part bigint, item bigint, score bigint, doc_id bigint")


def merged(heaps: DataFrame, *, top: int = TOP) -> DataFrame:
    """The best of each item over all tasks, with ``rank``."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    slices = Window.partitionBy("item", F.pmod("part", F.lit(SLICES))).orderBy(*order)
    heaps = heaps.withColumn("rank", F.row_number().over(slices)).where(F.col("rank") <= top)
    return heaps.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)


def item_terms(items: DataFrame, *, item_col: str, text_col: str) -> DataFrame:
    """(item, term): the different terms of each item."""
    kind = items.schema[item_col].dataType.simpleString()
    rows = items.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                hashes, row = terms_of(piece.column("text"))
                yield pa.RecordBatch.from_arrays([piece.column("item").take(pa.array(row)), pa.array(hashes.view(np.int64))], ["item", "term"])

    return rows.mapInArrow(lean(run), f"item {kind}, term bigint").distinct()


def ranked_search(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", top: int = TOP, shard_bytes: int = SHARD_BYTES, block_postings: int = BLOCK_POSTINGS,
    asked_terms: int = ASKED_TERMS
) -> DataFrame:
    """The ``top`` best documents of each item: the item, ``rank``, ``doc_id`` and ``score``."""
    spark = docs.sparkSession
    rows = written(item_terms(items, item_col=item_col, text_col=item_text_col), "item-terms")
    blocks = 1 + rows.count() // asked_terms
    kind = items.schema[item_col].dataType.simpleString()
    found = [spark.createDataFrame([], f"`{item_col}` {kind}, rank int, `{id_col}` bigint, score bigint")]
    for k in range(blocks):
        # A block of items is bounded; an item of more terms makes a block larger.
        block = rows.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).toArrow()
        if not block.num_rows:
            continue
        terms, place = np.unique(block.column("term").to_numpy().view(np.uint64), return_inverse=True)
        asked_by: dict[object, list[int]] = {}
        for item, at in zip(block.column("item").to_pylist(), place.tolist(), strict=True):
            asked_by.setdefault(item, []).append(at)
        asked = Asked(terms, [np.array(sorted(places)) for places in asked_by.values()])
        index = build_index(docs, asked, id_col=id_col, text_col=text_col, shard_bytes=shard_bytes, block_postings=block_postings)
        index = written(index, "index")
        best = written(merged(search(index, asked, top=top), top=top), "ranked")
        names = spark.createDataFrame(list(enumerate(asked_by)), f"item bigint, `{item_col}` {kind}")
        found.append(
            best.join(F.broadcast(names), "item").select(item_col, "rank", F.col("doc_id").alias(id_col), "score")
        )
    return reduce(DataFrame.unionByName, found)
