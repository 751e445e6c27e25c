"""Benchmark decontamination by an FM-index per shard of the training texts.

The test phrases (windows of consecutive words of each item) come in blocks of bounded size, a table in the shared folder
that is keyed by the block's number; a task holds one block at a time. Shards of some megabytes of training text are
indexed, each over the words that occur in the block's phrases: another word ends a run, and runs too short for any phrase
are left out, as no phrase can lie in them. All phrases of the block are searched backwards through the wavelet tree, their
occurrences are located through sampled suffix positions, and those of all blocks are merged into spans. Shards are rows of
one task, so nothing is shuffled, and a task that is lost is run again.

Words are compared by 64-bit hashes. Defined results: a null or empty text has no words and is never contaminated; an
item without words is no phrase; rows with the same item id are one item, and a null item id is written "null". An item of
more words than a block is a block of its own. Input columns of any name but the text's are kept in ``row``; repeated rows
are treated one by one.
"""

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankarena.llm.batches import lean, lower_ascii, pieces, span_hashes, text_bytes, word_spans
from rankarena.llm.fm_index import FMIndex
from rankarena.sources.scratch import scratch_path

WINDOW = 13
#: Words of test items that are searched at a time; a block is sent to all tasks (8 bytes a word and window place).
BLOCK_WORDS = 200_000
#: Bytes of text in a shard.
SHARD_BYTES = 4 << 20

# Fixed value: the bytes of words, which are digits, small letters and all characters beyond ASCII.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[0x30:0x3A] = WORD_BYTES[0x61:0x7B] = WORD_BYTES[0x80:] = True

_SPAN = pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
_FOUND = "n_words bigint, item_ids array<string>, spans array<struct<first_word: bigint, end_word: bigint, start: bigint, end: bigint>>"


@dataclass
class Block:
    """Different phrases, from their last word on, and the items that have them."""

    words: np.ndarray
    phrases: np.ndarray
    lengths: np.ndarray
    phrase_of: np.ndarray
    item_of: np.ndarray
    items: list[str]


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, offsets of rows, and start, end, row and hash of each word."""
    data, offsets = text_bytes(column)
    data = lower_ascii(data)
    starts, ends, row = word_spans(data, offsets, WORD_BYTES)
    return data, offsets, starts, ends, row, span_hashes(data, starts, ends)


def phrase_block(items: list[tuple[str, str]], window: int) -> Block | None:
    """Windows of all items; an item of fewer words is one window."""
    *_, row, hashes = words_of(pa.array([text for _, text in items], pa.string()))
    names = sorted({name for name, _ in items})
    place = {name: k for k, name in enumerate(names)}
    rows, lengths, owners = [], [], []
    for k, (name, _) in enumerate(items):
        words = hashes[np.searchsorted(row, k) : np.searchsorted(row, k, side="right")]
        if not len(words):
            continue
        size = min(window, len(words))
        windows = np.lib.stride_tricks.sliding_window_view(words, size)[:, ::-1]
        rows.append(np.pad(windows, ((0, 0), (0, window - size))))
        lengths.append(np.full(len(windows), size))
        owners.append(np.full(len(windows), place[name]))
    if not rows:
        return None
    keyed = np.column_stack((np.concatenate(rows), np.concatenate(lengths).astype(np.uint64)))
    unique, inverse = np.unique(keyed, axis=0, return_inverse=True)
    owned = np.unique(np.column_stack((inverse.ravel(), np.concatenate(owners))), axis=0)
    return Block(np.unique(hashes), unique[:, :window], unique[:, window].astype(np.int64), owned[:, 0], owned[:, 1], names)


def phrase_blocks(benchmark: DataFrame, path: str, *, id_col: str, text_col: str, window: int, block_words: int) -> int:
    """Write the items under ``path`` in blocks of about ``block_words`` words, and return how many blocks there are."""
    items = benchmark.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")
    )
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = 1 + total // (6 * block_words)

    def pack(table: pa.Table) -> pa.Table:
        block = phrase_block(list(zip(table.column("id").to_pylist(), table.column("text").to_pylist(), strict=True)), window)
        bodies = [] if block is None else [pickle.dumps(block)]
        return pa.table({"block": pa.array(table.column("block")[: len(bodies)], pa.int64()), "body": pa.array(bodies, pa.binary())})

    numbered = items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(count)))
    numbered.groupBy("block").applyInArrow(pack, "block bigint, body binary").write.parquet(path)
    return count


@lru_cache(maxsize=1)
def read_block(path: str, k: int) -> Block | None:
    """A block of the table that :func:`phrase_blocks` wrote; the last one that was asked for is kept."""
    store, root = fs.FileSystem.from_uri(path)
    found = dataset.dataset(root, filesystem=store, format="parquet").to_table(columns=["body"], filter=dataset.field("block") == k)
    return pickle.loads(found.column("body")[0].as_py()) if found.num_rows else None


def occurrences(block: Block, row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and phrase of each place where a phrase of the block occurs. ``row`` and ``hashes`` are by word."""
    none = np.zeros(0, np.int64)
    if not len(hashes):
        return none, none
    near = np.minimum(np.searchsorted(block.words, hashes), len(block.words) - 1)
    asked = np.flatnonzero(block.words[near] == hashes)
    if not len(asked):
        return none, none
    new_run = np.concatenate(([True], (np.diff(asked) > 1) | (np.diff(row[asked]) > 0)))
    run = np.cumsum(new_run) - 1
    asked = asked[(np.bincount(run) >= block.lengths.min())[run]]
    if not len(asked):
        return none, none
    new_run = np.concatenate(([True], (np.diff(asked) > 1) | (np.diff(row[asked]) > 0)))
    # The shard's own alphabet: 0 ends the text, 1 stands before each run.
    alphabet, symbols = np.unique(near[asked], return_inverse=True)
    at = np.arange(len(asked)) + np.cumsum(new_run)
    text = np.ones(at[-1] + 2, np.int64)
    text[at] = symbols + 2
    text[-1] = 0
    word_at = np.zeros(len(text), np.int64)
    word_at[at] = asked

    # Phrases with a word that the shard lacks can't occur.
    known = np.full(len(block.words), -1, np.int64)
    known[alphabet] = np.arange(len(alphabet)) + 2
    inside = np.arange(block.phrases.shape[1]) < block.lengths[:, None]
    coded = np.where(inside, known[np.minimum(np.searchsorted(block.words, block.phrases), len(known) - 1)], 0)
    possible = np.flatnonzero((coded >= 0).all(axis=1))
    if not len(possible):
        return none, none
    index = FMIndex(text)
    low, high = index.search(coded[possible], block.lengths[possible])
    count = np.maximum(high - low, 0)
    phrase = np.repeat(possible, count)
    suffix = np.repeat(low, count) + np.arange(len(phrase)) - np.repeat(np.cumsum(count) - count, count)
    return word_at[index.locate(suffix)], phrase


def _merged(covered: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of the runs of covered words within a row."""
    joined = covered[1:] & covered[:-1] & (row[1:] == row[:-1])
    first = np.flatnonzero(covered & ~np.concatenate(([False], joined)))
    last = np.flatnonzero(covered & ~np.concatenate((joined, [False])))
    return first, last


def _search_rows(texts: pa.Array, blocks: Iterator[Block]) -> list[pa.Array]:
    """n_words, item_ids and spans for a shard."""
    offsets, starts, ends, row, hashes = _shard_words(texts)
    n_words = np.bincount(row, minlength=len(texts))
    first_of = np.cumsum(n_words) - n_words
    edge = np.zeros(len(row) + 1, np.int64)
    items: dict[int, set[str]] = {}
    for block in blocks:
        word, phrase = occurrences(block, row, hashes)
        np.add.at(edge, word, 1)
        np.add.at(edge, word + block.lengths[phrase], -1)
        pairs = np.unique(np.column_stack((row[word], phrase)), axis=0)
        low, high = np.searchsorted(block.phrase_of, pairs[:, 1]), np.searchsorted(block.phrase_of, pairs[:, 1], side="right")
        for k, a, b in zip(pairs[:, 0].tolist(), low.tolist(), high.tolist(), strict=True):
            items.setdefault(k, set()).update(block.items[i] for i in block.item_of[a:b].tolist())
    first, last = _merged(np.cumsum(edge)[:-1] > 0, row)
    # Code points before the first and last byte of each span, to count spans in characters of their row.
    data, _ = text_bytes(texts)
    points = [[_code_points(data, offsets[r], at) for r, at in zip(row[some].tolist(), where[some].tolist(), strict=True)] for some, where in ((first, starts), (last, ends))]
    values = [first - first_of[row[first]], last + 1 - first_of[row[first]], *points]
    flat = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in values], fields=list(_SPAN))
    cuts = np.concatenate(([0], np.cumsum(np.bincount(row[first], minlength=len(texts))))).astype(np.int32)
    names = [sorted(items.get(k, ())) for k in range(len(texts))]
    return [pa.array(n_words, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array(cuts), flat)]


def _shard_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of rows, and start, end, row and hash of each word; bytes are looked at some rows at a time."""
    found, rows, at = [], 0, 0
    for piece in pieces(pa.RecordBatch.from_arrays([texts], ["text"]), "text"):
        data, _, starts, ends, row, hashes = words_of(piece.column("text"))
        found.append((starts + at, ends + at, row + rows, hashes))
        rows, at = rows + piece.num_rows, at + len(data)
    return (text_bytes(texts)[1], *(np.concatenate(parts) for parts in zip(*found, strict=True)))


def _code_points(data: np.ndarray, start: int, stop: int) -> int:
    return int(np.count_nonzero((data[start:stop] & 0xC0) != 0x80))


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, block_words: int = BLOCK_WORDS, keep_text: bool = False
) -> DataFrame:
    """For each row of ``docs``: ``row`` (all columns but the text), ``text``, ``n_words``, ``n_hit``, ``item_ids`` (sorted) and ``spans``.

    A span has its first word, the word after its last, and the same in characters. Without ``keep_text`` the text is null.
    """
    path = scratch_path(docs.sparkSession, "phrases")
    blocks = phrase_blocks(benchmark, path, id_col=item_col, text_col=item_text_col, window=window, block_words=block_words)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*(rest or [F.lit(None).alias("none")])).alias("row"), F.col(f"`{text_col}`").alias("text"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", SHARD_BYTES):
                asked = (block for k in range(blocks) if (block := read_block(path, k)) is not None)
                text = piece.column("text") if keep_text else pa.nulls(piece.num_rows, pa.string())
                columns = [piece.column("row"), text, *_search_rows(piece.column("text"), asked)]
                yield pa.RecordBatch.from_arrays(columns, ["row", "text", "n_words", "item_ids", "spans"])

    found = rows.mapInArrow(lean(search), f"row {rows.schema['row'].dataType.simpleString()}, text string, {_FOUND}")
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end_word"] - s["first_word"])
    return found.select("row", "text", "n_words", n_hit.alias("n_hit"), "item_ids", "spans")


def contaminated() -> Column:
    """At least a twentieth of the words are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
