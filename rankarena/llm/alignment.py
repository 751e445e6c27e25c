"""Alignment of two tokenizers over the same texts: which tokens cover the same bytes, and which pairs do so most often.

Each text is encoded twice, by byte-level merges (A, of a space and the text) and by pieces (B, which puts a space before
the text itself). The ends of A's tokens, counted in bytes, are keys of a dictionary to their places, and so are B's. The
keys that both have, as a set, are the places where both cut; sorted, they slice the two lists of ids into groups. The links
of a group are all pairs of an A and a B token in it; they are expanded slice by slice, and equal pairs of ids are counted.

A pair's count is the number of documents of the whole corpus that have it linked. Texts of some megabytes make a shard. A
shard asks once for each of its pairs; the asking rows, added up by pair, are the counts, and go back to their shards, where the
links of each document are looked up. So a pair has one row a shard, however many documents have it.

Defined results: strings of special tokens are plain text. A null or empty text, and one whose tokens don't spell a space
and the text (as one with U+2581), has no tokens: its numbers are zero and its groups empty. Rows are treated one by one,
also with the same identifier. A group in which both have thousands of different ids is expanded in blocks. Other
columns are left out, whatever their names.
"""

import hashlib
import itertools
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankarena.llm.batches import lean, lean_cogroup, pieces
from rankarena.llm.bpe import SPLIT, byte_letters
from rankarena.sources.scratch import written

#: Bytes of text whose pairs are looked up together; a longer text makes a shard of its own.
SHARD_BYTES = 16 << 20
#: Links that are expanded at a time.
LINKS = 1 << 20
#: Characters of remembered chunks of text, for each worker; the memory is emptied when it is full.
MEMO_CHARS = 6_000_000
#: Pairs are packed into one number: the A id times this, and the B id.
_SHIFT = 32

# The sign that pieces have for a space, and the names of pieces that are a byte.
_SPACE_SIGN = "▁"
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


class ByteTokenizer:
    """Byte-level merges of a vocabulary file in JSON. Its tokens always spell the bytes that it is given."""

    def __init__(self, file: str) -> None:
        stored = json.loads(Path(file).read_text(encoding="utf-8"))
        letters, special = byte_letters(), {t["content"] for t in stored["added_tokens"]}
        labels = {bytes(letters[c] for c in name): i for name, i in stored["model"]["vocab"].items() if name not in special}
        made = [stored["model"]["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in stored["model"]["merges"]]
        if any(a >= b for a, b in zip(made, made[1:])):
            raise ValueError(f"{file}: ids must follow the order of merges")
        self._encode = tiktoken.Encoding(Path(file).stem, pat_str=SPLIT, mergeable_ranks=labels, special_tokens={}).encode_to_numpy
        self.lengths = np.zeros(1 + max(labels.values()), np.int64)
        self.lengths[list(labels.values())] = [len(label) for label in labels]

    def encode(self, text: str) -> np.ndarray:
        return self._encode(" " + text, disallowed_special=()).astype(np.int64)


class PieceTokenizer:
    """Pieces of a model file with byte fallback that changes no text but for spaces.

    No piece goes on after a space sign that follows something else, so a text can be cut before each run of spaces, and the
    chunks be encoded by themselves and remembered.
    """

    def __init__(self, file: str) -> None:
        self._pieces = sentencepiece.SentencePieceProcessor(model_file=file)
        names = [self._pieces.id_to_piece(i) for i in range(self._pieces.get_piece_size())]
        if any(re.search(f"[^{_SPACE_SIGN}]{_SPACE_SIGN}", name) for name in names):
            raise ValueError(f"{file}: pieces go across words")
        self._labels = [bytes([int(b[1], 16)]) if (b := _BYTE_PIECE.fullmatch(n)) else n.replace(_SPACE_SIGN, " ").encode() for n in names]
        self.lengths = np.array([len(label) for label in self._labels])
        self._space = self._pieces.piece_to_id(_SPACE_SIGN)
        self._cut = re.compile(" +[^ ]*").findall
        self._known: dict[str, bytes | None] = {}
        self._chars = 0

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray | None]:
        """The ids of each text; None where they don't spell a space and the text."""
        cut = [self._cut(" " + text) for text in texts]
        if self._chars > MEMO_CHARS:
            self._known.clear()
            self._chars = 0
        new = list(set().union(*cut).difference(self._known))
        self._learn(new)
        known = self._known.__getitem__
        for chunks in cut:
            parts = list(map(known, chunks))
            yield None if None in parts else np.frombuffer(b"".join(parts), "<u4").astype(np.int64)

    def _learn(self, chunks: list[str]) -> None:
        # The tokenizer puts one space before what it gets. Nothing after that space is a chunk of its own.
        found = self._pieces.encode([c[1:] for c in chunks], num_threads=1)
        found = [ids if len(c) > 1 else [self._space] for c, ids in zip(chunks, found, strict=True)]
        flat = np.fromiter(itertools.chain.from_iterable(found), "<u4")
        ends = list(itertools.accumulate(map(len, found), initial=0))
        stored = flat.tobytes()
        # Together they spell the chunks nearly always; then so does each that spells as many bytes as its chunk has.
        bodies = [c.encode() for c in chunks]
        sizes = np.diff(np.concatenate(([0], np.cumsum(self.lengths[flat])))[ends])
        if sizes.tolist() == list(map(len, bodies)) and b"".join(map(self._labels.__getitem__, flat.tolist())) == b"".join(bodies):
            spelt = itertools.repeat(True)
        else:
            spelt = (b"".join(map(self._labels.__getitem__, ids)) == body for ids, body in zip(found, bodies, strict=True))
        for chunk, start, end, same in zip(chunks, ends, ends[1:], spelt):
            self._known[chunk] = stored[4 * start : 4 * end] if same else None
        self._chars += sum(map(len, chunks))


@dataclass
class Alignment:
    """Ids of both, and for each group how many ids of A and of B come up to its end."""

    a: np.ndarray
    b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray

    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        """How many ids of A and of B each group has."""
        return self.cut_a - np.concatenate(([0], self.cut_a[:-1])), self.cut_b - np.concatenate(([0], self.cut_b[:-1]))


_NONE = np.zeros(0, np.int64)
_EMPTY = Alignment(_NONE, _NONE, _NONE, _NONE)


def aligned(a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray) -> Alignment:
    """Groups between the byte offsets ``end_a`` and ``end_b`` that both lists of ends have."""
    place_a = dict(zip(end_a.tolist(), range(1, len(a) + 1), strict=True))
    place_b = dict(zip(end_b.tolist(), range(1, len(b) + 1), strict=True))
    common = sorted(place_a.keys() & place_b.keys())
    cut_a = np.fromiter(map(place_a.__getitem__, common), np.int64, len(common))
    cut_b = np.fromiter(map(place_b.__getitem__, common), np.int64, len(common))
    return Alignment(a, b, cut_a, cut_b)


class Aligner:
    def __init__(self, file_a: str, file_b: str) -> None:
        self.a, self.b = ByteTokenizer(file_a), PieceTokenizer(file_b)

    def align_all(self, texts: Iterable[str | None]) -> Iterator[Alignment]:
        texts = [text or "" for text in texts]
        for text, b in zip(texts, self.b.encode_all(texts), strict=True):
            if b is None or not text:
                yield _EMPTY
            else:
                a = self.a.encode(text)
                yield aligned(a, b, np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b]))


@lru_cache(maxsize=4)
def aligner(file_a: str, file_b: str) -> Aligner:
    """One for each worker process."""
    return Aligner(file_a, file_b)


def expanded(found: Alignment) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs of linked ids, sorted, and how many links each has."""
    n_a, n_b = found.sizes()
    upto = np.cumsum(n_a * n_b)
    parts, start = [], 0
    while start < len(upto):
        stop = int(np.searchsorted(upto, (upto[start - 1] if start else 0) + LINKS, side="right"))
        if stop > start:
            parts.append(_counted(_links(found, n_a, n_b, slice(start, stop))))
        else:
            stop = start + 1
            parts += _links_of_group(found, n_a, n_b, start)
        start = stop
    if len(parts) == 1:
        return parts[0]
    codes = np.concatenate([_NONE, *(c for c, _ in parts)])
    unique, place = np.unique(codes, return_inverse=True)
    return unique, np.bincount(place, np.concatenate([_NONE, *(n for _, n in parts)]), len(unique)).astype(np.int64)


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes.sort()
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[first], np.diff(np.append(first, len(codes)))


def _links(found: Alignment, n_a: np.ndarray, n_b: np.ndarray, groups: slice) -> np.ndarray:
    """All links of some groups: each A token as often as its group has B tokens, and these from the first on."""
    begin = int(found.cut_a[groups.start] - n_a[groups.start])
    a = found.a[begin : int(found.cut_a[groups.stop - 1])]
    times = np.repeat(n_b[groups], n_a[groups])
    upto = np.cumsum(times)
    first = np.repeat(found.cut_b[groups] - n_b[groups], n_a[groups]) - (upto - times)
    b = found.b[np.repeat(first, times) + np.arange(int(upto[-1]))]
    return np.repeat(a << _SHIFT, times) | b


def _links_of_group(found: Alignment, n_a: np.ndarray, n_b: np.ndarray, group: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The pairs of a large group, from the different ids of both and how often they are there."""
    a, times_a = np.unique(found.a[found.cut_a[group] - n_a[group] : found.cut_a[group]], return_counts=True)
    b, times_b = np.unique(found.b[found.cut_b[group] - n_b[group] : found.cut_b[group]], return_counts=True)
    step = max(1, LINKS // len(b))
    return [
        (((a[k : k + step] << _SHIFT)[:, None] | b).ravel(), np.outer(times_a[k : k + step], times_b).ravel())
        for k in range(0, len(a), step)
    ]


@lru_cache(maxsize=1)
def _digits(high: int) -> np.ndarray:
    """The decimal digits of 0 … high-1, one row a number, with zero bytes before them."""
    width = len(str(high))
    return np.array([str(k).rjust(width, "\0") for k in range(high)], f"S{width}").view(np.uint8).reshape(high, width)


def group_text(found: Alignment) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: the ids of each group."""
    if not len(found.cut_a):
        return b""
    total = len(found.a) + len(found.b)
    high = 1 << int(max(found.a.max(), found.b.max())).bit_length()
    digits = _digits(max(high, 1 << 16))
    n_a, n_b = found.sizes()
    at_a = np.arange(len(found.a)) + np.repeat(found.cut_b - n_b, n_a)
    at_b = np.arange(len(found.b)) + np.repeat(found.cut_a, n_b)
    out = np.empty((total, digits.shape[1] + 1), np.uint8)
    out[at_a, :-1] = digits[found.a]
    out[at_b, :-1] = digits[found.b]
    out[:, -1] = ord(",")
    out[at_a[found.cut_a - 1], -1] = ord("|")
    out[at_b[found.cut_b - 1], -1] = ord(";")
    flat = out.ravel()
    return flat[flat != 0][:-1].tobytes()


def alignments(docs: DataFrame, *, file_a: str, file_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: identifier, ``a`` and ``b`` (ids), and ``cut_a`` and ``cut_b``: how many of them come up to each group's end."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align_all = aligner(file_a, file_b).align_all
        for batch in batches:
            for piece in pieces(batch, "text"):
                found = list(align_all(piece.column("text").to_pylist()))
                lists = [pa.array([getattr(f, name) for f in found], pa.list_(pa.int64())) for name in ("a", "b", "cut_a", "cut_b")]
                yield pa.RecordBatch.from_arrays([piece.column("id"), *lists], ["id", "a", "b", "cut_a", "cut_b"])

    schema = f"id {kind}, a array<bigint>, b array<bigint>, cut_a array<bigint>, cut_b array<bigint>"
    return rows.mapInArrow(lean(run), schema).withColumnRenamed("id", id_col)


class _Shard:
    """Rows of a shard, and the pairs of their documents."""

    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.codes: list[np.ndarray] = []
        self.links: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id: int | None, found: Alignment) -> None:
        codes, links = expanded(found) if len(found.cut_a) else (_NONE, _NONE)
        text = group_text(found)
        self.rows.append({
            "doc_id": doc_id, "n_a": len(found.a), "n_b": len(found.b), "n_groups": len(found.cut_a),
            "n_links": int(links.sum()), "groups_sha256": hashlib.sha256(text).hexdigest() if text else "",
        })
        self.codes.append(codes)
        self.links.append(links)

    def batch(self, shard: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """The documents with the places of their pairs among the shard's; first a row with the pairs and their documents."""
        pack = zstandard.ZstdCompressor(level=3).compress
        places, pairs = pd.factorize(np.concatenate([_NONE, *self.codes]))
        # Sorted pairs and places take less room.
        order = np.argsort(pairs)
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        places, pairs = number[places], pairs[order]
        documents = np.bincount(places, minlength=len(pairs))
        asks = pack(np.diff(pairs, prepend=0).tobytes() + documents.astype("<u4").tobytes())
        yield pa.RecordBatch.from_pylist([{"shard": shard, "asks": asks}], schema=schema)
        at = np.cumsum([0, *map(len, self.codes)]).tolist()
        for k, row in enumerate(self.rows):
            steps = np.diff(places[at[k] : at[k + 1]], prepend=0).astype("<u4")
            row |= {"shard": shard, "body": pack(steps.tobytes() + self.links[k].astype("<u4").tobytes())}
        for k in range(0, len(self.rows), 1024):
            yield pa.RecordBatch.from_pylist(self.rows[k : k + 1024], schema=schema)


_NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]
_SHARDS = "shard bigint, asks binary, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, body binary"


def shard_table(
    docs: DataFrame, *, file_a: str, file_b: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """A row for each document, with its pairs in ``body``, and one for each shard, with what it asks for in ``asks``."""
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = pa.schema([
        ("shard", pa.int64()), ("asks", pa.binary()), ("doc_id", pa.int64()), *[(n, pa.int64()) for n in _NUMBERS],
        ("groups_sha256", pa.string()), ("body", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align_all, number, held = aligner(file_a, file_b).align_all, TaskContext.get().partitionId() << 32, _Shard()
        for batch in batches:
            for piece in pieces(batch, "text"):
                for doc_id, found in zip(piece.column("id").to_pylist(), align_all(piece.column("text").to_pylist()), strict=True):
                    held.add(doc_id, found)
                held.bytes += piece.column("text").nbytes
                if held.bytes >= shard_bytes:
                    yield from held.batch(number, schema)
                    number, held = number + 1, _Shard()
        if held.rows:
            yield from held.batch(number, schema)

    return rows.mapInArrow(lean(run), _SHARDS)


def _asks(shards: DataFrame) -> DataFrame:
    """(shard, place, a, b, documents): the pairs of each shard, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for shard, asks in zip(batch.column("shard").to_pylist(), batch.column("asks"), strict=True):
                data = unpack(asks.as_py())
                size = len(data) // 12
                pairs, documents = np.cumsum(np.frombuffer(data, np.int64, size)), np.frombuffer(data, "<u4", size, 8 * size)
                for start in range(0, size, 1 << 16):
                    part = slice(start, start + (1 << 16))
                    some = pairs[part]
                    columns = [np.full(len(some), shard), np.arange(start, start + len(some)), some >> _SHIFT, some & ((1 << _SHIFT) - 1)]
                    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                    arrays = [pa.array(c).cast(t) for c, t in zip(columns, types, strict=True)]
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array(documents[part].astype(np.int64))], ["shard", "place", "a", "b", "documents"])

    asking = shards.where("asks IS NOT NULL").select("shard", "asks")
    return asking.mapInArrow(lean(run), "shard bigint, place int, a int, b int, documents bigint")


def linked_counts(
    docs: DataFrame, *, file_a: str, file_b: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """One row per row of ``docs``: sizes, links, links whose count is the highest of their A id, sum of counts, digest of groups."""
    shards = written(
        shard_table(docs, file_a=file_a, file_b=file_b, id_col=id_col, text_col=text_col, shard_bytes=shard_bytes), "shards"
    )
    # A pair is asked for once by each shard that has it, so no key has more rows than there are shards.
    counted = _asks(shards).select("shard", "place", "a", F.sum("documents").over(Window.partitionBy("a", "b")).alias("count"))
    counted = written(counted, "pair-counts")
    # One row for each id of A, at most.
    best = counted.groupBy("a").agg(F.max("count").alias("best"))
    answers = counted.join(F.broadcast(best), "a").select(
        "shard", "place", F.when(F.col("count") == F.col("best"), -F.col("count")).otherwise(F.col("count")).alias("count")
    )
    names = ["doc_id", *_NUMBERS, "n_best", "count_sum", "groups_sha256"]

    def look_up(table: pa.Table, known: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        # Counts that are their A id's highest are negative.
        counts = np.zeros(known.num_rows, np.int64)
        counts[known.column("place").to_numpy()] = known.column("count").to_numpy()
        n_best, sums = [], []
        for body in table.column("body"):
            data = unpack(body.as_py())
            size = len(data) // 8
            found = counts[np.cumsum(np.frombuffer(data, "<u4", size), dtype=np.int64)]
            links = np.frombuffer(data, "<u4", size, 4 * size).astype(np.int64)
            n_best.append(int(links[found < 0].sum()))
            sums.append(int((links * np.abs(found)).sum()))
        made = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(sums, pa.int64())}
        return pa.Table.from_arrays([made[n] if n in made else table.column(n) for n in names], names)

    rows = shards.where("asks IS NULL").drop("asks").groupBy("shard").cogroup(answers.groupBy("shard"))
    schema = ", ".join(f"{n} {'string' if n == 'groups_sha256' else 'bigint'}" for n in names)
    return rows.applyInArrow(lean_cogroup(look_up), schema).withColumnRenamed("doc_id", id_col)
