"""Byte-pair encoding by a tokenization automaton.

The automaton reads token sequences and accepts exactly those that byte-pair encoding produces. It starts as one state
that loops on every byte. Each merge (u, v), in order, adds a gadget: a copy of the state where u lands, without the arc
v; arcs u now lead to the copy, and every state that has an arc u gets an arc for the new token uv, which lands where v
does. The result is deterministic, and each token lands in one state. Its arcs would fill states x tokens entries, so
the compiled tables hold the gadgets: for each token its parts and its step, and for (token, arc) the step that took the
arc away. Whether a state has an arc is looked up through them and remembered.

A pre-split word is encoded by transitions only: from the place that has been reached, follow the trie of arc labels and
take the longest arc that the state has, or step back where there is none. Decoding emits the labels of the arcs.

Defined results: a null or empty text has no tokens. The strings of special tokens become their ids, the leftmost
and then the longest first, unless ``special_as_text``. Rows are treated one by one; texts may have any length.
"""

import hashlib
import json
import struct
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankarena.llm.batches import lean

# Fixed value: how this vocabulary splits text before its merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words longer than this are not remembered, and the memory is emptied when it holds so many words or arcs.
MEMO_CHARS = 48
MEMO_WORDS = 400_000
MEMO_ARCS = 2_000_000
_NEVER = 1 << 40
_PACK = struct.Struct("<I").pack


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files: visible Latin-1 characters, the others moved up by 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Automaton:
    """Compiled merges. ``labels`` maps each token to its bytes."""

    def __init__(self, labels: dict[int, bytes], merges: Iterable[tuple[int, int, int]]) -> None:
        """``merges`` are (u, v, uv) as tokens, in order; tokens that no merge makes must be single bytes or special."""
        self.labels = labels
        self.step: dict[int, int] = {token: -1 for token, label in labels.items() if len(label) == 1}
        self.parts: dict[int, tuple[int, int]] = {}
        self.taken: dict[tuple[int, int], int] = {}
        for k, (u, v, made) in enumerate(merges):
            # The gadget: u's landing state loses the arc v at this step; uv inherits u's arcs in and v's landing state.
            self.taken.setdefault((u, v), k)
            if made not in self.step:
                self.step[made] = k
                self.parts[made] = (u, v)
        self.trie: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token in self.step:
            node = 0
            for byte in labels[token]:
                after = self.trie[node].get(byte)
                if after is None:
                    after = self.trie[node][byte] = len(self.trie)
                    self.trie.append({})
                    self.token_at.append(-1)
                node = after
            self.token_at[node] = token
        self._arcs: dict[int, bool] = {}

    def has_arc(self, landed: int, token: int) -> bool:
        """Whether the state where ``landed`` ends has an arc ``token``."""
        key = landed << 32 | token
        known = self._arcs.get(key)
        if known is None:
            if len(self._arcs) >= MEMO_ARCS:
                self._arcs.clear()
            known = self._arcs[key] = self._resolve(landed, token)
        return known

    def _resolve(self, left: int, right: int) -> bool:
        before = _NEVER
        while True:
            if self.taken.get((left, right), _NEVER) < before:
                return False
            a, b = self.step[left], self.step[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                # The token is older than the state: the state copied its arcs from where left's second part landed.
                before = min(before, a)
                left = self.parts[left][1]
            else:
                # The state is older: it got the arc with the merge, if it had one for the first part then. A merge of
                # equal parts takes that arc away in the same step, before the new one is made.
                before = min(before, b + 1)
                right = self.parts[right][0]

    def _labels_at(self, word: bytes, at: int) -> list[tuple[int, int]]:
        """(end, token) of the arc labels that the word has at a place, by length."""
        found, node, trie, token_at = [], 0, self.trie, self.token_at
        for end in range(at, len(word)):
            node = trie[node].get(word[end], -1)
            if node < 0:
                break
            if token_at[node] >= 0:
                found.append((end + 1, token_at[node]))
        return found

    def encode(self, word: bytes) -> list[int]:
        """The tokens of the one path whose labels make up the word.

        Only one path of the automaton leads to each place. So a place that turned out to be a dead end is never tried
        again, and each place is looked at once, in words of any length.
        """
        size, at, path = len(word), 0, []
        ends, open_labels, dead = [0], [self._labels_at(word, 0)], set()
        while at < size:
            labels = open_labels[-1]
            while labels:
                end, token = labels.pop()
                if end not in dead and (not path or self.has_arc(path[-1], token)):
                    path.append(token)
                    ends.append(end)
                    open_labels.append(self._labels_at(word, end))
                    at = end
                    break
            else:
                dead.add(at)
                path.pop()
                ends.pop()
                open_labels.pop()
                at = ends[-1]
        return path


class Tokenizer:
    """Pre-splitting, the automaton and special tokens."""

    def __init__(self, automaton: Automaton, special: dict[str, int], *, special_as_text: bool = False) -> None:
        self.automaton = automaton
        self.special = special
        self._split = regex.compile(SPLIT)
        names = sorted(special, key=len, reverse=True)
        self._cut = regex.compile("|".join(map(regex.escape, names))) if names and not special_as_text else None
        self._labels = dict(automaton.labels) | {i: s.encode() for s, i in special.items()}
        self._words = _Words(automaton)

    def encode(self, text: str) -> np.ndarray:
        """Ids as little-endian unsigned 32-bit integers."""
        parts, at = [], 0
        if self._cut is not None:
            for match in self._cut.finditer(text):
                parts += map(self._words.__getitem__, self._split.findall(text, at, match.start()))
                parts.append(np.array([self.special[match[0]]], "<u4").tobytes())
                at = match.end()
        # A slice, as the split looks ahead: a part ends where a special token begins.
        parts += map(self._words.__getitem__, self._split.findall(text[at:] if at else text))
        return np.frombuffer(b"".join(parts), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self._labels.__getitem__, ids.tolist())).decode("utf-8", errors="replace")


class _Words(dict):  # type: ignore[type-arg]
    """Words to the bytes of their ids."""

    def __init__(self, automaton: Automaton) -> None:
        super().__init__()
        self._encode = automaton.encode

    def __missing__(self, word: str) -> bytes:
        ids = b"".join(map(_PACK, self._encode(word.encode("utf-8"))))
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = ids
        return ids


def load(file: str, *, special_as_text: bool = False) -> Tokenizer:
    """From a byte-level vocabulary file in JSON with ``vocab``, ``merges`` and added tokens."""
    stored = json.loads(Path(file).read_text(encoding="utf-8"))
    letters, vocab = byte_letters(), stored["model"]["vocab"]
    special = {t["content"]: t["id"] for t in stored["added_tokens"]}
    labels = {i: bytes(letters[c] for c in name) for name, i in vocab.items() if name not in special}
    merges = []
    for merge in stored["model"]["merges"]:
        u, v = merge.split(" ") if isinstance(merge, str) else merge
        merges.append((vocab[u], vocab[v], vocab[u + v]))
    return Tokenizer(Automaton(labels, merges), special, special_as_text=special_as_text)


_loaded: dict[tuple[str, bool], Tokenizer] = {}


def loaded(file: str, special_as_text: bool) -> Tokenizer:
    """One tokenizer for each worker process."""
    key = (file, special_as_text)
    if key not in _loaded:
        _loaded[key] = load(file, special_as_text=special_as_text)
    return _loaded[key]


def encode_documents(docs: DataFrame, *, file: str, text_col: str = "text", ids_col: str = "ids", special_as_text: bool = False) -> DataFrame:
    """``docs`` with ``ids_col``: the ids of the whole text as little-endian unsigned 32-bit integers, binary."""
    return _mapped(docs, text_col, ids_col, "binary", file, special_as_text, _encode_rows)


def decode_documents(docs: DataFrame, *, file: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with ``text_col``: the text that the ids in ``ids_col`` stand for; null ids give an empty text."""
    return _mapped(docs, ids_col, text_col, "string", file, False, _decode_rows)


def round_trip(docs: DataFrame, *, file: str, text_col: str = "text", ids_col: str = "ids", decodes_col: str = "decodes") -> DataFrame:
    """``docs`` without the text, with its ids and whether they decode to it, in one pass."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (text_col, ids_col, decodes_col)]
    rows = docs.select(F.struct(*(kept or [F.lit(None).alias("none")])).alias("row"), F.col(f"`{text_col}`").alias("text"))
    made = _mapped(rows, "text", "made", "struct<ids: binary, decodes: boolean>", file, False, _round_trip_rows)
    columns = [F.col("made.ids").alias(ids_col), F.col("made.decodes").alias(decodes_col)]
    return made.select(*(["row.*"] if kept else []), *columns)


def digest_documents(docs: DataFrame, *, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each text in one pass, keeping only counts and digests of both."""
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("_text"))
    digests = "struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>"
    made = _mapped(rows, "_text", "_made", digests, file, False, _digest_rows)
    return made.select(id_col, "_made.*")


def _encode_rows(texts: Iterator[bytes], tokenizer: Tokenizer) -> pa.Array:
    return pa.array([tokenizer.encode(t.decode("utf-8")).tobytes() for t in texts], pa.binary())


def _decode_rows(ids: Iterator[bytes], tokenizer: Tokenizer) -> pa.Array:
    return pa.array([tokenizer.decode(np.frombuffer(i, "<u4")) for i in ids], pa.string())


def _round_trip_rows(texts: Iterator[bytes], tokenizer: Tokenizer) -> pa.Array:
    rows = []
    for text in texts:
        ids = tokenizer.encode(text.decode("utf-8"))
        rows.append({"ids": ids.tobytes(), "decodes": tokenizer.decode(ids).encode("utf-8") == text})
    return pa.array(rows, pa.struct([("ids", pa.binary()), ("decodes", pa.bool_())]))


def _digest_rows(texts: Iterator[bytes], tokenizer: Tokenizer) -> pa.Array:
    rows = []
    for text in texts:
        ids = tokenizer.encode(text.decode("utf-8"))
        decoded = tokenizer.decode(ids).encode("utf-8")
        rows.append(
            {"n_tokens": len(ids), "ids_sha256": hashlib.sha256(ids).hexdigest(), "decoded_sha256": hashlib.sha256(decoded).hexdigest()}
        )
    kinds = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    return pa.array(rows, pa.struct(kinds))


def _mapped(docs: DataFrame, source: str, target: str, kind: str, file: str, special_as_text: bool, rows) -> DataFrame:  # noqa: ANN001
    kept = [c for c in docs.columns if c not in (source, target)] if kind.startswith("struct") else [c for c in docs.columns if c != target]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + [f"`{target}` {kind}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = loaded(file, special_as_text)
        for batch in batches:
            # Some rows at a time, so that a batch's ids and texts are not all held at once.
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                given = (v.as_py() or b"" for v in part.column(source).cast(pa.large_binary()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], rows(given, tokenizer)], [*kept, target])

    return docs.mapInArrow(lean(run), schema)
