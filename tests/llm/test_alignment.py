"""Alignment of two tokenizers against the libraries and plain loops."""

import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from test_operators import frame, mixed_texts
from tokenizers import Tokenizer

from rankarena.llm import alignment, bpe, catalog

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = Tokenizer.from_file(A)
LIBRARY.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file=B)
BYTES = bpe.byte_letters()


def plain_tokens(text):
    """Ids and bytes of both, or nothing."""
    if not text:
        return [], [], [], []
    a = LIBRARY.encode(" " + text, add_special_tokens=False).ids
    b = PIECES.encode(text)
    bytes_a = [bytes(BYTES[c] for c in LIBRARY.id_to_token(i)) for i in a]
    names = [PIECES.id_to_piece(i) for i in b]
    bytes_b = [bytes([int(n[3:5], 16)]) if re.fullmatch("<0x..>", n) else n.replace("▁", " ").encode() for n in names]
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return [], [], [], []
    return a, b, bytes_a, bytes_b


def plain_groups(text):
    a, b, bytes_a, bytes_b = plain_tokens(text)
    groups, i, j, end_a, end_b = [([], [])], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if end_a <= end_b and i < len(a):
            end_a += len(bytes_a[i])
            groups[-1][0].append(a[i])
            i += 1
        else:
            end_b += len(bytes_b[j])
            groups[-1][1].append(b[j])
            j += 1
        if end_a == end_b:
            groups.append(([], []))
    return groups[:-1]


def plain_counts(docs):
    """Sorted rows of (doc_id, text) pairs."""
    groups = [(i, plain_groups(t)) for i, t in docs]
    links = [collections.Counter((a, b) for x, y in g for a in x for b in y) for _, g in groups]
    counts = collections.Counter(pair for found in links for pair in found)
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    rows = []
    for (i, g), found in zip(groups, links, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        rows.append((
            i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), found.total(),
            sum(n for p, n in found.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in found.items()),
            hashlib.sha256(text.encode()).hexdigest() if text else "",
        ))
    return sorted(rows, key=str)


ODD = [
    None, "", " ", "  ", "a ", " a", "a  b   ", "\n", " \n ", "\t x", "▁", "a▁b", "<s>", "</s> <unk>", "<|endoftext|>", "<0x41>", "\x00", "é日本",
    "😀 😀", " x y", "ﬁ é Å", "don't 12 3.5%", "a" * 3000, "🙂" * 50, "ab" * 2000 + " c", "\r\n\r\n", "ñ ciónñas", "​﻿ z",
]
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("shard", [1 << 24, 300])
def test_counts_equal_plain_loops(spark, shard):
    texts = [*ODD, *mixed_texts(8, 80)]
    docs = frame(spark, texts).repartition(3).unionByName(frame(spark, texts[20:40]))
    found = alignment.linked_counts(docs, file_a=A, file_b=B, shard_bytes=shard)
    expected = plain_counts([*enumerate(texts), *enumerate(texts[20:40])])
    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect()), key=str) == expected


def test_chunks_encode_as_whole_texts():
    rng = random.Random(2)
    parts = [" ", "  ", "   ", "\n", "\t", "a", "the", "Straße", "é", "日本", "😀", "<s>", "▁", "'s", "12", " ", "\x85", "x" * 30, " " * 40, "</s>", "."]
    own = alignment.PieceTokenizer(B)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    for text, ids in zip(texts, own.encode_all(texts), strict=True):
        expected = plain_tokens(text)[1]
        assert (ids.tolist() if ids is not None else []) == expected


def test_memory_of_chunks_is_emptied(monkeypatch):
    monkeypatch.setattr(alignment, "MEMO_CHARS", 50)
    own, texts = alignment.PieceTokenizer(B), [t for t in mixed_texts(9, 60) if t]
    for k in range(0, len(texts), 5):
        assert [i.tolist() for i in own.encode_all(texts[k : k + 5])] == [PIECES.encode(t) for t in texts[k : k + 5]]


def test_large_groups_are_expanded_in_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 50, 400), rng.integers(0, 40, 300)
    cut_a, cut_b = np.array([1, 3, 200, 380, 400]), np.array([1, 2, 150, 152, 300])
    plain = collections.Counter()
    for k in range(5):
        x, y = a[cut_a[k - 1] if k else 0 : cut_a[k]], b[cut_b[k - 1] if k else 0 : cut_b[k]]
        plain.update((int(i) << 32 | int(j)) for i in x for j in y)
    for limit in (1, 30, 3000, 1 << 20):
        monkeypatch.setattr(alignment, "LINKS", limit)
        codes, links = alignment.expanded(alignment.Alignment(a, b, cut_a, cut_b))
        assert list(zip(codes.tolist(), links.tolist(), strict=True)) == sorted(plain.items())


def test_groups_of_a_text(spark):
    texts = ["Hello wörld, 日本", None, "a▁b"]
    rows = {r["doc_id"]: r for r in alignment.alignments(frame(spark, texts), file_a=A, file_b=B).collect()}
    for k, text in enumerate(texts):
        r, groups = rows[k], plain_groups(text)
        cuts = zip([0, *r["cut_a"]], r["cut_a"], [0, *r["cut_b"]], r["cut_b"])
        assert [(r["a"][i:j], r["b"][m:n]) for i, j, m, n in cuts] == groups


def test_empty_table_and_null_identifiers(spark):
    docs = spark.createDataFrame([(None, "a b", 1), (None, None, 2)], "doc_id bigint, text string, shard int")
    found = alignment.linked_counts(docs, file_a=A, file_b=B).collect()
    assert sorted(map(tuple, found), key=str) == plain_counts([(None, "a b"), (None, None)])
    assert alignment.linked_counts(docs.limit(0), file_a=A, file_b=B).collect() == []


def test_query_equals_plain_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    found = catalog.op11_alignment(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, found), key=str) == plain_counts([(r["doc_id"], r["text"]) for r in docs])
