"""Token shards against plain packing: slots, order, offsets, owners."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from test_operators import frame, mixed_texts

from rankarena.llm import token_shards

FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def packed(docs, length):
    """(body, number of ids, owners) of each sequence of one task."""
    encode = token_shards.encoder(FILE).encode_ordinary
    ids, owner = [], []
    for i, text in docs:
        found = [*encode(text or ""), token_shards.SEPARATOR]
        ids += found
        owner += [(i, len(ids))] * len(found)
    for start in range(0, len(ids), length):
        some = ids[start : start + length]
        body = np.array(some + [token_shards.SEPARATOR] * (length - len(some)), "<u2").tobytes()
        inside = list(dict.fromkeys(owner[start : start + length]))
        yield body, len(some), [i for i, *_ in inside]


def written(spark, tmp_path, docs, parts, length, per_shard):
    rows = spark.createDataFrame(docs, "doc_id bigint, text string, slot string, body string") if docs else frame(spark, []).withColumnRenamed("row", "body")
    path = str(tmp_path / "shards")
    return path, token_shards.write_shards(rows.repartition(parts, "doc_id") if parts > 1 else rows.coalesce(1), path, file=FILE, length=length, per_shard=per_shard).collect()


@pytest.mark.parametrize("docs", [
    [(k, None) for k in range(16)],
    [(k, None) for k in range(17)],
    [(k, None) for k in range(32)],
    [(1, "w " * 15)],
    [(None, "a b c"), (None, None), (3, "x" * 2000), (4, ""), (3, "a b c")],
    list(enumerate(mixed_texts(3, 90))),
])
def test_sequences_equal_plain_packing(spark, tmp_path, docs):
    path, rows = written(spark, tmp_path, [(i, t, "s", "b") for i, t in docs], 1, 16, 5)
    plain = list(packed(docs, 16))
    slots = token_shards.slots_of(np.arange(len(plain)), len(plain)).tolist()
    assert sorted(slots) == list(range(len(plain)))
    found = {r["slot"]: r for r in rows}
    assert len(rows) == len(found) == len(plain)
    for slot, (body, count, owners) in zip(slots, plain, strict=True):
        r = found[slot]
        assert (r["shard"], r["offset"], r["n_tokens"], r["doc_ids"]) == (slot // 5, slot % 5 * 32, count, owners)
        assert r["sha256"] == hashlib.sha256(body).hexdigest()
        (ids,) = token_shards.read_slots(path, slot, 1, length=16, per_shard=5)
        assert ids.tobytes() == body


@pytest.mark.parametrize("rows", [0, 1, 3])
def test_partitions_without_rows(spark, tmp_path, rows):
    docs = [(k, "a b", "s", "b") for k in range(rows)]
    _, found = written(spark, tmp_path, docs, 4, 16, 2)
    assert sorted(i for r in found for i in r["doc_ids"]) == list(range(rows))


def test_slots_are_read_in_order_from_anywhere(spark, tmp_path):
    docs = [(k, t, "s", "b") for k, t in enumerate(mixed_texts(4, 120))]
    path, rows = written(spark, tmp_path, docs, 3, 32, 4)
    digests = [r["sha256"] for r in sorted(rows, key=lambda r: r["slot"])]
    for start, count in [(0, len(rows)), (3, 6), (len(rows) - 1, 1)]:
        read = [hashlib.sha256(x.tobytes()).hexdigest() for x in token_shards.read_slots(path, start, count, length=32, per_shard=4)]
        assert read == digests[start : start + count]
