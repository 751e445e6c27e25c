"""SimHash fingerprints, links and groups against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from test_operators import UPPER, frame, mixed_texts

from rankarena.llm import catalog, simhash
from rankarena.llm.components import components


def plain_fingerprint(text, words=3):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if not found:
        return 0
    shingles = [" ".join(found[k : k + words]) for k in range(max(len(found) - words + 1, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_groups(points):
    """The least index that each point reaches by links."""
    group = list(range(len(points)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(points)):
        for b in range(a):
            if (points[a] ^ points[b]).bit_count() <= 2:
                low, high = sorted((root(a), root(b)))
                group[high] = low
    return [root(k) for k in range(len(points))]


def variants(seed, count, words=300):
    """Texts that are a few words apart, so that some of their fingerprints are a few bits apart."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(2000)}" for _ in range(words)]
    for _ in range(count):
        text = list(base)
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(words)] = f"x{rng.randrange(50)}"
        yield " ".join(text)


@pytest.mark.parametrize("cell_points", [2, 32])
def test_groups_equal_brute_force(spark, cell_points):
    texts = [*mixed_texts(3, 60), *variants(1, 60), *variants(2, 30), "a b", "A\tb", "a  b c", "\x0b", " ", "x" * 300_000, "y z " * 90_000]
    docs = frame(spark, texts).unionByName(frame(spark, texts[:9]))
    found = simhash.near_duplicates(docs, cell_points=cell_points).collect()
    points = [plain_fingerprint(t) for t in texts]
    assert sorted(r["fingerprint"] for r in found) == sorted(f"{p:016x}" for p in points + points[:9])
    groups = plain_groups(points)
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == sorted(list(enumerate(groups)) + list(enumerate(groups))[:9])
    assert 40 < sum(g != k for k, g in enumerate(groups)) and 5 < len(set(points)) < len(points)


@pytest.mark.parametrize("cell_points", [3, 32])
def test_links_of_a_crowded_space(spark, cell_points):
    rng = random.Random(4)
    points = set()
    for base in (0, (1 << 64) - 1, rng.getrandbits(64)):
        for _ in range(150):
            point = base
            for _ in range(rng.randint(0, 4)):
                point ^= 1 << rng.randrange(64)
            points.add(point)
    signed = np.array(sorted(points), np.uint64).view(np.int64).tolist()
    links = simhash.links_between(spark.createDataFrame([(p,) for p in signed], "fp bigint"), cell_points=cell_points)
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    plain = plain_groups([p % (1 << 64) for p in signed])
    assert [roots.get(p, p) for p in signed] == [min(signed[k] for k, g in enumerate(plain) if g == own) for own in plain]
    assert all((r["u"] ^ r["v"]) % (1 << 64) != 0 and ((r["u"] ^ r["v"]) % (1 << 64)).bit_count() <= 2 for r in links.collect())


def test_long_texts_are_hashed_in_slices(monkeypatch):
    text = " \nAb ".join(mixed_texts(5, 40)[5:]) + "  "
    whole = plain_fingerprint(text)
    for size in (1, 7, 50, 1 << 20):
        monkeypatch.setattr(simhash, "SLICE_BYTES", size)
        assert simhash.fingerprint(text.encode()) % (1 << 64) == whole


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(None, "one two three four", 1), (7, "one two three four", 2), (None, None, 3), (None, "lone words here", 4)],
        "doc_id bigint, text string, fp int",
    )
    found = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert found == {(None, 7), (7, 7), (None, None)}
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    points = [plain_fingerprint(r["text"]) for r in docs]
    groups = plain_groups(points)
    expected = [(r["doc_id"], f"{p:016x}", docs[g]["doc_id"]) for r, p, g in zip(docs, points, groups, strict=True)]
    found = catalog.op12_simhash(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in found) == expected
