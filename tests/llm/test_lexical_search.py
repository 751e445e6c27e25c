"""Ranked lexical search against plain sums over all documents."""

import collections
import math
import re

import duckdb
import numpy as np
import pytest
from test_operators import UPPER, frame, mixed_texts

from rankarena.llm import catalog, lexical_search

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    return re.findall(TERM, (text or "").translate(UPPER))


def plain_search(docs, items, top):
    """Sorted (item, rank, doc_id, score); docs and items are (id, text)."""
    counts = [(i, collections.Counter(terms(t))) for i, t in docs]
    total_docs, total = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = collections.Counter(w for _, c in counts for w in c)
    asked = collections.defaultdict(set)
    for item, text in items:
        asked[item].update(terms(text))
    found = []
    for item, words in asked.items():
        scored = []
        for i, c in counts:
            m = 50 + 50 * c.total() * total_docs // total if c else 0
            score = sum(
                math.floor(1000 * math.log((2 * total_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 20 * m))
                for w in words if c[w]
            )
            if score > 0:
                scored.append((-score, i is None, i or 0))
        found += [(item, k, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(found, key=str)


def searched(spark, docs, items, **options):
    doc_rows = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, rank string")
    item_rows = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id string, text string, score int")
    found = lexical_search.ranked_search(doc_rows.repartition(3), item_rows, **options)
    return sorted(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize(("top", "shard", "postings", "asked"), [(50, 1 << 20, 128, 1000), (3, 2000, 4, 20), (1, 600, 1, 5)])
def test_search_equals_plain_sums(spark, top, shard, postings, asked):
    texts = mixed_texts(6, 240) + ["x1 " * 30_000 + "w3"]
    docs = [*enumerate(texts), *[(k, texts[k]) for k in range(8, 30)], (None, texts[9]), (None, texts[9]), (None, texts[40])]
    items = [("a", "w1 W2 w3 the"), ("b", "w3 and and é"), ("b", "日本 w9"), ("c", "nowhere"), ("d", None), (None, "zz w17"), ("e", "OF the w1 w4 w5 w6 w7")]
    found = searched(spark, docs, items, top=top, shard_bytes=shard, block_postings=postings, asked_terms=asked)
    assert found == plain_search(docs, items, top)


def test_empty_tables(spark):
    assert searched(spark, [], [("a", "w1")]) == []
    assert searched(spark, [(1, None), (2, "--")], [("a", "w1")]) == []
    assert searched(spark, [(1, "w1")], []) == []
    assert searched(spark, [(1, "w1")], [("a", " "), ("b", None)]) == []


def test_blocks_hold_their_postings():
    rng = np.random.default_rng(1)
    for high in (1, 200, 70_000, 1 << 40):
        gaps, counts = rng.integers(1, high + 1, 50), rng.integers(1, 300, 50)
        docs, tf = lexical_search.unpack_block(lexical_search.pack_block(gaps, counts), 6)
        assert docs.tolist() == (6 + np.cumsum(gaps)).tolist()
        assert tf.tolist() == counts.tolist()


def test_blocks_without_candidates_stay_packed(spark, monkeypatch):
    """A rare term finds the documents; of a common one's list only their blocks are unpacked."""
    unpacked = []
    plain = lexical_search.unpack_block
    monkeypatch.setattr(lexical_search, "unpack_block", lambda *a: unpacked.append(1) or plain(*a))
    texts = [f"common filler{k} " + "rare " * (k % 500 == 0) for k in range(4000)]
    docs = frame(spark, texts).coalesce(1)
    hashes, _ = lexical_search.terms_of(lexical_search.pa.array(["common rare"]))
    asked = lexical_search.Asked(np.sort(hashes), [np.array([0, 1])])
    index = lexical_search.build_index(docs, asked)
    n_docs, n_terms, weights = lexical_search.corpus_statistics(index, asked)
    row = index.drop("shard", "n_docs", "n_terms").toArrow().to_batches()[0]
    shard = lexical_search.Shard({n: row.column(n)[0] for n in row.schema.names}, asked, weights, n_docs, n_terms)
    docs, scores = shard.best(asked.items[0], 8, 0)
    assert docs.tolist() == list(range(0, 4000, 500)) and len(set(scores.tolist())) >= 1
    assert len(unpacked) <= 9 < shard.first_block[-1]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('/root/testdata/{sf}/{name}.parquet')")
    expected = sorted(con.execute(catalog.SQL["op13_lexical_search"]).fetchall())
    found = catalog.op13_lexical_search(spark, f"/root/testdata/{sf}")
    assert sorted(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect())) == expected
    assert len(expected) > 100
