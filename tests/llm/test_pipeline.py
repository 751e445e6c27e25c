"""The pipeline and each of its stages against plain versions, and the SQL twins of single operators."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from test_operators import UPPER, contamination_by_force, mixed_texts
from tokenizers import Tokenizer

import __spark_entry__
import check
import corpus_pipeline
from rankarena.llm import catalog, quality

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def copies_kept(docs):
    """Of equal texts the largest identifier."""
    last = {}
    for i, t in docs:
        body = (t or "").translate(UPPER)
        last[body] = max(i, last.get(body, i))
    return [(i, t) for i, t in docs if last[(t or "").translate(UPPER)] == i]


def near_kept(docs):
    """Of near copies the smallest identifier, by five words and 0.8."""
    sets = []
    for _, text in docs:
        words = (text or "").translate(UPPER).encode().split()
        sets.append({tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    least = [i for i, _ in docs]
    for _ in docs:
        for a in range(len(docs)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    least[a] = least[b] = min(least[a], least[b])
    return [(i, t) for (i, t), m in zip(docs, least, strict=True) if i == m]


def clean_kept(docs, items):
    kept = []
    for i, text in docs:
        words, hit, _ = contamination_by_force(text, items)
        if not (hit > 0 and 20 * hit >= words):
            kept.append((i, text))
    return kept


def plain_tokens(docs):
    ids = {i: np.array(LIBRARY.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for i, t in docs}
    return sorted((i, len(body) // 4, hashlib.sha256(body).hexdigest(), True) for i, body in ids.items())


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    texts = mixed_texts(11, 120)
    long = " ".join(rng.choice(texts[5:]) for _ in range(6))
    texts += [long, long + " tail", "#%&*QXZ$ " * 30, "word " * 80]
    benchmark = [(k, " ".join(rng.choice(texts[5:60]).split()[:20])) for k in range(4)] + [(9, None)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(k, t, "en" if k % 3 else None, "s", 1) for k, t in enumerate(texts)], COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(5, 110)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, list(enumerate(texts)), benchmark


def documents(spark, path):
    return spark.read.parquet(f"{path}/documents.parquet")


def test_stages_equal_plain_versions(spark, tables):
    path, docs, items = tables
    given = documents(spark, path)
    good = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.good_texts(spark, given, path).collect())
    kept = {r["doc_id"] for r in quality.classify(given, spark.read.parquet(f"{path}/labels.parquet")).where("kept").collect()}
    assert good == [d for d in docs if d[0] in kept] and len(good) < len(docs)
    for stage, plain in (
        (corpus_pipeline.different_texts, copies_kept(docs)),
        (corpus_pipeline.dissimilar_texts, near_kept(docs)),
        (corpus_pipeline.unseen_texts, clean_kept(docs, items)),
    ):
        found = stage(spark, given, path)
        assert found.columns == given.columns
        assert sorted((r["doc_id"], r["text"]) for r in found.collect()) == plain and len(plain) < len(docs)
    made = corpus_pipeline.tokens(spark, given, path).select("doc_id", "n_tokens", "ids_sha256", "decodes")
    assert sorted(map(tuple, made.collect())) == plain_tokens(docs)


def test_run_equals_the_plain_stages_in_turn(spark, tables):
    path, docs, items = tables
    labels = spark.read.parquet(f"{path}/labels.parquet")
    kept = {r["doc_id"] for r in quality.classify(documents(spark, path), labels).where("kept").collect()}
    plain = clean_kept(near_kept(copies_kept([d for d in docs if d[0] in kept])), items)
    found = corpus_pipeline.run(spark, path).select("doc_id", "n_tokens", "ids_sha256", "decodes").collect()
    assert sorted(map(tuple, found)) == plain_tokens(plain)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "benchmark", "tokens"]


def test_empty_tables(spark, tables, tmp_path):
    path, _, _ = tables
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_every_operator_is_registered(spark):
    names = __spark_entry__.queries()
    assert {m[0] for n in names if (m := re.match(r"op\d+(?=_)", n))} == {f"op{k}" for k in range(1, 14)} and "pipeline" in names
    assert set(catalog.SQL) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql_twins(spark, name):
    duck = check.duck("/root/testdata/sf0.001")
    sql = duck.sql(catalog.SQL[name])
    found = catalog.QUERIES[name](spark, "/root/testdata/sf0.001").select(*sql.columns)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, sql.fetchall()))


def test_batches_of_long_texts_are_small(spark):
    import pyarrow as pa

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "bytes": [batch.nbytes]})

    stage = corpus_pipeline.with_small_batches(lambda spark, docs, sf_dir: docs.mapInArrow(sizes, "n bigint, bytes bigint"))
    docs = spark.range(60).selectExpr("id AS doc_id", "repeat('x', 200000) AS text").coalesce(1)
    told = stage(spark, docs, "").collect()
    assert sum(r["n"] for r in told) == 60
    assert max(r["bytes"] for r in told) <= corpus_pipeline.BATCH_BYTES + 300_000
