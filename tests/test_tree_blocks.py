"""Scoring by blocks of masks against walking each tree."""

import math
import random

import numpy as np
import pytest

from rankarena import schema
from rankarena.operators import ensemble, tree_blocks


def random_tree(rng, tree, leaves, chain=False):
    """Nodes of a tree whose numbers are not in order."""
    nodes, open_leaves, free = {}, [0], iter(rng.sample(range(1, 10 * leaves + 10), 2 * leaves))
    while len(open_leaves) < leaves:
        node = open_leaves.pop(-1 if chain else rng.randrange(len(open_leaves)))
        left, right = next(free), next(free)
        nodes[node] = (tree, node, rng.choice([1, 3, 7]), rng.choice([rng.random(), 0.5, 0.25]), left, right, None)
        open_leaves += [left, right]
    for node in open_leaves:
        nodes[node] = (tree, node, None, None, None, None, rng.uniform(-1, 1))
    return list(nodes.values())


def feature_rows(rng, count):
    values = [0.5, 0.25, None, math.nan, math.inf, -math.inf]
    for k in range(count):
        yield (f"d{k % (count - 2)}", *[rng.choice(values) if rng.random() < 0.3 else rng.random() for _ in range(3)])


@pytest.mark.parametrize(("seed", "sizes", "block_bytes", "masked"), [
    (1, [1, 2, 5, 64, 65, 130], 1 << 24, 2048),
    (2, [30] * 70, 2000, 2048),
    (3, [1, 300, 40, 1, 200, 7], 1 << 24, 100),
    (4, [3], 1 << 24, 1),
])
def test_blocks_score_as_arrays_do(spark, monkeypatch, seed, sizes, block_bytes, masked):
    rng = random.Random(seed)
    nodes = [n for k, size in enumerate(sizes) for n in random_tree(rng, 3 * k - 5, size, chain=k % 3 == 2)]
    rng.shuffle(nodes)
    model = spark.createDataFrame(nodes, schema.TREE_ENSEMBLE).repartition(3)
    rows = spark.createDataFrame(list(feature_rows(rng, 200)), "docno string, f1 double, f3 double, f7 double")
    found = [sorted(map(tuple, ensemble.score_ensemble(rows, model, keep=["docno"], strategy=s).collect())) for s in ("arrays", "blocks")]
    assert found[0] == found[1]
    # The same with small blocks, without Spark.
    monkeypatch.setattr(tree_blocks, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(tree_blocks, "MASKED_LEAVES", masked)
    collected = rows.collect()
    columns = {f: np.array([math.nan if r[f"f{f}"] is None else r[f"f{f}"] for r in collected]) for f in (1, 3, 7)}
    total = np.zeros(len(collected))
    parts = list(tree_blocks.packed_trees([dict(zip(schema.TREE_ENSEMBLE.names, n, strict=True)) for n in nodes]))
    for part in parts:
        part.prepared().add(columns, total)
    assert sorted((r["docno"], s) for r, s in zip(collected, total.tolist(), strict=True)) == found[0]
    assert {type(p) for p in parts} >= ({tree_blocks.WalkedTree} if max(sizes) > masked else {tree_blocks.MaskedTrees})


def test_a_large_model_is_scored_by_blocks(spark):
    rng = random.Random(9)
    nodes = [n for k in range(200) for n in random_tree(rng, k, 8)]
    model = spark.createDataFrame(nodes, schema.TREE_ENSEMBLE)
    rows = spark.createDataFrame(list(feature_rows(rng, 50)), "docno string, f1 double, f3 double, f7 double")
    plan = ensemble.score_ensemble(rows, model, keep=["docno"], max_nodes=100)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in text and "Join" not in text and "Generate" not in text
    assert sorted(map(tuple, plan.collect())) == sorted(map(tuple, ensemble.score_ensemble(rows, model, keep=["docno"]).collect()))


def test_empty_model_and_no_rows(spark):
    model = spark.createDataFrame([], schema.TREE_ENSEMBLE)
    rows = spark.createDataFrame([("d", 0.5)], "docno string, f1 double")
    assert [tuple(r) for r in ensemble.score_ensemble(rows, model, keep=["docno"], strategy="blocks").collect()] == [("d", 0.0)]
    one = spark.createDataFrame([(0, 0, None, None, None, None, 2.5)], schema.TREE_ENSEMBLE)
    assert [tuple(r) for r in ensemble.score_ensemble(rows, one, keep=["docno"], strategy="blocks").collect()] == [("d", 2.5)]
    assert ensemble.score_ensemble(rows.limit(0), one, keep=["docno"], strategy="blocks").collect() == []
    with pytest.raises(ValueError, match="f3"):
        ensemble.score_ensemble(rows, spark.createDataFrame(random_tree(random.Random(1), 0, 9) + random_tree(random.Random(5), 1, 9), schema.TREE_ENSEMBLE), keep=["docno"], strategy="blocks")
