"""Scoring rows with a stored tree ensemble.

A model is a table ``(tree, node, feature, threshold, left, right, value)``. Node 0 is the root of a tree, a row
goes left where its feature is at most the threshold, and nodes without children are leaves with a value.
"""

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from rankarena.operators.tree_blocks import score_by_blocks
from rankarena.sources.scratch import written

MAX_NODES = 1_000_000
_MAX_CASE_NODES = 1_000


def score_ensemble(
    features: DataFrame,
    model: DataFrame,
    *,
    keep: list[str],
    strategy: str = "auto",
    max_nodes: int = MAX_NODES,
) -> DataFrame:
    """``keep`` columns plus ``score``, the sum of the leaf values over all trees in the order of their numbers.

    All strategies give the same rows: one per input row, repeated rows included, with score 0 for an empty model. A
    null or NaN feature goes right. A feature that the model asks for and the rows lack is an error.

    A small model becomes one native expression, a larger one arrays that go to the tasks. Only up to ``max_nodes`` nodes
    are fetched for that; a model beyond them stays a table, of which tasks read a block of trees at a time. Walking it
    by joins, a row for each row and tree, takes no Python but much more work, so it must be asked for.
    """
    if strategy not in ("auto", "case", "arrays", "blocks", "joins"):
        raise ValueError(f"unknown strategy {strategy!r}")
    nodes: list[Row] = []
    if strategy not in ("blocks", "joins"):
        nodes = model.limit(max_nodes + 1).collect()
    stays = strategy in ("blocks", "joins") or len(nodes) > max_nodes
    if stays:
        # One more than there are columns: enough to find one that is missing.
        asked = model.where(F.col("left").isNotNull()).select("feature").distinct().limit(len(features.columns) + 1)
        used = sorted(r["feature"] for r in asked.collect())
    else:
        used = sorted({n.feature for n in nodes if n.left is not None})
    missing = [f"f{f}" for f in used if f"f{f}" not in features.columns]
    if missing:
        raise ValueError(f"the model asks for features that the rows lack: {', '.join(missing)}")
    if strategy == "joins":
        return _walk_by_joins(features, model, keep, used)
    if stays:
        return score_by_blocks(features, model, keep=keep, used=used)
    if strategy == "case" or (strategy == "auto" and len(nodes) <= _MAX_CASE_NODES):
        return features.select(*keep, _case_score(nodes).alias("score"))
    return features.select(*keep, _array_score(nodes).alias("score"))


def _case_score(nodes: list[Row]) -> Column:
    by_place = {(n.tree, n.node): n for n in nodes}

    def below(tree: int, node: int) -> Column:
        n = by_place[(tree, node)]
        if n.left is None:
            return F.lit(float(n.value))
        goes_left = F.col(f"f{n.feature}") <= n.threshold
        return F.when(goes_left, below(tree, n.left)).otherwise(below(tree, n.right))

    score = F.lit(0.0)
    for tree in sorted({n.tree for n in nodes}):
        score = score + below(tree, 0)
    return score


def _array_score(nodes: list[Row]) -> Column:
    nodes = sorted(nodes, key=lambda n: (n.tree, n.node))
    place = {(n.tree, n.node): i for i, n in enumerate(nodes)}
    used = sorted({n.feature for n in nodes if n.left is not None})
    column = {feature: i for i, feature in enumerate(used)}
    leaf = np.array([n.left is None for n in nodes])
    # Leaves lead to themselves, so rows may take further steps without harm.
    left = np.array([i if n.left is None else place[(n.tree, n.left)] for i, n in enumerate(nodes)])
    right = np.array([i if n.left is None else place[(n.tree, n.right)] for i, n in enumerate(nodes)])
    feature = np.array([0 if n.left is None else column[n.feature] for n in nodes])
    threshold = np.array([0.0 if n.left is None else n.threshold for n in nodes])
    value = np.array([n.value if n.left is None else 0.0 for n in nodes])
    roots = [place[(tree, 0)] for tree in sorted({n.tree for n in nodes})]

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            # With a single input column Spark hands over the series itself.
            columns = batch if isinstance(batch, tuple) else (batch,)
            x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            rows = np.arange(len(x))
            total = np.zeros(len(x))
            for root in roots:
                at = np.full(len(x), root)
                while not leaf[at].all():
                    at = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
                total += value[at]
            yield pd.Series(total)

    inputs = [F.col(f"f{f}").cast("double") for f in used] or [F.lit(0.0)]
    return score(*inputs)


def _depth(inner: DataFrame) -> int:
    """Steps from the roots to the deepest leaf."""
    level = inner.where(F.col("node") == 0).select("tree", "left", "right")
    depth = 0
    while not level.isEmpty():
        depth += 1
        children = level.select("tree", F.explode(F.array("left", "right")).alias("node"))
        level = written(inner.join(children, ["tree", "node"]).select("tree", "left", "right"), "tree-level")
    return depth


def _walk_by_joins(features: DataFrame, model: DataFrame, keep: list[str], used: list[int]) -> DataFrame:
    """One row per (input row, tree) which moves down a level with each join.

    Rows that are alike in all columns used walk together and are told apart again at the end.
    """
    inner = written(model.where(F.col("left").isNotNull()).drop("value"), "tree-nodes")
    trees = model.where(F.col("node") == 0).agg(F.sort_array(F.collect_set("tree"))).scalar()
    values = F.array(*[F.col(f"f{f}").cast("double") for f in used]).cast("array<double>")
    alike = features.select(*keep, values.alias("_x")).groupBy(*keep, "_x").agg(F.count(F.lit(1)).alias("_n"))
    at = alike.select(*keep, "_x", "_n", F.explode_outer(trees).alias("tree")).withColumn("node", F.lit(0))
    # Where a feature stands in the array.
    place = F.array_position(F.array(*[F.lit(f) for f in used]).cast("array<int>"), F.col("feature").cast("int"))
    for _ in range(_depth(inner)):
        goes_left = F.try_element_at("_x", place.cast("int")) <= F.col("threshold")
        at = at.join(inner, ["tree", "node"], "left").select(
            *keep,
            "_x",
            "_n",
            "tree",
            F.when(F.col("left").isNull(), F.col("node"))
            .when(goes_left, F.col("left"))
            .otherwise(F.col("right"))
            .alias("node"),
        )
    leaves = model.where(F.col("left").isNull()).select("tree", "node", "value")
    # One entry a tree, added up in the order of the trees.
    found = at.join(leaves, ["tree", "node"], "left").groupBy(*keep, "_x", "_n").agg(
        F.sort_array(F.collect_list(F.struct("tree", F.coalesce("value", F.lit(0.0)).alias("value")))).alias("_values")
    )
    score = F.aggregate("_values", F.lit(0.0), lambda total, v: total + v["value"])
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n")))
    return found.select(*keep, score.alias("score"), copies.alias("_copy")).drop("_copy")
