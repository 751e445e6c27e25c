"""Scoring rows with tree ensembles of any size, block by block of trees and without joins.

Leaves of a tree are numbered from the left, and each inner node has a mask of bits that clears the leaves on its left. A
row goes right at all nodes of a feature whose thresholds are under its value: sorted by threshold these come first. So for
each feature the masks of the first k nodes are put together once, for all k, and a row finds its k by bisection; what is
left after all features is put together has the row's leaf as lowest bit. No node is visited row by row.

Blocks are rows of a table in the shared folder. A task holds some rows and one block at a time, so neither rows times trees
nor the whole model are ever in one place.
"""

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankarena.sources.scratch import scratch_path

#: Trees that are packed together.
BLOCK_TREES = 64
#: Bytes of masks that a task holds; a block with more is cut into parts.
BLOCK_BYTES = 16 << 20
#: A tree of more leaves is walked, as the masks of a tree take the square of its leaves.
MASKED_LEAVES = 2048
#: Rows that a task holds while it goes through the blocks.
HELD_ROWS = 1 << 17
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass
class MaskedTrees:
    """Some trees: for each feature its thresholds in order, with the tree and the mask of each."""

    nodes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    values: np.ndarray

    def prepared(self) -> "MaskedTrees":
        """With the masks of the first k nodes of each feature, by tree."""
        words = next((m.shape[1] for _, _, m in self.nodes.values()), 1)
        self.first: dict[int, np.ndarray] = {}
        for feature, (thresholds, trees, masks) in self.nodes.items():
            first = np.full((len(thresholds) + 1, len(self.values), words), _ALL)
            for k, (tree, mask) in enumerate(zip(trees, masks, strict=True)):
                first[k + 1] = first[k]
                first[k + 1, tree] &= mask
            self.first[feature] = first
        self.words = words
        return self

    def add(self, columns: dict[int, np.ndarray], total: np.ndarray) -> None:
        """Add the values of all trees to ``total``, tree by tree."""
        step = max(1, (1 << 20) // (len(self.values) * self.words))
        for start in range(0, len(total), step):
            part = slice(start, start + step)
            left = np.full((len(total[part]), len(self.values), self.words), _ALL)
            for feature, first in self.first.items():
                # Thresholds under the value; NaN is over all.
                left &= first[np.searchsorted(self.nodes[feature][0], columns[feature][part])]
            word = (left != 0).argmax(axis=2)
            lowest = np.take_along_axis(left, word[:, :, None], axis=2)[:, :, 0]
            leaf = word * 64 + np.bitwise_count((lowest & (~lowest + np.uint64(1))) - np.uint64(1))
            found = self.values[np.arange(len(self.values)), leaf]
            for tree in range(len(self.values)):
                total[part] += found[:, tree]


@dataclass
class WalkedTree:
    """A tree as arrays; leaves lead to themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    leaf: np.ndarray

    def prepared(self) -> "WalkedTree":
        return self

    def add(self, columns: dict[int, np.ndarray], total: np.ndarray) -> None:
        at = np.zeros(len(total), np.int64)
        open_rows = np.arange(len(total)) if not self.leaf[0] else np.zeros(0, np.int64)
        while len(open_rows):
            node = at[open_rows]
            for feature in np.unique(self.feature[node]).tolist():
                rows = open_rows[self.feature[node] == feature]
                here = at[rows]
                at[rows] = np.where(columns[feature][rows] <= self.threshold[here], self.left[here], self.right[here])
            open_rows = open_rows[~self.leaf[at[open_rows]]]
        total += self.value[at]


def _tree(nodes: dict[int, dict]) -> tuple[list[tuple[int, float, int, int]], list[float]]:
    """Inner nodes as (feature, threshold, first leaf on the left, first leaf on the right), and the leaves' values from the left."""
    inner, values = [], []
    # (node, place of the parent among the inner nodes, or None for what doesn't start a right side)
    stack: list[tuple[int, int | None]] = [(0, None)]
    while stack:
        number, parent = stack.pop()
        if parent is not None:
            feature, threshold, first, _ = inner[parent]
            inner[parent] = (feature, threshold, first, len(values))
        node = nodes[number]
        if node["left"] is None:
            values.append(node["value"])
        else:
            inner.append((node["feature"], node["threshold"], len(values), -1))
            stack += [(node["right"], len(inner) - 1), (node["left"], None)]
    return inner, values


def _walked(nodes: dict[int, dict]) -> WalkedTree:
    place = {n: k for k, n in enumerate(sorted(nodes, key=lambda n: (n != 0, n)))}
    rows = sorted(nodes.values(), key=lambda n: place[n["node"]])
    leaf = np.array([n["left"] is None for n in rows])

    def numbers(name: str, kind: type) -> np.ndarray:
        return np.array([n[name] if n[name] is not None else 0 for n in rows], kind)

    left = np.array([k if n["left"] is None else place[n["left"]] for k, n in enumerate(rows)])
    right = np.array([k if n["left"] is None else place[n["right"]] for k, n in enumerate(rows)])
    return WalkedTree(numbers("feature", int), numbers("threshold", float), left, right, numbers("value", float), leaf)


def _masked(trees: list[tuple[list[tuple[int, float, int, int]], list[float]]]) -> MaskedTrees:
    most = max(len(values) for _, values in trees)
    words = -(-most // 64)
    table = np.zeros((len(trees), most))
    found: dict[int, list[tuple[float, int, np.ndarray]]] = {}
    for k, (inner, values) in enumerate(trees):
        table[k, : len(values)] = values
        for feature, threshold, first, right in inner:
            bits = np.ones(64 * words, np.uint8)
            bits[first:right] = 0
            mask = np.packbits(bits, bitorder="little").view("<u8").astype(np.uint64)
            found.setdefault(feature, []).append((threshold, k, mask))
    nodes = {}
    for feature, rows in found.items():
        rows.sort(key=lambda r: r[0])
        nodes[feature] = (np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
    return MaskedTrees(nodes, table)


def packed_trees(rows: list[dict]) -> Iterator[MaskedTrees | WalkedTree]:
    """The trees of some nodes, in the order of their numbers, in parts of bounded size."""
    by_tree: dict[int, dict[int, dict]] = {}
    for row in rows:
        by_tree.setdefault(row["tree"], {})[row["node"]] = row
    held: list = []
    size = most = 0
    for _, nodes in sorted(by_tree.items()):
        leaves = (len(nodes) + 1) // 2
        large = leaves > MASKED_LEAVES
        # All nodes' masks, for each of the trees.
        after = (size + len(nodes)) * (len(held) + 1) * -(-max(most, leaves) // 64) * 8
        if held and (large or after > BLOCK_BYTES):
            yield _masked(held)
            held, size, most = [], 0, 0
        if large:
            yield _walked(nodes)
        else:
            held.append(_tree(nodes))
            size, most = size + len(nodes), max(most, leaves)
    if held:
        yield _masked(held)


def score_by_blocks(features: DataFrame, model: DataFrame, *, keep: list[str], used: list[int]) -> DataFrame:
    """``keep`` and ``score`` for each row; ``used`` are the features that the model asks for."""
    path = scratch_path(features.sparkSession, "trees")

    def pack(table: pa.Table) -> pa.Table:
        parts = [pickle.dumps(p) for p in packed_trees(table.drop_columns(["block"]).to_pylist())]
        block = pa.repeat(table.column("block")[0], len(parts))
        return pa.table({"block": block, "part": pa.array(range(len(parts)), pa.int64()), "body": pa.array(parts, pa.binary())})

    numbered = model.select("*", F.floor(F.col("tree") / BLOCK_TREES).cast("bigint").alias("block"))
    numbered.groupBy("block").applyInArrow(pack, "block bigint, part bigint, body binary").write.parquet(path)
    # Two numbers for each block of trees.
    order = [tuple(r) for r in features.sparkSession.read.parquet(path).select("block", "part").orderBy("block", "part").collect()]

    def blocks() -> Iterator[MaskedTrees | WalkedTree]:
        store, root = fs.FileSystem.from_uri(path)
        stored = dataset.dataset(root, filesystem=store, format="parquet")
        for block, part in order:
            chosen = (dataset.field("block") == block) & (dataset.field("part") == part)
            yield pickle.loads(stored.to_table(columns=["body"], filter=chosen).column("body")[0].as_py()).prepared()

    def scored(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        columns = {f: table.column(f"_f{f}").to_numpy() for f in used}
        total = np.zeros(table.num_rows)
        for block in blocks():
            block.add(columns, total)
        yield from table.select([f"_k{k}" for k in range(len(keep))]).append_column("score", pa.array(total)).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= HELD_ROWS:
                yield from scored(held)
                held = []
        if held:
            yield from scored(held)

    given = features.select(
        *[F.col(c).alias(f"_k{k}") for k, c in enumerate(keep)],
        *[F.coalesce(F.col(f"f{f}").cast("double"), F.lit(float("nan"))).alias(f"_f{f}") for f in used],
    )
    kinds = [f"_k{k} {given.schema[f'_k{k}'].dataType.simpleString()}" for k in range(len(keep))]
    found = given.mapInArrow(run, ", ".join([*kinds, "score double"]))
    return found.select(*[F.col(f"_k{k}").alias(c) for k, c in enumerate(keep)], "score")
