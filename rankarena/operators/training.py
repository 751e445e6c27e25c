"""Training of tree ensembles for ranking: histogram boosting with pairwise gradients of the fields.

A row goes into a bin of each feature once. For each tree the pairs of a field that can change its NDCG at ``top`` give
gradients: each row meets the ``top`` best rows of its field, which are found before anything is sent, so no field is ever
in one task and no list of all pairs is made. Trees grow level by level: tasks add up gradients by node, feature and bin,
and only these sums, whose number depends on the parameters alone, come to the driver, which chooses the splits.

Gradients are added as whole numbers (multiples of 2**-32), so a tree doesn't depend on the order of sums or on tasks
that run again. The model is the table that :func:`rankarena.operators.ensemble.score_ensemble` scores.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankarena import schema
from rankarena.sources.scratch import written

_UNIT = float(1 << 32)
_SUMS = "node int, feature int, bin int, g bigint, h bigint, n bigint"


@dataclass(frozen=True)
class Settings:
    trees: int = 50
    depth: int = 4
    bins: int = 63
    learning_rate: float = 0.1
    #: NDCG is looked at down to this rank.
    top: int = 10
    #: Rows that each side of a split needs.
    least_rows: int = 20
    #: Added to the sum of second derivatives; large values make small steps.
    l2: float = 1.0


@dataclass
class Tree:
    """Nodes by number; an inner one has (feature place, bin, left, right), a leaf its value."""

    inner: dict[int, tuple[int, int, int, int]] = field(default_factory=dict)
    value: dict[int, float] = field(default_factory=dict)

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row, a row of bins, has come to."""
        at = np.zeros(len(bins), np.int32)
        for node in sorted(self.inner):
            place, last, left, right = self.inner[node]
            here = at == node
            at[here] = np.where(bins[here, place] <= last, left, right)
        return at


def feature_names(rows: DataFrame) -> list[str]:
    return [c for c in schema.FEATURE_COLUMNS if c in rows.columns]


def bin_edges(rows: DataFrame, names: list[str], bins: int) -> list[np.ndarray]:
    """Thresholds of each feature, ascending, at shares of its values; at most ``bins`` of them."""
    shares = F.array(*[F.lit((k + 0.5) / bins) for k in range(bins)])

    def edges(name: str) -> Column:
        value = F.col(name).cast("double")
        return F.percentile_approx(F.when(~F.isnan(value), value), shares, 50 * bins).alias(name)

    found = rows.agg(*[edges(n) for n in names]).first()
    return [np.unique(np.array(found[n] or [], float)) for n in names]


def binned(rows: DataFrame, names: list[str], edges: list[np.ndarray], keep: list[str]) -> DataFrame:
    """``keep`` and ``bins``: for each feature how many of its thresholds are under the value. Null and NaN are over all."""
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Sorting puts NaN last, as it goes right in every tree.
            values = (batch.column(n).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) for n in names)
            found = np.column_stack([np.searchsorted(e, v) for e, v in zip(edges, values, strict=True)]).astype(np.int16)
            cuts = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(names))
            lists = pa.ListArray.from_arrays(cuts, pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], lists], [*keep, "bins"])

    return rows.select(*keep, *names).mapInArrow(run, f"{kinds}, bins array<smallint>")


def _gain(label: Column) -> Column:
    return F.pow(F.lit(2.0), label) - 1


def _discount(rank: Column) -> Column:
    return 1 / F.log2(rank + 1)


def _best_rows(rows: DataFrame, scope: list[str], order: list[Column], top: int) -> DataFrame:
    """The first ``top`` rows of each scope with their ``rank``; tasks send no more than that of a scope."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*scope).orderBy(*order)))
    return ranked.where(F.col("rank") <= top)


def ideal_gains(rows: DataFrame, *, scope_cols: list[str], label_col: str = "label", top: int = 10) -> DataFrame:
    """(scope, ideal): the highest discounted gain that a field can have."""
    best = _best_rows(rows.select(*scope_cols, F.col(label_col).alias("_label")), scope_cols, [F.desc("_label")], top)
    return best.groupBy(*scope_cols).agg(F.sum(_gain(F.col("_label")) * _discount(F.col("rank"))).alias("ideal"))


def ndcg(
    scored: DataFrame, *, scope_cols: list[str], label_col: str = "label", score_col: str = "score", id_col: str = "docno", top: int = 10
) -> DataFrame:
    """(scope, ndcg) of each field that has any gain. Equal scores go by identifier; a null score comes last."""
    rows = scored.select(*scope_cols, F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), F.col(score_col).alias("_score"))
    best = _best_rows(rows, scope_cols, [F.desc_nulls_last("_score"), F.asc("_id")], top)
    reached = best.groupBy(*scope_cols).agg(F.sum(_gain(F.col("_label")) * _discount(F.col("rank"))).alias("gain"))
    ideal = ideal_gains(rows, scope_cols=scope_cols, label_col="_label", top=top).where("ideal > 0")
    return reached.join(ideal, scope_cols).select(*scope_cols, (F.col("gain") / F.col("ideal")).alias("ndcg"))


def gradients(state: DataFrame, *, scope_cols: list[str], top: int) -> DataFrame:
    """(scope, docno, g, h): sums over the pairs of each row, as whole numbers; rows without pairs are left out.

    ``state`` has the scope, ``docno``, ``label``, ``score`` and ``ideal``. A pair counts if one of both is among the ``top``
    best and their labels differ. It pulls the better one up and the worse one down, by how much their exchange would change NDCG.
    """
    entry = F.struct("rank", "docno", "label", "score")
    ranked = _best_rows(state.select(*scope_cols, "docno", "label", "score"), scope_cols, [F.desc("score"), F.asc("docno")], top)
    best = ranked.groupBy(*scope_cols).agg(F.sort_array(F.collect_list(entry)).alias("best"))
    met = state.where("ideal > 0").select(*scope_cols, "docno", "label", "score", "ideal").join(best, scope_cols)
    own = F.get(F.filter("best", lambda b: b["docno"] == F.col("docno")), 0)["rank"]
    pairs = met.select("*", own.alias("own")).select(*scope_cols, "docno", "label", "score", "ideal", "own", F.explode("best").alias("b"))
    # Of two of the best each pair is taken once, from the lower one.
    pairs = pairs.where((F.col("b.label") != F.col("label")) & (F.col("own").isNull() | (F.col("b.rank") < F.col("own"))))
    side = F.signum(F.col("label") - F.col("b.label"))
    moved = F.abs(_discount(F.col("b.rank")) - F.coalesce(_discount(F.col("own")), F.lit(0.0)))
    weight = F.abs(_gain(F.col("label")) - _gain(F.col("b.label"))) * moved / F.col("ideal")
    wrong = 1 / (1 + F.exp(side * (F.col("score") - F.col("b.score"))))
    pulled = pairs.select(
        *scope_cols, "docno", F.col("b.docno").alias("other"),
        F.round(side * weight * wrong * _UNIT).cast("bigint").alias("g"),
        F.round(weight * wrong * (1 - wrong) * _UNIT).cast("bigint").alias("h"),
    )
    both = F.explode(F.array(F.struct("docno", "g", "h"), F.struct(F.col("other").alias("docno"), (-F.col("g")).alias("g"), "h"))).alias("p")
    return pulled.select(*scope_cols, both).groupBy(*scope_cols, "p.docno").agg(F.sum("p.g").alias("g"), F.sum("p.h").alias("h"))


def level_sums(state: DataFrame, tree: Tree, wanted: set[int], n_bins: int) -> DataFrame:
    """Sums of gradients by node, feature and bin, over the rows that have come to one of the ``wanted`` nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = np.array(sorted(wanted))
        sums: np.ndarray | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = batch.column("bins").flatten().to_numpy().reshape(batch.num_rows, -1)
            at = tree.leaf_of(bins)
            place = np.searchsorted(nodes, at)
            inside = np.isin(at, nodes)
            width = bins.shape[1]
            shape = (len(nodes), width, n_bins)
            if sums is None:
                sums = np.zeros((3, *shape), np.int64)
            cell = (place[inside, None] * width + np.arange(width)) * n_bins + bins[inside]
            for k, values in enumerate((batch.column("g").to_numpy()[inside], batch.column("h").to_numpy()[inside], np.ones(int(inside.sum()), np.int64))):
                np.add.at(sums[k].reshape(-1), cell.ravel(), np.repeat(values, width))
        if sums is not None:
            node, feature, bin_ = np.nonzero(sums[2])
            columns = [nodes[node].astype(np.int32), feature.astype(np.int32), bin_.astype(np.int32), *(s[node, feature, bin_] for s in sums)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "feature", "bin", "g", "h", "n"])

    parts = state.select("bins", "g", "h").mapInArrow(run, _SUMS)
    return parts.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))


def best_split(sums: np.ndarray, settings: Settings) -> tuple[float, int, int] | None:
    """(improvement, feature place, last bin that goes left) of a node, or nothing. ``sums`` are (g, h, n) by feature and bin.

    Of equal improvements the first feature and the lowest bin count.
    """
    left = np.cumsum(sums, axis=2)[:, :, :-1].astype(float)
    whole = sums.sum(axis=2)[:, :, None].astype(float)
    right = whole - left

    def strength(part: np.ndarray) -> np.ndarray:
        return (part[0] / _UNIT) ** 2 / (part[1] / _UNIT + settings.l2)

    gain = strength(left) + strength(right) - strength(whole)
    gain[(left[2] < settings.least_rows) | (right[2] < settings.least_rows)] = -np.inf
    if not gain.size or gain.max() <= 1e-12:
        return None
    place, last = np.unravel_index(int(gain.argmax()), gain.shape)
    return float(gain[place, last]), int(place), int(last)


def grow_tree(state: DataFrame, n_features: int, n_bins: int, settings: Settings) -> Tree:
    """One tree over rows with ``bins``, ``g`` and ``h``, level by level."""
    tree, level, number = Tree(), {0}, 1
    for depth in range(settings.depth + 1):
        found = level_sums(state, tree, level, n_bins).toArrow()
        node, feature, bin_ = (found.column(c).to_numpy() for c in ("node", "feature", "bin"))
        values = np.array([found.column(c).to_numpy() for c in ("g", "h", "n")])
        next_level = set()
        for k in sorted(level):
            mine = node == k
            sums = np.zeros((3, n_features, n_bins), np.int64)
            sums[:, feature[mine], bin_[mine]] = values[:, mine]
            g, h, _ = sums[:, 0].sum(axis=1) / _UNIT
            tree.value[k] = settings.learning_rate * g / (h + settings.l2)
            split = best_split(sums, settings) if depth < settings.depth else None
            if split:
                tree.inner[k] = (split[1], split[2], number, number + 1)
                next_level |= {number, number + 1}
                number += 2
        level = next_level
        if not level:
            break
    return tree


def _tree_score(tree: Tree) -> Column:
    def below(node: int) -> Column:
        if node not in tree.inner:
            return F.lit(float(tree.value[node]))
        place, last, left, right = tree.inner[node]
        return F.when(F.get("bins", F.lit(place)) <= last, below(left)).otherwise(below(right))

    return below(0)


def train_ensemble(
    rows: DataFrame, *, scope_cols: list[str], label_col: str = "label", settings: Settings | None = None
) -> DataFrame:
    """A model for rows with the scope (a field), ``docno``, a label and features f1, f2, …

    Scope and docno must identify a row; a null label counts as 0. Training ends early once no split improves anything.
    Without rows, or where no field has different labels, the model is empty.
    """
    settings = settings or Settings()
    names = feature_names(rows)
    keys = [*scope_cols, "docno"]
    if not names:
        raise ValueError("the rows have no features")
    labelled = rows.withColumn("label", F.coalesce(F.col(label_col).cast("double"), F.lit(0.0)))
    edges = bin_edges(labelled, names, settings.bins)
    base = written(binned(labelled, names, edges, [*keys, "label"]), "binned")
    if not base.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError("scope and docno must identify a row")
    ideal = ideal_gains(base, scope_cols=scope_cols, top=settings.top)
    state = base.join(ideal, scope_cols).withColumn("score", F.lit(0.0))
    n_bins = 1 + max(map(len, edges))
    nodes = []
    for number in range(settings.trees):
        state = written(state, "training")
        pulled = gradients(state, scope_cols=scope_cols, top=settings.top)
        zero = F.lit(0).cast("bigint")
        drawn = state.join(pulled, keys, "left").withColumns({c: F.coalesce(c, zero) for c in ("g", "h")})
        drawn = written(drawn, "gradients")
        tree = grow_tree(drawn, len(names), n_bins, settings)
        if not tree.inner:
            break
        for k in sorted(tree.value):
            if k in tree.inner:
                place, last, left, right = tree.inner[k]
                nodes.append((number, k, int(names[place][1:]), float(edges[place][last]), left, right, None))
            else:
                nodes.append((number, k, None, None, None, None, float(tree.value[k])))
        state = drawn.select(*keys, "label", "bins", "ideal", (F.col("score") + _tree_score(tree)).alias("score"))
    return rows.sparkSession.createDataFrame(nodes, schema.TREE_ENSEMBLE)
