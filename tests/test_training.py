"""Training of ensembles against plain loops over pairs and splits."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankarena.operators import ensemble, training
from rankarena.plans import catalog

UNIT = 1 << 32


def judged_rows(seed, fields=12, size=9):
    rng = random.Random(seed)
    for q in range(fields):
        for k in range(rng.randint(1, size)):
            good = rng.random()
            noisy = [good + rng.gauss(0, 0.2), rng.random(), None if rng.random() < 0.1 else -good * 3, math.nan if rng.random() < 0.1 else good > 0.5]
            yield (f"q{q}", f"d{k}", float(int(good * 3)), *[None if v is None else float(v) for v in noisy])


SCHEMA = "query_id string, docno string, label double, f1 double, f2 double, f7 double, f22 double"


def plain_ndcg(rows, top):
    """Of (label, score, docno) rows."""
    def gain(labels):
        return sum((2**v - 1) / math.log2(k + 2) for k, v in enumerate(labels[:top]))

    ideal = gain(sorted((r[0] for r in rows), reverse=True))
    return gain([r[0] for r in sorted(rows, key=lambda r: (-r[1], r[2]))]) / ideal if ideal else None


def plain_gradients(rows, top):
    """By docno, of the (label, score, docno) rows of a field."""
    ordered = sorted(rows, key=lambda r: (-r[1], r[2]))
    discount = [1 / math.log2(k + 2) if k < top else 0.0 for k in range(len(ordered))]
    ideal = sum((2**v - 1) / math.log2(k + 2) for k, v in enumerate(sorted((r[0] for r in rows), reverse=True)[:top]))
    found = collections.defaultdict(lambda: [0, 0])
    for a, (label_a, score_a, doc_a) in enumerate(ordered):
        for b, (label_b, score_b, doc_b) in enumerate(ordered):
            if label_a > label_b and (discount[a] or discount[b]):
                weight = (2**label_a - 2**label_b) * abs(discount[a] - discount[b]) / ideal
                wrong = 1 / (1 + math.exp(score_a - score_b))
                for doc, sign in ((doc_a, 1), (doc_b, -1)):
                    found[doc][0] += sign * weight * wrong
                    found[doc][1] += weight * wrong * (1 - wrong)
    return found


@pytest.mark.parametrize("top", [1, 3, 50])
def test_gradients_and_ndcg_equal_loops_over_pairs(spark, top):
    rng = random.Random(top)
    rows = [(q, d, label, rng.choice([0.0, rng.gauss(0, 1)])) for q, d, label, *_ in judged_rows(top)]
    table = spark.createDataFrame(rows, "query_id string, docno string, label double, score double")
    state = table.join(training.ideal_gains(table, scope_cols=["query_id"], top=top), "query_id")
    found = {(r["query_id"], r["docno"]): (r["g"] / UNIT, r["h"] / UNIT) for r in training.gradients(state, scope_cols=["query_id"], top=top).collect()}
    by_field = collections.defaultdict(list)
    for q, d, label, score in rows:
        by_field[q].append((label, score, d))
    expected = {(q, d): tuple(v) for q, field in by_field.items() for d, v in plain_gradients(field, top).items()}
    assert set(found) == set(expected)
    assert all(found[k] == pytest.approx(expected[k], abs=1e-7) for k in found)
    quality = {r["query_id"]: r["ndcg"] for r in training.ndcg(table, scope_cols=["query_id"], top=top).collect()}
    plain = {q: v for q, field in by_field.items() if (v := plain_ndcg(field, top)) is not None}
    assert quality == pytest.approx(plain)


def test_the_best_split_equals_trying_all(spark):
    rng = np.random.default_rng(2)
    n, features, n_bins = 300, 3, 6
    bins = rng.integers(0, n_bins, (n, features))
    g, h = (rng.normal(0, 1, n) * UNIT).astype(np.int64), (rng.random(n) * UNIT).astype(np.int64)
    settings = training.Settings(least_rows=25, l2=0.5, depth=2, learning_rate=0.3)
    table = spark.createDataFrame([(b.tolist(), int(x), int(y)) for b, x, y in zip(bins, g, h, strict=True)], "bins array<smallint>, g bigint, h bigint").repartition(4)

    def strength(rows):
        return (g[rows].sum() / UNIT) ** 2 / (h[rows].sum() / UNIT + 0.5)

    def plain_split(rows):
        best = None
        for f in range(features):
            for last in range(n_bins - 1):
                left = rows & (bins[:, f] <= last)
                right = rows & ~left
                if min(left.sum(), right.sum()) >= 25:
                    gain = strength(left) + strength(right) - strength(rows)
                    if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, f, last)
        return best

    tree = training.grow_tree(table, features, n_bins, settings)
    rows = {0: np.ones(n, bool)}
    for node in sorted(tree.value):
        split = plain_split(rows[node]) if len(rows) < 7 and node < 3 else None
        if node in tree.inner:
            place, last, left, right = tree.inner[node]
            assert (place, last) == split[1:]
            rows[left], rows[right] = rows[node] & (bins[:, place] <= last), rows[node] & (bins[:, place] > last)
        elif node < 3:
            assert split is None
        assert tree.value[node] == pytest.approx(0.3 * (g[rows[node]].sum() / UNIT) / (h[rows[node]].sum() / UNIT + 0.5))
    assert len(tree.inner) == 3
    at = tree.leaf_of(bins)
    assert all((at == k).sum() == rows[k].sum() for k in tree.value if k not in tree.inner)


def test_a_model_ranks_better_than_its_features(spark):
    rows = spark.createDataFrame(list(judged_rows(5, fields=60, size=20)), SCHEMA)
    settings = training.Settings(trees=15, depth=3, bins=15, learning_rate=0.3, least_rows=5)
    model = training.train_ensemble(rows, scope_cols=["query_id"], settings=settings)
    again = training.train_ensemble(rows.repartition(3, "docno"), scope_cols=["query_id"], settings=settings)
    assert sorted(map(str, model.collect())) == sorted(map(str, again.collect()))
    test = spark.createDataFrame(list(judged_rows(6, fields=60, size=20)), SCHEMA)
    scored = ensemble.score_ensemble(test, model, keep=["query_id", "docno", "label"])
    assert scored.count() == test.count()

    def mean(df, column):
        return training.ndcg(df, scope_cols=["query_id"], score_col=column).agg(F.avg("ndcg")).first()[0]

    negative = test.withColumn("f7", -F.col("f7"))
    assert mean(scored, "score") > max(mean(negative, c) for c in ("f1", "f2", "f7", "f22")) + 0.005


def test_missing_values_go_right_as_in_scoring(spark):
    rows = [("q", f"d{k}", float(k % 2), None if k % 4 == 1 else math.nan if k % 4 == 3 else float(k)) for k in range(40)]
    table = spark.createDataFrame(rows, "query_id string, docno string, label double, f3 double")
    model = training.train_ensemble(table, scope_cols=["query_id"], settings=training.Settings(trees=1, depth=1, least_rows=2))
    scored = {r["docno"]: r["score"] for r in ensemble.score_ensemble(table, model, keep=["docno"]).collect()}
    assert min(scored[f"d{k}"] for k in range(1, 40, 2)) > max(scored[f"d{k}"] for k in range(0, 40, 2))


def test_odd_tables(spark):
    table = spark.createDataFrame(list(judged_rows(5)), SCHEMA)
    alike = table.withColumn("label", F.lit(1.0))
    assert training.train_ensemble(alike, scope_cols=["query_id"]).count() == 0
    assert training.train_ensemble(table.limit(0), scope_cols=["query_id"]).count() == 0
    assert training.train_ensemble(table.withColumn("label", F.lit(None)), scope_cols=["query_id"]).count() == 0
    with pytest.raises(ValueError, match="identify"):
        training.train_ensemble(table.unionByName(table), scope_cols=["query_id"])
    with pytest.raises(ValueError, match="no features"):
        training.train_ensemble(table.select("query_id", "docno", "label"), scope_cols=["query_id"])


def test_query_has_all_rankers(spark):
    found = {r["ranker"]: (r["fields"], r["ndcg"]) for r in catalog.trained_ranking(spark, "/root/testdata/sf0.01").collect()}
    assert len(found) == 27 and len({fields for fields, _ in found.values()}) == 1
    assert all(0 <= v <= 1 for _, v in found.values())
