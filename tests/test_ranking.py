import numpy as np
import uuid
from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rankarena.operators import corpus, ensemble, neural, ranking
from rankarena.operators.ordinals import with_ordinal
from rankarena.plans.competition import EXAMPLE_TREES
from rankarena.schema import FEATURE_COLUMNS, TREE_ENSEMBLE


@pytest.mark.parametrize("hot_rows", [50, 1_000_000])
def test_ordinals_of_hot_groups(spark, hot_rows):
    # One group has most of the rows, and most of its scores are equal.
    df = spark.range(6000).select(
        F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("scope"),
        F.when(F.col("id") % 3 == 0, F.col("id") % 17).otherwise(5).cast("double").alias("score"),
        F.format_string("d%05d", "id").alias("docno"),
    )
    made = with_ordinal(
        df, scope=["scope"], order={"score": False, "docno": True}, name="rank", hot_rows=hot_rows
    ).collect()
    groups = {}
    for r in df.collect():
        groups.setdefault(r.scope, []).append((-r.score, r.docno))
    expected = {(s, d): i for s, g in groups.items() for i, (_, d) in enumerate(sorted(g), 1)}
    assert {(r.scope, r.docno): r["rank"] for r in made} == expected
    assert len(made) == 6000


def test_hot_group_is_cut_into_many_pieces(spark):
    df = spark.range(20000).select(F.lit("q").alias("query_id"), F.format_string("d%06d", "id").alias("docno"))
    # Small shuffles are merged into one task otherwise.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = with_ordinal(df, scope=["query_id"], order={"docno": True}, hot_rows=1000)
        sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 20000 and len(sizes) == 4 and max(sizes) < 10000


def test_query_docnos_with_a_hot_query(spark):
    docs = spark.range(3000).select(F.format_string("ROUND-%02d-007-%02d", F.expr("id div 50"), F.expr("id % 50")).alias("docno"))
    plain, cut = (corpus.query_docnos(docs, hot_rows=h) for h in (10**6, 100))
    assert rows(plain) == rows(cut)


def python_score(trees, values):
    by_place = {(t[0], t[1]): t for t in trees}
    total = 0.0
    for tree in sorted({t[0] for t in trees}):
        node = by_place[(tree, 0)]
        while node[4] is not None:
            node = by_place[(tree, node[4] if values[node[2]] <= node[3] else node[5])]
        total += node[6]
    return total


def test_ensemble_strategies_agree(spark):
    rng = np.random.default_rng(7)
    data = [(f"d{i}", *(float(v) for v in rng.choice([0.0, 0.3, 0.55, 2.5, 4.5, 60.5, 300.5, 900.0], 26))) for i in range(60)]
    rows_in = spark.createDataFrame(data, "docno string, " + ", ".join(f"{c} double" for c in FEATURE_COLUMNS))
    stump = [(3, 0, None, None, None, None, 2.0)]
    trees = EXAMPLE_TREES + stump
    model = spark.createDataFrame(trees, TREE_ENSEMBLE)
    expected = sorted((d[0], python_score(trees, dict(enumerate(d[1:], 1)))) for d in data)
    for options in ({"strategy": "case"}, {"strategy": "arrays"}, {"strategy": "joins"}, {}, {"max_nodes": 5}):
        assert rows(ensemble.score_ensemble(rows_in, model, keep=["docno"], **options)) == expected, options
    with pytest.raises(ValueError):
        ensemble.score_ensemble(rows_in, model, keep=["docno"], strategy="other")


@pytest.mark.parametrize("strategy", ["case", "arrays", "joins"])
def test_ensemble_strategies_agree_on_odd_input(spark, strategy):
    def scores(data, model):
        df = spark.createDataFrame(data, "docno string, f1 double, f2 double")
        made = ensemble.score_ensemble(df, spark.createDataFrame(model, TREE_ENSEMBLE), keep=["docno"], strategy=strategy)
        return rows(made, "docno", "score")

    def stump(tree, feature, low, high):
        return [(tree, 0, feature, 0.5, 1, 2, None), (tree, 1, None, None, None, None, low), (tree, 2, None, None, None, None, high)]

    nan = float("nan")
    data = [("a", 0.0, 1.0), ("a", 0.0, 1.0), ("a", 1.0, 1.0), ("b", None, 0.0), ("c", nan, 0.0)]
    assert scores(data, stump(0, 1, 1.0, 2.0)) == [("a", 1.0), ("a", 1.0), ("a", 2.0), ("b", 2.0), ("c", 2.0)]
    assert scores(data, [(0, 0, None, None, None, None, 3.0)]) == [(d[0], 3.0) for d in data]
    assert scores(data, []) == [(d[0], 0.0) for d in data]
    uneven = stump(0, 1, 0.1, 0.1) + stump(1, 2, 0.2, 0.2) + stump(2, 1, 0.3, 0.3)
    assert scores(data, uneven) == [(d[0], 0.1 + 0.2 + 0.3) for d in data]
    with pytest.raises(ValueError, match="f26"):
        scores(data, stump(0, 26, 1.0, 2.0))


def test_large_ensemble_becomes_arrays(spark):
    trees = []
    for t in range(400):
        trees += [(t, 0, 1 + t % 26, 0.5, 1, 2, None), (t, 1, None, None, None, None, 1.0), (t, 2, None, None, None, None, -1.0)]
    model = spark.createDataFrame(trees, TREE_ENSEMBLE)
    data = [("a", *([0.0] * 26)), ("b", *([1.0] * 26)), ("c", *([0.0] * 13), *([1.0] * 13))]
    df = spark.createDataFrame(data, "docno string, " + ", ".join(f"{c} double" for c in FEATURE_COLUMNS))
    expected = sorted((d[0], python_score(trees, dict(enumerate(d[1:], 1)))) for d in data)
    assert rows(ensemble.score_ensemble(df, model, keep=["docno"])) == expected


def test_neural_scores(spark):
    def load_length_scorer():
        def score(queries, texts):
            assert len(queries) <= 3
            return np.array([[0.0, float(len(t)) / len(q)] for q, t in zip(queries, texts, strict=True)])

        return score

    def load_single_logit_scorer():
        return lambda queries, texts: np.array([[float(len(t))] for t in texts])

    docs = spark.createDataFrame([(f"d{i}", "001", "x" * i) for i in range(10)], "docno string, query_id string, text string")
    queries = spark.createDataFrame([("001", "ab")], "query_id string, query string")
    pairs = neural.query_document_pairs(docs, queries)
    made = dict(rows(neural.neural_scores(pairs, load_length_scorer, keep=["docno"], batch_size=3)))
    assert made == pytest.approx({f"d{i}": i / 2 - np.log(1 + np.exp(i / 2)) for i in range(10)})
    raw = dict(rows(neural.neural_scores(pairs, load_single_logit_scorer, keep=["docno"])))
    assert raw == {f"d{i}": float(i) for i in range(10)}


def length_model(spark):
    nodes = [(0, 0, 3, 2.5, 1, 2, None), (0, 1, None, None, None, None, 0.0), (0, 2, None, None, None, None, 1.0)]
    return spark.createDataFrame(nodes, TREE_ENSEMBLE)


def test_rank_fields_gives_permutations_and_breaks_ties(spark):
    docs = spark.createDataFrame(
        [
            ("b", "001", 0, "one two three"), ("a", "001", 0, "one two three"), ("c", "001", 0, "one"),
            ("d", "001", 1, "one"), ("e", "002", 0, ""),
        ],
        "docno string, query_id string, round_number int, text string",
    )
    queries = spark.createDataFrame([("001", "two"), ("002", "none")], "query_id string, query string")
    made = ranking.rank_fields(docs=docs, queries=queries, model=length_model(spark))
    assert rows(made, "query_id", "round_number", "docno", "rank") == [
        ("001", 0, "a", 1), ("001", 0, "b", 2), ("001", 0, "c", 3), ("001", 1, "d", 1), ("002", 0, "e", 1),
    ]


def test_rank_fields_with_a_hot_field(spark):
    docs = spark.range(600).select(
        F.format_string("d%04d", "id").alias("docno"),
        F.when(F.col("id") % 3 == 0, "001").otherwise(F.format_string("%03d", F.col("id") % 50 + 2)).alias("query_id"),
        F.lit(0).alias("round_number"),
        F.repeat(F.lit("one two "), (F.col("id") % 4).cast("int")).alias("text"),
    )
    queries = docs.select("query_id", F.lit("two").alias("query")).distinct()
    plain, cut = (
        ranking.rank_fields(docs=docs, queries=queries, model=length_model(spark), hot_rows=h) for h in (10**6, 50)
    )
    found = rows(cut, "query_id", "docno", "rank")
    assert found == rows(plain, "query_id", "docno", "rank")
    assert sorted(r for q, _, r in found if q == "001") == list(range(1, 201))


def test_epoch_step(spark):
    field = spark.createDataFrame(
        [
            ("001", 3, "ROUND-03-001-04", "short"), ("001", 3, "BOT", "old entry of the bot"),
            ("001", 2, "04", "another epoch"), ("002", 3, "04", "no candidate here"),
        ],
        "query_id string, epoch int, author_id string, text string",
    )
    candidates = spark.createDataFrame(
        [("001", 3, "BOT", "a new and longer entry"), ("002", 3, "BOT", "too long " * 100)],
        "query_id string, epoch int, bot string, text string",
    )
    queries = spark.createDataFrame([("001", "entry"), ("002", "x")], "query_id string, query string")
    made = ranking.epoch_step(field=field, candidates=candidates, queries=queries, model=length_model(spark))
    assert rows(made, "query_id", "epoch", "bot", "author_id", "text", "rank") == [
        ("001", 3, "BOT", "04", "short", 2), ("001", 3, "BOT", "BOT", "a new and longer entry", 1),
    ]
    flagged = ranking.candidates_within_limit(candidates)
    assert rows(flagged, "query_id", "accepted") == [("001", True), ("002", False)]


def test_epoch_step_with_a_scorer_and_authors_of_one_segment(spark):
    def load_length_scorer():
        return lambda queries, texts: np.array([[float(len(t))] for t in texts])

    nodes = [(0, 0, 26, 0.5, 1, 2, None), (0, 1, None, None, None, None, 0.0), (0, 2, None, None, None, None, 1.0)]
    field = spark.createDataFrame(
        [
            ("001", 3, "ROUND-02-001-04", "one two three four"), ("001", 3, "ROUND-03-001-04", "four"),
            ("001", 3, "07", "twenty words of text"), ("001", 3, "X-BOT", "old"),
        ],
        "query_id string, epoch int, author_id string, text string",
    )
    candidates = spark.createDataFrame([("001", 3, "A-BOT", "a new text")], "query_id string, epoch int, bot string, text string")
    queries = spark.createDataFrame([("001", "text")], "query_id string, query string")
    model = spark.createDataFrame(nodes, TREE_ENSEMBLE)
    made = ranking.epoch_step(field=field, candidates=candidates, queries=queries, model=model, load_scorer=load_length_scorer)
    assert rows(made, "author_id", "text", "rank") == [("04", "four", 2), ("07", "twenty words of text", 1), ("BOT", "a new text", 3)]


def test_equal_pairs_are_scored_once_and_null_texts_count_as_empty(spark, tmp_path):
    texts = ["same", "same", None, "", "longer text", "same", None]
    pairs = spark.createDataFrame([(f"d{k}", "q", t) for k, t in enumerate(texts)], "docno string, query string, text string")
    seen = str(tmp_path)

    def load_counting_scorer():
        def score(queries, given):
            for k, (q, t) in enumerate(zip(queries, given, strict=True)):
                (Path(seen) / f"{uuid.uuid4().hex}").write_text(f"{q}|{t}")
            return [[float(len(q) + len(t))] for q, t in zip(queries, given, strict=True)]

        return score

    made = dict(rows(neural.neural_scores(pairs, load_counting_scorer, keep=["docno"], batch_size=2)))
    assert made == {f"d{k}": 1.0 + len(t or "") for k, t in enumerate(texts)}
    assert sorted(f.read_text() for f in tmp_path.iterdir()) == ["q|", "q|longer text", "q|same"]


def test_pairs_are_cut_token_by_token_from_the_longer_side():
    for query in range(0, 9):
        for text in range(0, 9):
            for length in range(3, 20):
                left = [query, text]
                while sum(left) + 3 > length:
                    left[0 if left[0] > left[1] else 1] -= 1
                assert neural.kept_of_pair(query, text, length) == tuple(left)


def test_scorers_get_pairs_of_the_declared_length(spark):
    class Words:
        names = ["zero", *[f"w{k}" for k in range(30)]]

        def encode(self, text):
            return [self.names.index(w) for w in text.split()]

        def decode(self, ids):
            return " ".join(self.names[i] for i in ids)

    texts = [" ".join(f"w{k}" for k in range(n)) for n in (2, 9, 25)]
    pairs = spark.createDataFrame([(f"d{k}", "w1 w2 w3", t) for k, t in enumerate(texts)], "docno string, query string, text string")
    scores = neural.neural_scores(
        pairs, lambda: lambda q, t: [[float(len(x.split()) + 100 * len(y.split()))] for x, y in zip(q, t, strict=True)],
        keep=["docno"], load_tokenizer=Words, pair_length=12,
    )
    assert dict(rows(scores)) == {"d0": 203.0, "d1": 603.0, "d2": 603.0}
