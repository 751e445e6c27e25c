import re

import pytest
from conftest import rows
from pyspark.sql import Observation

from rankarena import schema
from rankarena.operators import corpus, pairs, rounds
from rankarena.plans import catalog


def comp(spark, values):
    """Rows from (round, query, author, text, ksrel, pos)."""
    full = [
        (f"ROUND-{r:02d}-{q}-{a}", r, q, a, f"query {q}", t, 1, k, p) for r, q, a, t, k, p in values
    ]
    return spark.createDataFrame(full, schema.COMPETITION)


def test_deltas_do_not_bridge_gaps(spark):
    table = comp(spark, [(r, "001", "a", f"t{r}", 2, p) for r, p in ((1, 9), (2, 7), (4, 4), (5, 1))])
    deltas = rounds.rank_deltas(table)
    assert rows(deltas, "round_number", "delta", "delta_2", "delta_3") == [
        (1, 0, 0, 0), (2, 2, 0, 0), (4, 0, 3, 5), (5, 3, 0, 6),
    ]
    assert deltas.schema == schema.DELTAS or [f.dataType for f in deltas.schema] == [f.dataType for f in schema.DELTAS]


def test_deltas_are_per_author_and_query(spark):
    table = comp(spark, [(1, "001", "a", "x", 2, 5), (2, "001", "b", "x", 2, 1), (2, "002", "a", "x", 2, 1)])
    assert rows(rounds.rank_deltas(table), "delta") == [(0,), (0,), (0,)]


def test_spans(spark):
    table = comp(spark, [(1, "001", "a", "x", 2, 5), (4, "001", "a", "y", 2, 1)])
    assert rows(rounds.trajectory_spans(table)) == [("a", "001", 1, 4, 2)]


def test_improvement_pairs(spark):
    table = comp(
        spark,
        [
            (1, "001", "a", "old \\ text", 2, 5),
            (2, "001", "a", "new \\ text", 2, 2),  # moved up
            (3, "001", "a", "worse", 2, 4),  # one up over two rounds only
            (1, "001", "b", "x", 2, 4),
            (2, "001", "b", "excluded", 3, 1),  # moved up, but excluded
            (1, "002", "a", "gone", 2, 5),
            (3, "002", "a", "late", 2, 1),  # moved up, but has no text of the round before
        ],
    )
    made = pairs.improvement_pairs(rounds.rank_deltas(table))
    assert rows(made, "text", "completion", "delta", "delta_2") == [
        ("new  text", "old \\ text", 3, 0), ("worse", "new \\ text", -2, 1),
    ]
    assert made.columns == schema.PAIRS.names
    lagged = pairs.improvement_pairs(rounds.rank_deltas(table), match_lag=True, clean_all=True)
    assert rows(lagged, "text", "completion") == [
        ("late", "gone"), ("new  text", "old  text"), ("worse", "old  text"),
    ]
    turned = pairs.improvement_pairs(rounds.rank_deltas(table), direction="worse_to_better")
    row = turned.where("delta = 3").first()
    assert (row.text, row.completion) == ("old \\ text", "new  text") and "'old \\ text'" in row.prompt


def test_dropped_rows_are_counted(spark):
    table = comp(
        spark,
        [
            (1, "001", "a", "old", 2, 5), (2, "001", "a", "new", 2, 2), (1, "002", "a", "gone", 2, 5), (3, "002", "a", "late", 2, 1),
            (1, "003", "a", "alone", 2, 1), (1, "004", "a", "won", 2, 1), (1, "004", "b", "lost", 2, 2), (9, "005", "a", None, 2, 4), (10, "005", "a", "x", 2, 1),
        ],
    )
    deltas, texts = rounds.rank_deltas(table), table.select("docno", "text")
    for given in (deltas, deltas.drop("text")):
        counts = Observation()
        made = pairs.improvement_pairs(given, texts=texts, counts=counts)
        assert rows(made.fillna("null"), "text", "completion") == [("new", "old"), ("x", "null")]
        assert counts.get == {"rows": 3, "without_other_text": 1}
    counts = Observation()
    assert rows(pairs.top_pairs(table, counts=counts), "text", "completion") == [("won", "lost")]
    assert counts.get == {"rows": 4, "without_other_text": 3}


def text_exchanges(df):
    """Shuffles of the plan that carry a text."""
    plan = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    inputs = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\n]*)\]", plan)
    return sum(bool(re.search(r"\b(text|completion)#", given)) for given in inputs)


@pytest.mark.parametrize("name", ["improvement_pairs", "improvement_pairs_match_lag", "top_pairs"])
def test_texts_move_twice_at_most(spark, name):
    assert text_exchanges(catalog.QUERIES[name](spark, "/root/testdata/sf0.01")) <= 2


def test_equal_pairs_are_kept_once_and_unequal_ones_are_not_confused(spark):
    table = comp(
        spark,
        [
            (1, "001", "a", "c", 2, 5), (2, "001", "a", "ab", 2, 4),
            (1, "001", "b", "c", 2, 9), (2, "001", "b", "ab", 2, 1),  # the same pair, larger delta
            (1, "001", "c", "bc", 2, 7), (2, "001", "c", "a", 2, 6),  # the same text when joined
        ],
    )
    made = pairs.improvement_pairs(rounds.rank_deltas(table))
    assert rows(made, "author_id", "text", "completion") == [("b", "ab", "c"), ("c", "a", "bc")]


def test_top_pairs(spark):
    table = comp(
        spark,
        [
            (1, "001", "a", "win", 2, 1), (1, "001", "b", "second", 3, 2), (1, "001", "c", "third", 2, 3),
            (2, "001", "a", "alone", 2, 1), (2, "001", "b", "far", 2, 10),
            (3, "001", "a", "excluded", 3, 1), (3, "001", "b", "x", 2, 2),
        ],
    )
    assert rows(pairs.top_pairs(table), "text", "completion") == [("win", "third")]
    assert rows(pairs.top_pairs(table, legacy=True), "text", "completion") == [("alone", "far"), ("win", "third")]


def test_repeated_top_pair_keeps_the_latest(spark):
    table = comp(
        spark,
        [(r, q, a, t, 2, p) for r in (1, 2) for q in ("001", "002") for a, t, p in (("a", "w", 1), ("b", "l", 2))],
    )
    assert rows(pairs.top_pairs(table), "query_id", "round_number") == [("002", 2)]


def test_corpus(spark):
    names = ["ROUND-00-2-00", "ROUND-01-2-00", "ROUND-01-1955-01"]
    docs = spark.createDataFrame([(n, f"text {n}") for n in names] + [("ROUND-09-2-00", "unjudged")], "docno string, text string")
    quality = spark.createDataFrame([(n, 1) for n in names], "docno string, qrel int")
    relevance = spark.createDataFrame([(n, 2) for n in names], "docno string, ksrel int")
    positions = spark.createDataFrame([(n, i) for i, n in enumerate(names, 1)], "docno string, pos int")
    queries = spark.createDataFrame([("2", "two"), ("1955", "many")], "query_id string, query string")
    table = corpus.assemble_corpus(
        docs=docs, quality=quality, relevance=relevance, positions=positions, queries=queries
    )
    assert table.columns == schema.COMPETITION.names
    assert rows(table, "round_number", "query_id", "author_id", "query", "pos") == [
        (0, "002", "00", "two", 1), (1, "002", "00", "two", 2), (1, "1955", "01", "many", 3),
    ]
    assert rows(corpus.field_texts(table, query_id="2"), "author_id", "text") == [("00", "text ROUND-01-2-00")]
    assert rows(corpus.field_texts(table, query_id="2", round_number=0), "text") == [("text ROUND-00-2-00",)]
    assert rows(corpus.reference_texts(table), "query_id", "docno") == [("002", names[0]), ("1955", names[2])]
    assert rows(corpus.participants(table)) == [("00", "002"), ("01", "1955")]


def test_dropped_pairs_keeps_no_table(spark):
    from pathlib import Path

    from rankarena.plans import catalog

    assert catalog.dropped_pairs(spark, "/root/testdata/sf0.001").count() == 3
    assert not list(Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).glob("pairs-*"))
