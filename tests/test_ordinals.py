"""Row numbers of hot groups against a window, with odd values."""

import math

import pytest

from rankarena.operators.features import ltr_features
from rankarena.operators.ordinals import with_ordinal


@pytest.mark.parametrize("hot_rows", [5, 1_000_000])
def test_null_scopes_and_odd_scores_have_one_order(spark, hot_rows):
    scores = [1.0, math.nan, None, -0.0, 0.0, 2.5, 2.5, -3.0, math.inf, -math.inf]
    rows = [(scope, f"d{k:03}", scores[k % len(scores)]) for scope in ("a", None) for k in range(40)]
    df = spark.createDataFrame(rows, "q string, docno string, score double")
    found = with_ordinal(df, scope=["q"], order={"score": False, "docno": True}, hot_rows=hot_rows).collect()
    assert len(found) == len(rows)

    def key(row):
        score = row[2]
        rank = (2, 0.0) if score is None else (0, 0.0) if math.isnan(score) else (1, -score)
        return (*rank, row[1])

    for scope in ("a", None):
        expected = [r[1] for r in sorted((r for r in rows if r[0] == scope), key=key)]
        got = [r["docno"] for r in sorted((r for r in found if r["q"] == scope), key=lambda r: r["ordinal"])]
        assert got == expected


def test_a_field_of_empty_texts_has_features(spark):
    docs = spark.createDataFrame([("001", 1, "d1", ""), ("001", 1, "d2", "")], "query_id string, round_number int, docno string, text string")
    queries = spark.createDataFrame([("001", "a query")], "query_id string, query string")
    rows = ltr_features(docs=docs, queries=queries, scope_cols=["query_id", "round_number"], mode="test").collect()
    assert len(rows) == 2
    assert all(rows[0][f"f{k}"] == 0 for k in range(1, 26))
