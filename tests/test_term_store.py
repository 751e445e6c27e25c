"""An index that grows round by round against one that is built at once."""

import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rankarena.operators import features, term_store, terms

DOCS = [
    ("d1", "1", 0, "red apple red"), ("d2", "1", 0, "green pear"), ("d3", "2", 1, "apple pie crust"), ("d4", "2", 1, ""),
    ("d5", "1", 2, "red red wine"), ("d6", "2", 2, "pear apple"),
]


def same(left, right):
    return sorted(map(str, left.collect())) == sorted(map(str, right.select(*left.columns).collect()))


@pytest.mark.parametrize("scope_cols", [[], ["query_id"], ["query_id", "round_number"]])
def test_rounds_add_up_to_a_full_build(spark, tmp_path, scope_cols):
    docs = spark.createDataFrame(DOCS, "docno string, query_id string, round_number int, text string")
    path = str(tmp_path / "index")
    times = {}
    for n in (0, 1, 2):
        term_store.add_round(docs.where(F.col("round_number") == n), path, n, scope_cols=scope_cols)
        held = docs.where(F.col("round_number") <= n)
        index, whole = term_store.open_index(spark, path, scope_cols=scope_cols), terms.build_index(held, scope_cols=scope_cols)
        assert same(index.terms, whole.terms) and same(index.documents, whole.documents)
        # Earlier rounds stay as they were written.
        files = {f: os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}
        assert all(files[f] == t for f, t in times.items())
        times = files
    queries = spark.createDataFrame([("1", "red pear"), ("2", "apple")], "query_id string, query string")
    by_store = features.text_features(docs=docs, queries=queries, scope_cols=scope_cols, index=index)
    assert same(by_store, features.text_features(docs=docs, queries=queries, scope_cols=scope_cols))


def test_rounds_are_listed_replaced_and_removed(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "docno string, query_id string, round_number int, text string")
    path = str(tmp_path / "index")
    assert term_store.rounds_in(path) == []
    for n in (0, 1, 1):
        term_store.add_round(docs.where(F.col("round_number") == n), path, n)
    assert term_store.rounds_in(path) == [0, 1]
    assert rows(term_store.open_index(spark, path, rounds=[1]).terms, "term", "df") == [("apple", 1), ("crust", 1), ("pie", 1)]
    (tmp_path / "index" / "terms" / "round=0" / "_SUCCESS").unlink()
    assert term_store.rounds_in(path) == [1]
    term_store.remove_round(path, 1)
    term_store.remove_round(path, 7)
    assert term_store.rounds_in(path) == []
    with pytest.raises(ValueError, match="no such rounds"):
        term_store.open_index(spark, path)
