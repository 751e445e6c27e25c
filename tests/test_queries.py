"""All registered queries against their SQL twins, and the shape of their plans."""

import re

import pytest

import check
from __spark_entry__ import entry
from rankarena.plans.catalog import QUERIES
from rankarena.plans.oracle import SQL

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return check.duck(SF_DIR)


#: Training has no SQL; tests/test_training.py compares it with plain loops.
WITHOUT_SQL = {"trained_ranking"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, duck, name):
    assert check.difference(spark, duck, SF_DIR, name) is None


def test_every_query_has_a_twin():
    assert QUERIES.keys() == SQL.keys() | WITHOUT_SQL


def test_entry(spark):
    ranked = entry(spark)
    assert ranked.columns == ["query_id", "round_number", "docno", "score", "rank"]
    assert ranked.count() == 200


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["rank_deltas", "improvement_pairs", "top_pairs", "rank_fields", "history_prompts_all"])
def test_plans_stay_native_and_without_products(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "PythonUDF"):
        assert operator not in text


def test_scans_read_only_what_is_needed(spark):
    text = plan(QUERIES["rank_deltas"](spark, SF_DIR))
    scans = re.findall(r"ReadSchema: (struct<[^\n]*)", text.split("== Physical Plan ==")[1])
    read = [re.findall(r"(\w+):", scan) for scan in scans]
    # Query texts come from the benchmark table; of documents no text is read.
    assert scans and not any("text" in columns and "doc_id" in columns for columns in read)


def test_deltas_have_no_window_per_author(spark):
    text = plan(QUERIES["rank_deltas"](spark, SF_DIR)).split("== Physical Plan ==")[1]
    # The windows left are those that lay out the test competition, field by field.
    assert text.count("windowspecdefinition(") == text.count("windowspecdefinition(round_no") > 0
