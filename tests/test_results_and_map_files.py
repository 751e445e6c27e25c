"""Files of single fields, and documents that come back in batches."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rankarena import schema
from rankarena.sources import map_files, results, sinks

STATES = "query_id string, epoch int, bot string, author_id string, text string, rank int"


def test_files_of_fields_are_json_maps_and_come_back(spark, tmp_path):
    texts = ["plain", 'quo"te', "line\nbreak", "é 日本   \\", "}", "{", ", ", ""]
    given = [("002", 1, "NMABOT", f"a{k}", t, k + 1) for k, t in enumerate(texts)]
    given += [("003", 1, "NMABOT", "a b", None, None), ("002", 2, "MTBOT", "x", "t", 1), ("002", 2, "MTBOT", "x", "twice", 2), ("q/1", 1, "B", None, "t", 1)]
    path = str(tmp_path / "maps")
    made = map_files.write_epoch_map_files(spark.createDataFrame(given, STATES).repartition(5), path)
    assert rows(made, "query_id", "epoch", "bot", "entries") == [("002", 1, "NMABOT", 8), ("002", 2, "MTBOT", 1), ("003", 1, "NMABOT", 1)]
    found = sorted(f.name for f in (tmp_path / "maps").iterdir() if not f.name.startswith("."))
    assert found == sorted(f"id_{q}_ep_{e}_{b}_{kind}.json" for q, e, b in (("002", 1, "NMABOT"), ("002", 2, "MTBOT"), ("003", 1, "NMABOT")) for kind in ("texts", "rankings"))
    assert json.loads((tmp_path / "maps" / "id_002_ep_1_NMABOT_texts.json").read_text()) == {f"a{k}": t for k, t in enumerate(texts)}
    back = map_files.read_epoch_map_lines(spark, path)
    expected = [r for r in given if r[3] and r[4] != "twice"]
    assert sorted(map(tuple, back.select(*schema.EPOCH_STATE.names).collect()), key=str) == sorted(expected, key=str)


def test_maps_on_one_line_are_read_too(spark, tmp_path):
    (tmp_path / "id_2_ep_3_NMABOT_texts.json").write_text(json.dumps({"a": "x, {y}", "b": "z"}))
    (tmp_path / "id_2_ep_3_NMABOT_rankings.json").write_text(json.dumps({"a": 2, "b": 1}, indent=2))
    (tmp_path / "other.json").write_text("{}")
    assert rows(map_files.read_epoch_map_lines(spark, str(tmp_path)), *schema.EPOCH_STATE.names) == [
        ("002", 3, "NMABOT", "a", "x, {y}", 2), ("002", 3, "NMABOT", "b", "z", 1),
    ]


def test_names_that_files_cannot_have(spark, tmp_path):
    for query, bot in (("1/2", "B"), ("1", "B_1")):
        states = spark.createDataFrame([(query, 1, bot, "a", "t", 1)], STATES)
        with pytest.raises(Exception, match="told by a file"):
            map_files.write_epoch_map_files(states, str(tmp_path / "maps"))


def test_fields_too_large_for_a_row(spark):
    states = spark.createDataFrame([("1", 1, "B", f"a{k}", "x" * 100, 1) for k in range(20)] + [("2", 1, "B", "a", "y", 1)], STATES)
    assert sinks.epoch_maps(states, max_bytes=2000).count() == 2
    with pytest.raises(Exception, match="2000 bytes of text"):
        sinks.epoch_maps(states, max_bytes=1999).collect()


def test_a_killed_run_is_repeated_with_the_same_table(spark, tmp_path):
    path = str(tmp_path / "results")
    topics = spark.createDataFrame([(str(k), "t", ["a"], "d", "b") for k in range(6)], "topic_id string, topic_title string, queries array<string>, description string, backstory string")
    long = "w " * 151
    made = {"0": "zero", "1": long, "2": "two", "3": "three", "4": None}

    def batch(*ids):
        return spark.createDataFrame([(i, made[i]) for i in ids], "topic_id string, doc string")

    assert rows(results.read_results(spark, path)) == [] and results.waiting_topics(topics, path).count() == 6
    assert results.commit_batch(batch("0", "1"), path, "b1")
    assert not results.commit_batch(batch("2"), path, "b1")

    def explode(_):
        raise RuntimeError("killed")

    killed = batch("2", "3").withColumn("doc", F.udf(explode)("doc"))
    with pytest.raises(Exception, match="killed"):
        results.commit_batch(killed, path, "b2")
    assert results.committed_batches(path) == ["b1"]
    assert rows(results.waiting_topics(topics, path), "topic_id") == [(k,) for k in "12345"]
    for _ in range(2):
        results.commit_batch(batch("2", "3", "4", "0"), path, "b2")
    found = results.read_results(spark, path)
    assert sorted((r["topic_id"], r["batch"], r["accepted"]) for r in found.collect()) == [
        ("0", "b1", True), ("1", "b1", False), ("2", "b2", True), ("3", "b2", True), ("4", "b2", False),
    ]
    given = results.topics_with_documents(topics, found)
    assert given.columns == schema.TOPICS.names
    assert sorted((r["topic_id"], r["doc"]) for r in given.collect()) == [("0", "zero"), ("1", None), ("2", "two"), ("3", "three"), ("4", None), ("5", None)]
    with pytest.raises(ValueError, match="name a batch"):
        results.commit_batch(batch("0"), path, "b/3")


def test_words_are_counted_once_when_a_batch_is_committed(spark, tmp_path):
    path = str(tmp_path / "results")
    results.commit_batch(spark.createDataFrame([("0", "a"), ("1", "w " * 151), ("2", None)], "topic_id string, doc string"), path, "b2")
    stored = spark.read.parquet(f"{path}/batch=b2")
    assert rows(stored, "topic_id", "accepted") == [("0", True), ("1", False), ("2", False)]
    # A batch from before has the texts only.
    spark.createDataFrame([("0", "w " * 151), ("3", "b")], "topic_id string, doc string").write.parquet(f"{path}/batch=b1")
    assert rows(results.read_results(spark, path), "topic_id", "batch", "accepted") == [("0", "b1", False), ("1", "b2", False), ("2", "b2", False), ("3", "b1", True)]


@pytest.mark.parametrize("large_entries", [2, 100])
def test_fields_are_read_without_listing_the_folder(spark, tmp_path, large_entries):
    texts = ["plain", 'quo"te,', "line\nbreak\r", "é 日本 \u2028 \\", "}", "{", ", ", "", None]
    given = [("002", 1, "B", f"a{k},", t, k + 1) for k, t in enumerate(texts)] + [("003", 2, "B", "x", "t", None)]
    path = str(tmp_path / "maps")
    fields = map_files.write_epoch_map_files(spark.createDataFrame(given, STATES), path)
    (tmp_path / "maps" / "id_9_ep_9_B_texts.json").write_text('{\n"not": "written here"\n}\n')
    back = map_files.read_epoch_map_lines(spark, path, fields=fields, large_entries=large_entries)
    assert sorted(map(tuple, back.select(*schema.EPOCH_STATE.names).collect()), key=str) == sorted(given, key=str)
