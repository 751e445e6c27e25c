import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rankarena import schema
from rankarena.sources import scratch, sinks, tables, trec


def write(path, content):
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def test_trectext(spark, tmp_path):
    path = write(
        tmp_path / "documents.trectext",
        b"<DOC>\n<DOCNO>ROUND-00-195-00</DOCNO>\n<TEXT>\n  first & <b> \n</TEXT>\n</DOC>\n"
        b"<DOC>\n<DOCNO>ROUND-00-195-01</DOCNO>\n<TEXT>\nbad\xff byte\xc3\xa9\n</TEXT>\n<TEXT>second</TEXT>\n</DOC>\n"
        b"<DOC>\n<DOCNO>ROUND-00-195-02</DOCNO>\n<TEXT></TEXT>\n</DOC>\n"
        b"<DOC>\n<DOCNO>ROUND-00-195-00</DOCNO>\n<TEXT>\nlast\nwins\n</TEXT>\n</DOC>\n",
    )
    expected = [("ROUND-00-195-00", "last\nwins"), ("ROUND-00-195-01", "bad byteé"), ("ROUND-00-195-02", "")]
    assert rows(trec.read_trectext(spark, path)) == expected
    assert trec.read_trectext(spark, path, unique=True).count() == 4


def test_trectext_split_over_tasks_keeps_blocks_whole(spark, tmp_path):
    docs = spark.range(3000).select(
        F.format_string("ROUND-01-%03d-00", "id").alias("docno"), F.repeat(F.concat("id", F.lit(" word\n")), 20).alias("text")
    )
    path = str(tmp_path / "docs")
    sinks.write_trectext(docs.coalesce(1), path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        read = trec.read_trectext(spark, path)
        assert read.exceptAll(docs.withColumn("text", F.rtrim(F.regexp_replace("text", r"\n\z", "")))).isEmpty()
        assert read.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_broken_trectext(spark, tmp_path):
    path = write(tmp_path / "broken", "<DOC>\n<DOCNO>a</DOCNO>\n</DOC>\n<DOC><DOCNO>b</DOCNO><TEXT>t</TEXT></DOC>\n")
    with pytest.raises(Exception, match="not a document block"):
        trec.read_trectext(spark, path).collect()
    assert rows(trec.read_trectext(spark, path, strict=False)) == [("b", "t")]


def test_judgements_and_qrels(spark, tmp_path):
    path = write(tmp_path / "quality", "195 0  EPOCH-01-195-02\t1\n\n7 0 ROUND-01-007-02 10\n")
    assert rows(trec.read_judgements(spark, path, value="qrel", epoch_docnos=True)) == [
        ("ROUND-01-007-02", 10), ("ROUND-01-195-02", 1),
    ]
    assert ("EPOCH-01-195-02", 1) in rows(trec.read_judgements(spark, path, value="qrel"))
    qrels = write(tmp_path / "qrels", "7 0 EPOCH-01-007-02 1\n1955 0 ROUND-01-1955-02 0\n")
    assert rows(trec.read_qrels(spark, qrels)) == [("007", "ROUND-01-007-02", 1), ("1955", "ROUND-01-1955-02", 0)]


def test_queries(spark, tmp_path):
    path = write(tmp_path / "queries", "195: pressure: washers \n2:first\n002:last\n")
    assert rows(trec.read_queries(spark, path)) == [("002", "last"), ("195", "pressure: washers")]
    assert ("195", "pressure") in rows(trec.read_queries(spark, path, legacy_colon=True))


def test_feature_lines(spark, tmp_path):
    path = write(tmp_path / "features", "0 qid:7 1:2.0 2:0.5 26:1.0E-5 #ROUND-01-007-02\n")
    row = trec.read_features(spark, path).first()
    assert (row.query_id, row.docno, row.label, row.f1, row.f2, row.f3, row.f26) == (
        "007", "ROUND-01-007-02", 0.0, 2.0, 0.5, None, 1e-5,
    )
    twice = write(tmp_path / "twice", "0 qid:7 1:2.0 #a#b\n")
    with pytest.raises(Exception, match="not a feature line"):
        trec.read_features(spark, twice).collect()


def test_csv_with_line_breaks_and_quotes(spark, tmp_path):
    values = [("ROUND-1", 1, "007", "03", 'a "query"', 'two\nlines, "quoted" and \\ back', 1, 2, 3)]
    df = spark.createDataFrame(values, schema.COMPETITION)
    sinks.write_csv_table(df, str(tmp_path / "csv"))
    assert rows(tables.read_csv_table(spark, str(tmp_path / "csv"), schema.COMPETITION)) == values


def test_epoch_states(spark, tmp_path):
    values = [("195", 1, bot, author, f"text of {author}\n'\"", i) for bot in ("A", "B") for i, author in enumerate("xyz", 1)]
    states = spark.createDataFrame(values, schema.EPOCH_STATE)
    sinks.write_epoch_states(states, str(tmp_path / "states"))
    assert rows(tables.read_epoch_states(spark, str(tmp_path / "states")), *schema.EPOCH_STATE.names) == values


def test_fields_of_any_size_have_one_layout(spark, tmp_path):
    states = spark.range(2500).select(
        F.lit("195").alias("query_id"), F.lit(1).alias("epoch"), F.lit("A").alias("bot"),
        F.col("id").cast("string").alias("author_id"), F.lit("t").alias("text"), (F.col("id") + 1).cast("int").alias("rank"),
    )
    assert sinks.epoch_maps(states).count() == 1
    sinks.write_epoch_states(states, str(tmp_path / "states"))
    sinks.write_epoch_maps(states, str(tmp_path / "maps"))
    for back in (tables.read_epoch_states(spark, str(tmp_path / "states")), tables.read_epoch_maps(spark, str(tmp_path / "maps"))):
        assert back.select(*schema.EPOCH_STATE.names).exceptAll(states).isEmpty() and back.count() == 2500


def test_dirty_trectext(spark, tmp_path):
    path = write(
        tmp_path / "dirty",
        "a preamble\n<DOC><DOCNO>a</DOCNO><TEXT>kept \ufffd</TEXT></DOC>\n".encode()
        + b"<DOC><DOCNO>b\xff</DOCNO><TEXT>dropped \xfe</TEXT></DOC>\n",
    )
    assert rows(trec.read_trectext(spark, path)) == [("a", "kept \ufffd"), ("b", "dropped")]


def test_repeated_judgements_and_lines_without_a_colon(spark, tmp_path):
    qrels = write(tmp_path / "qrels", "7 0 ROUND-01-007-02 1\n007 0 EPOCH-01-007-02 0\n")
    assert rows(trec.read_qrels(spark, qrels)) == [("007", "ROUND-01-007-02", 1)]
    asked = write(tmp_path / "asked", "7:a query\n\nno colon\n")
    assert rows(trec.read_queries(spark, asked, strict=False)) == [("007", "a query")]
    with pytest.raises(Exception, match="not a query line"):
        trec.read_queries(spark, asked).collect()


def test_epoch_map_files(spark, tmp_path):
    texts, ranks = {"NMTBOT": "mine", "04": "theirs"}, {"04": 1, "NMTBOT": 2}
    write(tmp_path / "id_7_ep_3_NMTBOT_texts.json", json.dumps(texts, indent=4))
    write(tmp_path / "id_7_ep_3_NMTBOT_rankings.json", json.dumps(ranks, indent=4))
    assert rows(tables.read_epoch_map_files(spark, str(tmp_path)), *schema.EPOCH_STATE.names) == [
        ("007", 3, "NMTBOT", "04", "theirs", 1), ("007", 3, "NMTBOT", "NMTBOT", "mine", 2),
    ]


def test_queries_xml(spark, tmp_path):
    queries = spark.createDataFrame([("12", "b & c"), ("7", "a < b")], "query_id string, query string")
    path = tmp_path / "xml"
    sinks.write_queries_xml(queries, str(path))
    content = "".join(p.read_text() for p in sorted(path.glob("part-*")))
    assert content == (
        "<parameters>\n"
        "<query>\n<number>007</number>\n<text>#combine( a &lt; b )</text>\n</query>\n"
        "<query>\n<number>012</number>\n<text>#combine( b &amp; c )</text>\n</query>\n"
        "</parameters>\n"
    )


def test_feature_sink_names_the_neural_feature(spark, tmp_path):
    df = spark.createDataFrame([("007", "d", 2, 0.5, 0.25)], "query_id string, docno string, label int, f1 double, f26 double")
    sinks.write_features(df, str(tmp_path / "train"), name_path=str(tmp_path / "name"))
    assert rows(spark.read.text(str(tmp_path / "train"))) == [("2 qid:007 1:0.5 26:0.25 #d",)]
    assert rows(spark.read.text(str(tmp_path / "name"))) == [("BertScore:26",)]


def test_working_set_lines(spark):
    docs = spark.createDataFrame([("ROUND-00-7-01",), ("ROUND-00-7-00",), ("ROUND-00-195-00",)], "docno string")
    from rankarena.operators.corpus import working_set

    assert rows(sinks.run_lines(working_set(docs))) == [
        ("007 Q0 ROUND-00-7-00 1 -1 indri",),
        ("007 Q0 ROUND-00-7-01 2 -2 indri",),
        ("195 Q0 ROUND-00-195-00 1 -1 indri",),
    ]


def test_scratch_is_the_folder_the_cluster_names(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert scratch.scratch_path(spark, "x").startswith(root)
    df = spark.range(5)
    assert rows(scratch.written(df, "numbers")) == rows(df)
