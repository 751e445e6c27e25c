import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rankarena.functions import ids, scores, text


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "given, expected",
    [("2", "002"), ("002", "002"), ("0002", "002"), ("1234", "1234"), ("0", "000"), ("000", "000"), ("q7", "q7"), (" 7 ", "007")],
)
def test_canonical_query_id(spark, given, expected):
    assert one(spark, given, ids.canonical_query_id) == expected


def test_zero_fill_never_cuts(spark):
    assert one(spark, "12345", ids.zero_fill) == "12345"
    assert one(spark, "7", lambda c: ids.zero_fill(c, 5)) == "00007"


def test_docno_parts(spark):
    df = spark.createDataFrame([("ROUND-00-195-03",), ("ROUND-01-7-03-extra",), ("ROUND-01",)], "docno string")
    parts = df.select(*[c.alias(n) for n, c in ids.docno_parts(F.col("docno")).items()])
    assert [tuple(r) for r in parts.collect()] == [(0, "195", "03"), (1, "007", "03"), (1, None, None)]
    strict = df.select(*[c.alias(n) for n, c in ids.docno_parts(F.col("docno"), strict=True).items()])
    with pytest.raises(Exception, match="four parts"):
        strict.collect()


def test_epoch_and_segments(spark):
    assert one(spark, "EPOCH-01-195-02", ids.epoch_to_round) == "ROUND-01-195-02"
    assert one(spark, "ROUND-01-EPOCH-02", ids.epoch_to_round) == "ROUND-01-EPOCH-02"
    assert one(spark, "ROUND-01-195-02", ids.last_segment) == "02"
    assert one(spark, "NMTBOT", ids.last_segment) == "NMTBOT"
    assert one(spark, "04", lambda c: ids.internal_doc_id(ids.internal_docno(c))) == "04"


def test_bot_names(spark):
    assert ids.bot_name("tops") == "NMTBOT" and ids.bot_name("self", True) == "MSBOT"
    with pytest.raises(ValueError):
        ids.bot_name("none")


@pytest.mark.parametrize("given", ["", "  ", "a", " a  b\tc\n", "a b", "　a\x1cb\x85 ", "x​y"])
def test_words_and_strip_are_those_of_python(spark, given):
    assert one(spark, given, text.word_count) == len(given.split())
    assert one(spark, given, text.strip) == given.strip()


@pytest.mark.parametrize(
    ("given", "shown"),
    [
        ("plain", "plain"),
        ("it's", "its"),
        ('say "hi"', "say hi"),
        ("it's \"both\"", r"it\s both"),
        ("back\\slash and 'quote'", r"back\\slash and quote"),
        ("line\nbreak\r\ttab", r"line\nbreak\r\ttab"),
        ("\x00\x1b\x7f\xa0\xad", r"\x00\x1b\x7f\xa0\xad"),
        ("é ü ñ 漢字", "é ü ñ 漢字"),
        ("\u200b\u2028\u3000\ufeff", r"\u200b\u2028\u3000\ufeff"),
        ("\U0001f600 \U000e0001", "\U0001f600 \\U000e0001"),
        ("", ""),
    ],
)
def test_unquoted_literal_escapes_what_cannot_be_printed(spark, given, shown):
    assert one(spark, given, text.unquoted_literal) == shown


def test_ordinal_suffix(spark):
    df = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 11, 21)], "x int")
    assert [r.y for r in df.select(text.ordinal_suffix(F.col("x")).alias("y")).collect()] == [
        "st", "nd", "rd", "th", "th", "th",
    ]


def test_word_limit(spark):
    assert one(spark, "w " * 150, text.within_word_limit) is True
    assert one(spark, "w " * 151, text.within_word_limit) is False


def test_prompts(spark):
    df = spark.createDataFrame([("T", "q", "S", ["a", "b", "c", "d"])], "t string, q string, s string, subs array<string>")
    row = df.select(
        text.fine_tune_prompt(F.col("t"), F.col("q")).alias("tune"),
        text.initial_document_prompt(F.col("s"), F.col("subs")).alias("first"),
    ).first()
    assert row.tune.startswith("Given the query 'q',") and row.tune.endswith("text: 'T'.\n\nGenerated text: ")
    assert "subtopics: 'a','b', 'c'\n\nScenario: S\n\nGenerated text:" in row.first


@pytest.mark.parametrize("logits", [[2.5], [0.1, 0.7], [-1000.0, 1000.0], [3.0, 3.0, 3.0]])
def test_relevance_from_logits(spark, logits):
    highest = max(logits)
    expected = logits[-1]
    if len(logits) > 1:
        expected -= highest + math.log(sum(math.exp(v - highest) for v in logits))
    assert one(spark, logits, scores.relevance_from_logits, "array<double>") == pytest.approx(expected)


@pytest.mark.parametrize(("prompt", "tokens"), [
    (0, 700), (3195, 700), (3196, 700), (3197, 650), (3246, 650), (3247, 600), (3895, 0), (3896, 0), (3897, -50), (4000, -150), (9000, -5150),
])
def test_completion_tokens_in_steps_of_fifty(spark, prompt, tokens):
    assert one(spark, prompt, scores.completion_tokens, "long") == tokens


def test_min_max_of_equal_scores_is_zero(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "docno string, score double")
    from rankarena.operators.features import normalise_scores

    assert rows(normalise_scores(df)) == [("a", 0.0), ("b", 0.0)]
    scoped = spark.createDataFrame(
        [("x", "a", 1.0), ("x", "b", 3.0), ("x", "c", 2.0), ("y", "d", 9.0)], "q string, docno string, score double"
    )
    assert rows(normalise_scores(scoped, scope_cols=["q"]), "docno", "score") == [
        ("a", 0.0), ("b", 1.0), ("c", 0.5), ("d", 0.0),
    ]
