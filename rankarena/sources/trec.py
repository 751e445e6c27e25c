"""Readers for the text formats of retrieval experiments.

All of them split large files over tasks. Where a key may occur twice and the last one counts, "last" is taken
by file path, block and row, not by task order.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankarena import schema
from rankarena.fixed_values import NEURAL_FEATURE
from rankarena.functions.ids import canonical_query_id, epoch_to_round
from rankarena.functions.text import strip


def _place() -> Column:
    """Where a row stands in its files, sortable."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    ).alias("place")


def _records(spark: SparkSession, path: str | list[str], separator: str | None = None) -> DataFrame:
    """Text records with a sortable ``place`` in their files."""
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    return reader.text(path).select("value", _place())


def _or_error(valid: Column, value: Column, message: str, shown: Column) -> Column:
    return F.when(valid, value).otherwise(
        F.raise_error(F.concat(F.lit(message), F.substring(shown, 1, 200))).cast("string")
    )


def read_trectext(
    spark: SparkSession, path: str | list[str], *, unique: bool = False, strict: bool = True
) -> DataFrame:
    """``(docno, text)`` from DOC / DOCNO / TEXT blocks; bytes that are not UTF-8 are dropped.

    The last block of a docno wins. ``unique=True`` says that no docno occurs twice, which saves a shuffle of
    all texts. A block without DOCNO or TEXT is an error; ``strict=False`` leaves such blocks out. Text without any
    of the tags, as before the first block, is skipped. Genuine replacement characters stay.
    """
    value = F.col("value")
    tags = ("<DOCNO>", "<TEXT>", "</DOC>")
    tagged = value.contains(tags[0]) | value.contains(tags[1]) | value.contains(tags[2])
    blocks = _records(spark, path, separator="<DOC>").where(tagged)
    whole = value.contains("<DOCNO>") & value.contains("<TEXT>")
    if strict:
        blocks = blocks.withColumn("value", _or_error(whole, value, "not a document block: ", value))
    else:
        blocks = blocks.where(whole)

    def between(tag: str) -> Column:
        opened = F.split_part(value, F.lit(f"<{tag}>"), F.lit(2))
        return F.split_part(opened, F.lit(f"</{tag}>"), F.lit(1))

    # Spark decodes invalid bytes to the replacement character, in records that hold such bytes.
    def valid(part: Column) -> Column:
        return F.when(F.is_valid_utf8(value), part).otherwise(F.replace(part, F.lit("\N{REPLACEMENT CHARACTER}"), F.lit("")))

    docs = blocks.select(
        valid(between("DOCNO")).alias("docno"),
        strip(valid(between("TEXT"))).alias("text"),
        "place",
    )
    if unique:
        return docs.drop("place")
    return docs.groupBy("docno").agg(F.max_by("text", "place").alias("text"))


def read_judgements(
    spark: SparkSession, path: str | list[str], *, value: str, epoch_docnos: bool = False
) -> DataFrame:
    """``(docno, <value>)`` from four white-space separated columns (quality, relevance or position files)."""
    parts = F.split(strip(F.col("value")), r"\s+")
    docno = F.get(parts, F.lit(2))
    return (
        spark.read.text(path)
        .where(F.length(strip(F.col("value"))) > 0)
        .select(
            (epoch_to_round(docno, anywhere=True) if epoch_docnos else docno).alias("docno"),
            F.get(parts, F.lit(3)).cast("int").alias(value),
        )
    )


def read_queries(
    spark: SparkSession, path: str | list[str], *, legacy_colon: bool = False, strict: bool = True
) -> DataFrame:
    """``(query_id, query)`` from ``id:text`` lines; the last line of an id wins.

    ``legacy_colon`` ends the text at a second colon. A line without a colon is an error unless it is blank;
    ``strict=False`` leaves such lines out.
    """
    value = F.col("value")
    parts = F.split(F.col("value"), ":", -1 if legacy_colon else 2)
    found = _records(spark, path).where(F.length(strip(value)) > 0)
    if strict:
        found = found.withColumn("value", _or_error(value.contains(":"), value, "not a query line: ", value))
    lines = (
        found.where(value.contains(":"))
        .select(
            canonical_query_id(F.get(parts, F.lit(0))).alias("query_id"),
            strip(F.get(parts, F.lit(1))).alias("query"),
            "place",
        )
    )
    return lines.groupBy("query_id").agg(F.max_by("query", "place").alias("query"))


def read_qrels(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(query_id, docno, rel)``; ``EPOCH`` docnos become ``ROUND`` ones, and the first judgement of a pair counts."""
    rows = spark.read.schema(schema.QRELS).csv(path, sep=" ", quote="").select("*", _place())
    named = rows.select(
        canonical_query_id(F.col("query_id")).alias("query_id"),
        epoch_to_round(F.col("docno")).alias("docno"),
        "rel",
        "place",
    )
    return named.groupBy("query_id", "docno").agg(F.min_by("rel", "place").alias("rel"))


def read_run(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The six columns of a run or score file."""
    return spark.read.schema(schema.RUN).csv(path, sep=" ", quote="")


def read_features(spark: SparkSession, path: str | list[str], *, width: int = NEURAL_FEATURE) -> DataFrame:
    """``(query_id, docno, label, f1 … f<width>)`` from ``label qid:<id> 1:<v> … #docno`` lines.

    A line must have exactly one ``#``.
    """
    sides = F.split(F.col("value"), "#")
    line = spark.read.text(path).select(
        _or_error(F.size(sides) == 2, F.col("value"), "not a feature line: ", F.col("value")).alias("value")
    )
    split = line.select(
        F.trim(F.split_part("value", F.lit("#"), F.lit(1))).alias("body"),
        strip(F.split_part("value", F.lit("#"), F.lit(2))).alias("docno"),
    ).select(
        "docno",
        F.split_part("body", F.lit(" "), F.lit(1)).cast("double").alias("label"),
        F.expr(r"str_to_map(regexp_replace(body, '^[^ ]+ +', ''), ' +', ':')").alias("values"),
    )
    return split.select(
        canonical_query_id(F.try_element_at("values", F.lit("qid"))).alias("query_id"),
        "docno",
        "label",
        *[
            F.try_element_at("values", F.lit(str(i))).cast("double").alias(f"f{i}")
            for i in range(1, width + 1)
        ],
    )
