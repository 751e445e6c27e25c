"""Assembling the competition table, and looking things up in it."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankarena.fixed_values import RUN_TAG
from rankarena.functions.ids import canonical_query_id, docno_parts
from rankarena.operators.ordinals import HOT_ROWS, group_sizes, with_ordinal
from rankarena.sources.scratch import written


def assemble_corpus(
    *,
    docs: DataFrame,
    quality: DataFrame,
    relevance: DataFrame,
    positions: DataFrame,
    queries: DataFrame,
) -> DataFrame:
    """One row per judged document with its text, grades, position and query.

    The narrow tables are joined first; the texts are then shuffled once, by docno.
    """
    judged = quality.join(relevance, "docno").join(positions, "docno")
    judged = judged.withColumns(docno_parts(F.col("docno"), strict=True))
    asked = queries.select(canonical_query_id(F.col("query_id")).alias("query_id"), "query")
    return (
        judged.join(asked, "query_id")
        .join(docs.select("docno", "text"), "docno")
        .select("docno", "round_number", "query_id", "author_id", "query", "text", "qrel", "ksrel", "pos")
    )


def last_round(comp: DataFrame) -> Column:
    """The last round of the whole table, as a scalar subquery."""
    return comp.agg(F.max("round_number")).scalar()


def field_texts(
    comp: DataFrame, *, query_id: str | None = None, round_number: int | str = "last"
) -> DataFrame:
    """Authors and texts of one round (by default the last one of the table), for one query or for all."""
    wanted = last_round(comp) if round_number == "last" else F.lit(round_number)
    rows = comp.where(F.col("round_number") == wanted)
    if query_id is not None:
        rows = rows.where(F.col("query_id") == canonical_query_id(F.lit(query_id)))
    return rows.select("query_id", "round_number", "author_id", "text")


def reference_texts(comp: DataFrame, *, texts: DataFrame | None = None) -> DataFrame:
    """Each query's first document: earliest round, then lowest docno.

    The documents are found without their texts, which are then fetched by docno: from ``texts`` (docno, text), if given. Then
    the competition's texts aren't needed, and those of ``texts`` aren't shuffled unless there are very many queries.
    """
    first = comp.groupBy("query_id").agg(F.min(F.struct("round_number", "docno")).alias("first"))
    docnos = first.select(F.col("first.docno").alias("docno"))
    if texts is None:
        return comp.join(docnos, "docno").select("query_id", "query", "docno", F.col("text").alias("reference_text"))
    # Written, so that the planner knows how few they are.
    found = written(comp.join(docnos, "docno").select("query_id", "query", "docno"), "references")
    return found.join(texts.select("docno", F.col("text").alias("reference_text")), "docno").select("query_id", "query", "docno", "reference_text")


def winners(comp: DataFrame) -> DataFrame:
    return comp.where(F.col("pos") == 1)


def contested(comp: DataFrame) -> DataFrame:
    """Rows of fields that have two members or more."""
    shared = group_sizes(comp, ["query_id", "round_number"]).where(F.col("n") > 1)
    return comp.join(shared.select("query_id", "round_number"), ["query_id", "round_number"], "left_semi")


def field_sizes(comp: DataFrame) -> DataFrame:
    return group_sizes(comp, ["query_id", "round_number"]).withColumnRenamed("n", "members")


def query_index(comp: DataFrame) -> DataFrame:
    """One text per query id; a later round's wording wins, then the higher one."""
    latest = F.max(F.struct("round_number", "query")).alias("latest")
    return comp.groupBy("query_id").agg(latest).select("query_id", F.col("latest.query").alias("query"))


def participants(comp: DataFrame) -> DataFrame:
    """Distinct (author, query) couples."""
    return comp.select("author_id", "query_id").distinct()


def query_docnos(docs: DataFrame, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Docnos of each query with their 1-based place, one row each, in docno order."""
    rows = docs.select("docno", docno_parts(F.col("docno"))["query_id"].alias("query_id"))
    return with_ordinal(rows, scope=["query_id"], order={"docno": True}, name="place", hot_rows=hot_rows)


def working_set(docs: DataFrame, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The documents to be ranked for their own query, as rows of a run."""
    return query_docnos(docs, hot_rows=hot_rows).select(
        "query_id",
        F.lit("Q0").alias("q0"),
        "docno",
        F.col("place").alias("rank"),
        (-F.col("place")).alias("score"),
        F.lit(RUN_TAG).alias("run_id"),
    )
