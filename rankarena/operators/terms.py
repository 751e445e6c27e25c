"""Term counts of documents, and term statistics of a corpus or of each field."""

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankarena.functions.text import tokens
from rankarena.sources.scratch import written

Stemmer = Callable[[Column], Column]

#: Words of a scope whose documents meet in one task (some 100 MB there); those of a larger scope are shuffled by term.
SCOPE_WORDS = 5_000_000


def count_words(lists: pa.ListArray) -> tuple[pa.ListArray, pa.ListArray]:
    """The sorted distinct words of each row and their counts. A null row has null words and no counts."""
    n = len(lists)
    row = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    encoded = lists.flatten().dictionary_encode()
    order = pc.sort_indices(encoded.dictionary).to_numpy()
    different = max(len(order), 1)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    # Ranks by the words' bytes, so numbers are in the order of rows and words.
    numbers, counts = np.unique(row * different + rank[encoded.indices.to_numpy()], return_counts=True)
    words = encoded.dictionary.take(pa.array(order[numbers % different]))
    offsets = pa.array(np.searchsorted(numbers // different, np.arange(n + 1)), pa.int32())
    absent = lists.is_null() if lists.null_count else None
    return pa.ListArray.from_arrays(offsets, words, mask=absent), pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32()))


def forward_index(docs: DataFrame, *, stem: Stemmer | None = None) -> DataFrame:
    """Replace ``text`` by its sorted distinct ``terms``, their counts ``tfs``, and the length ``dl``.

    Texts are split by Spark and counted a batch at a time: no shuffle.
    """
    words = tokens(F.col("text"))
    if stem is not None:
        words = F.transform(words, stem)
    rest = [c for c in docs.columns if c != "text"]
    split = docs.select(*rest, words.alias("terms")).withColumn("dl", F.size("terms").cast("long"))
    names = [*rest, "terms", "tfs", "dl"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, tfs = count_words(batch.column("terms"))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], terms, tfs, batch.column("dl")], names)

    kinds = [split.schema[c] for c in rest]
    counted = [T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("tfs", T.ArrayType(T.IntegerType())), T.StructField("dl", T.LongType())]
    return split.mapInArrow(run, T.StructType(kinds + counted))


def postings(index: DataFrame, keys: list[str]) -> DataFrame:
    """One row per document and term."""
    return index.select(*keys, "tfs", F.posexplode("terms").alias("place", "term")).select(
        *keys, "term", F.get("tfs", F.col("place")).alias("tf")
    )


def doc_lengths(index: DataFrame) -> DataFrame:
    return index.select("docno", F.col("dl"), F.size("terms").cast("long").alias("unique_terms"))


def scope_stats(index: DataFrame, scope_cols: list[str]) -> DataFrame:
    """Documents and tokens of each scope; without scope columns one row for everything."""
    return index.groupBy(*scope_cols).agg(
        F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("n_tokens")
    )


def term_counts(index: DataFrame, scope_cols: list[str]) -> DataFrame:
    """Document frequency ``df`` and occurrences ``cf`` of each term of each scope."""
    return (
        postings(index, scope_cols)
        .groupBy(*scope_cols, "term")
        .agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    )


def with_idf(counted: DataFrame, index: DataFrame, scope_cols: list[str]) -> DataFrame:
    """``counted`` with the idf of each term among the documents of ``index``."""
    if scope_cols:
        counted = counted.join(scope_stats(index, scope_cols).select(*scope_cols, "n_docs"), scope_cols)
        n_docs = F.col("n_docs")
    else:
        n_docs = index.agg(F.count(F.lit(1))).scalar()
    return counted.select(*scope_cols, "term", "df", "cf", F.log(n_docs / F.col("df")).alias("idf"))


def _whole_scopes(batches: Iterator[pa.RecordBatch], scope_cols: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole scopes, from batches in the order of scopes, and the number of each row's scope."""
    held = None
    for batch in batches:
        rows = batch if held is None else pa.concat_batches([held, batch])
        if rows.num_rows == 0:
            continue
        new = np.zeros(rows.num_rows, bool)
        for c in scope_cols:
            codes = rows.column(c).dictionary_encode().indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        number = np.cumsum(new)
        last = int(np.searchsorted(number, number[-1]))
        if last:
            yield rows.slice(0, last), number[:last]
        held = rows.slice(last)
    if held is not None:
        yield held, np.zeros(held.num_rows, np.int64)


@dataclass(frozen=True)
class ScopeTerms:
    """Postings of whole scopes: the row, count and entry of each; the scope, term and df of each entry; documents by scope."""

    row: np.ndarray
    tf: np.ndarray
    entry: np.ndarray
    scope: np.ndarray
    term: pa.Array
    df: np.ndarray
    n_docs: np.ndarray


def scope_terms(rows: pa.RecordBatch, number: np.ndarray) -> ScopeTerms:
    lists = rows.column("terms")
    row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    encoded = lists.flatten().dictionary_encode()
    different = max(len(encoded.dictionary), 1)
    entries, entry, df = np.unique(
        number[row] * different + encoded.indices.to_numpy(), return_inverse=True, return_counts=True
    )
    term = encoded.dictionary.take(pa.array(entries % different))
    tf = rows.column("tfs").flatten().to_numpy()
    return ScopeTerms(row, tf, entry, entries // different, term, df, np.bincount(number))


def by_scope(
    index: DataFrame,
    scope_cols: list[str],
    columns: list[str],
    *,
    within: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch],
    across: Callable[[DataFrame], DataFrame],
    schema: T.StructType,
    scope_words: int = SCOPE_WORDS,
) -> DataFrame:
    """What ``within`` makes of the documents of whole scopes, which meet in one task by a shuffle of their ``columns``.

    Documents of scopes with more words than ``scope_words`` go to ``across`` instead. Those of a null scope are left out.
    """
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in scope_cols])
    rows = index.where(known)
    large = rows.groupBy(*scope_cols).agg(F.sum("dl").alias("_words")).where(F.col("_words") > scope_words).select(*scope_cols)
    others = None
    if not large.isEmpty():
        large = written(large, "large-scopes")
        others = across(rows.join(large, scope_cols, "left_semi"))
        rows = rows.join(large, scope_cols, "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, number in _whole_scopes(batches, scope_cols):
            yield within(whole, number)

    made = rows.select(*columns).repartition(*scope_cols).sortWithinPartitions(*scope_cols).mapInArrow(run, schema)
    return made if others is None else made.unionByName(others.select(*made.columns))


def term_stats(index: DataFrame, scope_cols: list[str], *, scope_words: int = SCOPE_WORDS) -> DataFrame:
    """Document frequency, occurrences and idf of each term of each scope."""
    if not scope_cols:
        return with_idf(term_counts(index, scope_cols), index, scope_cols)
    names = [*scope_cols, "term", "df", "cf", "n_docs"]

    def within(rows: pa.RecordBatch, number: np.ndarray) -> pa.RecordBatch:
        found = scope_terms(rows, number)
        cf = np.zeros(len(found.df), np.int64)
        np.add.at(cf, found.entry, found.tf)
        first = pa.array(np.searchsorted(number, found.scope))
        values = [found.term, pa.array(found.df, pa.int64()), pa.array(cf), pa.array(found.n_docs[found.scope], pa.int64())]
        return pa.RecordBatch.from_arrays([*[rows.column(c).take(first) for c in scope_cols], *values], names)

    def with_sizes(documents: DataFrame) -> DataFrame:
        sizes = scope_stats(documents, scope_cols).select(*scope_cols, "n_docs")
        return term_counts(documents, scope_cols).join(sizes, scope_cols)

    counts = [T.StructField(c, T.LongType()) for c in ("df", "cf", "n_docs")]
    schema = T.StructType([*[index.schema[c] for c in scope_cols], T.StructField("term", T.StringType()), *counts])
    counted = by_scope(
        index, scope_cols, [*scope_cols, "terms", "tfs"], within=within, across=with_sizes, schema=schema, scope_words=scope_words
    )
    return counted.select(*scope_cols, "term", "df", "cf", F.log(F.col("n_docs") / F.col("df")).alias("idf"))


def query_terms(queries: DataFrame, *, stem: Stemmer | None = None) -> DataFrame:
    """``(query_id, qterms)`` with the distinct terms of each query."""
    words = tokens(F.col("query"))
    if stem is not None:
        words = F.transform(words, stem)
    return queries.select("query_id", F.array_distinct(words).alias("qterms"))


@dataclass(frozen=True)
class TermIndex:
    """Stored term counts of documents and stored term statistics of their scopes.

    ``documents`` is a :func:`forward_index`, ``terms`` its :func:`term_stats`.
    """

    documents: DataFrame
    terms: DataFrame
    scope_cols: list[str] = field(default_factory=list)
    stem: Stemmer | None = None


def build_index(docs: DataFrame, *, scope_cols: list[str] | None = None, stem: Stemmer | None = None) -> TermIndex:
    """Write the index of ``docs`` to the shared folder.

    Features read both tables several times. Stored, the texts are split into words once, each step reads only
    the columns it needs, and the planner knows how large the statistics are when it joins them.
    """
    scope_cols = list(scope_cols or [])
    documents = written(forward_index(docs, stem=stem), "index-documents")
    terms = written(term_stats(documents, scope_cols), "index-terms")
    return TermIndex(documents=documents, terms=terms, scope_cols=scope_cols, stem=stem)
