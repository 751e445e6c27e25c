"""A term index that grows round by round, in a folder that its user names, lists and clears.

Each round has two tables: the term counts of its documents, and how often each term is in them. Adding a round writes its
own tables only; what a term is like in several rounds is added up when the index is opened, from one row a round and
term. A round counts once both of its tables are whole, so a run that was killed is simply repeated.
"""

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankarena.operators.terms import Stemmer, TermIndex, forward_index, term_counts, with_idf

_TABLES = ("documents", "terms")


def _table(path: str, name: str, round_number: int) -> str:
    return f"{path.rstrip('/')}/{name}/round={round_number}"


def _exists(uri: str, kind: fs.FileType) -> bool:
    store, root = fs.FileSystem.from_uri(uri)
    return store.get_file_info(root).type == kind


def rounds_in(path: str) -> list[int]:
    """The rounds that are whole."""
    store, root = fs.FileSystem.from_uri(f"{path.rstrip('/')}/{_TABLES[0]}")
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    numbers = [int(info.base_name.removeprefix("round=")) for info in found if info.base_name.startswith("round=")]
    return sorted(n for n in numbers if all(_exists(f"{_table(path, name, n)}/_SUCCESS", fs.FileType.File) for name in _TABLES))


def add_round(
    docs: DataFrame, path: str, round_number: int, *, scope_cols: list[str] | None = None, stem: Stemmer | None = None
) -> None:
    """Index the documents of a round, which have ``docno``, ``text`` and the scope columns; the same round is replaced.

    Scope columns and stemmer must be the same for all rounds of an index.
    """
    spark, scope_cols = docs.sparkSession, list(scope_cols or [])
    made = forward_index(docs, stem=stem)
    documents = _table(path, "documents", round_number)
    made.write.mode("overwrite").parquet(documents)
    stored = spark.read.schema(made.schema).parquet(documents)
    term_counts(stored, scope_cols).write.mode("overwrite").parquet(_table(path, "terms", round_number))


def remove_round(path: str, round_number: int) -> None:
    """Delete the tables of a round; its terms first, so that it doesn't count any more."""
    for name in reversed(_TABLES):
        uri = _table(path, name, round_number)
        if _exists(uri, fs.FileType.Directory):
            store, root = fs.FileSystem.from_uri(uri)
            store.delete_dir(root)


def open_index(
    spark: SparkSession, path: str, *, rounds: list[int] | None = None, scope_cols: list[str] | None = None, stem: Stemmer | None = None
) -> TermIndex:
    """The index of some rounds, by default of all: the same as :func:`build_index` makes of their documents."""
    scope_cols = list(scope_cols or [])
    present = rounds_in(path)
    chosen = present if rounds is None else rounds
    missing = sorted(set(chosen) - set(present))
    if missing or not chosen:
        raise ValueError(f"no such rounds in {path}: {missing or 'it has none'}")
    documents = spark.read.parquet(*[_table(path, "documents", n) for n in chosen])
    counted = spark.read.parquet(*[_table(path, "terms", n) for n in chosen])
    added = counted.groupBy(*scope_cols, "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    return TermIndex(documents=documents, terms=with_idf(added, documents, scope_cols), scope_cols=scope_cols, stem=stem)
