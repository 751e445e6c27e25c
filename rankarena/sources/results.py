"""Generated documents that come back in batches, and stay when a run is killed.

A batch is a folder under its own identifier, and it counts once Spark has marked it as whole. Committing a batch that is
there already does nothing; one that was left unfinished is written anew. Whoever starts again asks for the topics that no
whole batch has, by an anti join.
"""

import re

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankarena import schema
from rankarena.functions.text import within_word_limit

_DONE = "_SUCCESS"


def _batch_path(path: str, batch: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9.-]+", batch):
        raise ValueError(f"{batch!r} can't name a batch: letters, digits, points and hyphens only")
    return f"{path.rstrip('/')}/batch={batch}"


def _accepted(doc: Column) -> Column:
    return F.coalesce(within_word_limit(doc), F.lit(False))


def is_committed(path: str, batch: str) -> bool:
    store, root = fs.FileSystem.from_uri(_batch_path(path, batch))
    return store.get_file_info(f"{root}/{_DONE}").type == fs.FileType.File


def commit_batch(results: DataFrame, path: str, batch: str) -> bool:
    """Write ``topic_id`` and ``doc`` under the batch's identifier; False if it has been committed before."""
    if is_committed(path, batch):
        return False
    rows = results.select(F.col("topic_id").cast("string"), F.col("doc").cast("string"))
    # Words are counted once, here.
    rows.withColumn("accepted", _accepted(F.col("doc"))).write.mode("overwrite").parquet(_batch_path(path, batch))
    return True


def committed_batches(path: str) -> list[str]:
    """Identifiers of the whole batches, a few bytes for each run."""
    store, root = fs.FileSystem.from_uri(path)
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    names = [info.base_name.removeprefix("batch=") for info in found if info.base_name.startswith("batch=")]
    return sorted(name for name in names if is_committed(path, name))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """``topic_id``, ``doc``, ``batch`` and ``accepted`` (within the word limit), one row a topic.

    Of a topic that two batches have, the first batch by name counts. A null document isn't accepted.
    """
    kinds = "topic_id string, doc string, accepted boolean"
    batches = committed_batches(path)
    if not batches:
        rows = spark.createDataFrame([], f"{kinds}, batch string")
    else:
        folders = [_batch_path(path, b) for b in batches]
        rows = spark.read.option("basePath", path).schema(f"{kinds}, batch string").parquet(*folders)
    first = rows.groupBy("topic_id").agg(F.min(F.struct("batch", "doc", "accepted")).alias("first"))
    # Batches that were committed without it are told apart here.
    accepted = F.coalesce("first.accepted", _accepted(F.col("first.doc")))
    return first.select("topic_id", "first.doc", "first.batch", accepted.alias("accepted"))


def waiting_topics(topics: DataFrame, path: str) -> DataFrame:
    """Topics without an accepted document in any whole batch; a text that is too long has to be generated again."""
    done = read_results(topics.sparkSession, path).where("accepted").select("topic_id")
    return topics.join(done, "topic_id", "left_anti")


def topics_with_documents(topics: DataFrame, results: DataFrame) -> DataFrame:
    """``topics`` with the column ``doc`` filled where there is an accepted document."""
    accepted = results.where("accepted").select("topic_id", "doc")
    given = topics.drop("doc").join(accepted, "topic_id", "left")
    return given.select(*[c for c in schema.TOPICS.names if c in given.columns])
