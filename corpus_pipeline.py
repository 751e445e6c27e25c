"""A training corpus in five stages: quality, exact copies, near copies, benchmark passages, tokens."""

from collections.abc import Callable
from fractions import Fraction
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankarena.llm import bpe, decontaminate, exact_dedup, jaccard_join, quality
from rankarena.sources.scratch import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: Rows of whole texts that go to a Python worker at a time. Each task holds such a batch on both sides, and some megabytes
#: are enough for it; the usual 10,000 rows are ten times that.
BATCH_ROWS = 1000
#: Bytes that go to a Python worker at a time, where rows are long: texts, sets of shingles.
BATCH_BYTES = 2 << 20
#: Bytes of text that the quality stage scores together: half of what the operator takes by itself, as later stages share its memory.
QUALITY_SHARD_BYTES = 8 << 20


def with_small_batches(stage: Stage) -> Stage:
    """``stage``, in a session that sends ``BATCH_ROWS`` rows or ``BATCH_BYTES`` to Python at a time (it stays so, as results are computed later)."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run_stage


@with_small_batches
def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it is trained on those that labels call good."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), shard_bytes=QUALITY_SHARD_BYTES)


@with_small_batches
def different_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest identifier."""
    return exact_dedup.without_duplicates(docs)


@with_small_batches
def dissimilar_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity from 0.8) the one with the smallest identifier."""
    return jaccard_join.one_of_each(docs, words=5, similarity=Fraction(80, 100))


@with_small_batches
def unseen_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark passages."""
    found = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep_text=True)
    clean = found.where(~decontaminate.contaminated())
    return clean.select(*[F.col("text" if c == "text" else f"row.`{c}`").alias(c) for c in docs.columns])


@with_small_batches
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers), and whether they decode to the text."""
    encoded = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), file=public_tokenizers.path("byte_bpe_50k.json"))
    n_tokens = (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens")
    return encoded.select("doc_id", "lang", "source", n_tokens, F.sha2("ids", 256).alias("ids_sha256"), "decodes", "ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_texts),
    ("exact", different_texts),
    ("near", dissimilar_texts),
    ("benchmark", unseen_texts),
    ("tokens", tokens),
]

#: The quality model and the token ids can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
