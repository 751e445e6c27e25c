"""Registered queries of this subpackage, and their SQL twins."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankarena.llm import (
    alignment, bpe, decontaminate, exact_dedup, jaccard_join, language_id, lexical_search, licenses, quality, secrets, simhash,
    token_shards, warc,
)
from rankarena.sources.scratch import scratch_path

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), file=VOCABULARY)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents lie in a tree of directories: their source, then thousands, then fifties of identifiers.

    Every fifth is called a licence file, half of these one directory higher; those with a notice speak for their directory.
    """
    thousand, fifty = F.expr("doc_id div 1000").cast("string"), F.expr("doc_id div 50").cast("string")
    called = F.concat(F.when(F.expr("doc_id % 5 = 0"), "LICENSE-").otherwise(""), F.col("doc_id").cast("string"))
    above = F.concat_ws("/", "source", thousand, F.when(F.expr("doc_id % 10 = 0"), None).otherwise(fifty), called)
    return licenses.scan(table(spark, sf_dir, "documents").withColumn("path", above))


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "shards")
    return token_shards.write_shards(
        table(spark, sf_dir, "documents"), path, file=public_tokenizers.path("byte_bpe_50k.tiktoken")
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents")).drop("probabilities", "positions")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.span_digest(secrets.secret_spans(table(spark, sf_dir, "documents")))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    manifest = warc.write_archives(warc.with_revisits(table(spark, sf_dir, "pages")), path)
    records = warc.read_archives(manifest, path)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.linked_counts(table(spark, sf_dir, "documents"), file_a=VOCABULARY, file_b=PIECES)


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_licenses": op2_licenses,
    "op3_token_shards": op3_token_shards,
    "op4_language_id": op4_language_id,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_decontaminate": op6_decontaminate,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_secrets": op8_secrets,
    "op9_warc": op9_warc,
    "op10_quality": op10_quality,
    "op11_alignment": op11_alignment,
    "op12_simhash": op12_simhash,
    "op13_lexical_search": op13_lexical_search,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

SQL = {
    "op7_exact_dedup": f"""
        WITH bodies AS (
            SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS body FROM documents
        ), keeps AS (
            SELECT body, max(doc_id) AS keep_id, count(*) AS group_size, sha256(body) AS text_sha256
            FROM bodies GROUP BY body
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM bodies JOIN keeps USING (body)
    """,
    "op9_warc": """
        WITH payloads AS (
            SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
                   sha256(coalesce(html, '')) AS payload_digest
            FROM pages
        ), firsts AS (
            SELECT *, CASE WHEN payload_bytes >= 100
                           THEN nullif(min(page_id) OVER (PARTITION BY payload_digest), page_id) END AS refers_to
            FROM payloads
        )
        SELECT *, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type FROM firsts
    """,
    "op13_lexical_search": rf"""
        WITH bodies AS (
            SELECT row_number() OVER () AS place, doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS body FROM documents
        ), words AS (
            SELECT place, unnest(regexp_extract_all(body, '{_TERM}')) AS term FROM bodies
        ), counts AS (
            SELECT place, term, count(*) AS tf FROM words GROUP BY ALL
        ), lengths AS (
            SELECT place, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY place
        ), corpus AS (
            SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lengths
        ), asked AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS term
            FROM benchmark
        ), weights AS (
            SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM counts, corpus GROUP BY term, n_docs
        ), scores AS (
            SELECT item_id, place,
                   CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
            FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN lengths USING (place), corpus
            GROUP BY item_id, place
        ), ranked AS (
            SELECT item_id, doc_id, score,
                   CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank
            FROM scores JOIN bodies USING (place) WHERE score > 0
        )
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
    """,
}
