"""A ranking competition laid over the general-purpose test tables.

Every benchmark text is a query and every document an entry: document ids are dealt out over queries, then
authors, then rounds. The longest text of a field is taken to have won it.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankarena.fixed_values import BOT_NAMES, EXCLUDED_RELEVANCE
from rankarena.functions.ids import bot_name, zero_fill
from rankarena.functions.text import one_line
from rankarena.schema import TREE_ENSEMBLE

AUTHORS = 4
WIDE_AUTHORS = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _number_of(df: DataFrame):
    return df.agg(F.count(F.lit(1))).scalar()


def queries_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = table(spark, sf_dir, "benchmark")
    return topics.select(
        zero_fill(F.col("item_id").cast("string")).alias("query_id"), one_line(F.col("text")).alias("query")
    )


def entries(spark: SparkSession, sf_dir: str, *, authors: int = AUTHORS) -> DataFrame:
    """The competition without any text.

    A field has at most ``authors`` documents, as each document id gives another (round, query, author): the
    window below sorts a handful of rows per group.
    """
    n_queries = _number_of(table(spark, sf_dir, "benchmark"))
    dealt = (
        table(spark, sf_dir, "documents")
        .select("doc_id", "n_chars", n_queries.alias("n_queries"))
        .withColumns({"query_no": F.expr("doc_id % n_queries"), "turn": F.expr("doc_id div n_queries")})
        .withColumns({"author_no": F.expr(f"turn % {authors}"), "round_no": F.expr(f"turn div {authors}")})
    )
    judged = dealt.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    field = Window.partitionBy("round_no", "query_no").orderBy(F.col("n_chars").desc(), "doc_id")
    return judged.select(
        "doc_id",
        F.format_string("ROUND-%02d-%03d-%02d", "round_no", "query_no", "author_no").alias("docno"),
        F.col("round_no").cast("int").alias("round_number"),
        F.format_string("%03d", "query_no").alias("query_id"),
        F.format_string("%02d", "author_no").alias("author_id"),
        F.coalesce("quality", F.lit(0)).cast("int").alias("qrel"),
        F.when(F.col("toxic") == 1, EXCLUDED_RELEVANCE)
        .otherwise(F.coalesce("quality", F.lit(2)))
        .cast("int")
        .alias("ksrel"),
        F.row_number().over(field).alias("pos"),
    )


def competition(spark: SparkSession, sf_dir: str, *, authors: int = AUTHORS) -> DataFrame:
    """The competition table. Texts are joined last, so they are shuffled once.

    They are the large side at any scale and never broadcast; a merge join also spreads them evenly over the
    tasks, however few row groups their files have.
    """
    texts = table(spark, sf_dir, "documents").select("doc_id", "text").hint("merge")
    return (
        entries(spark, sf_dir, authors=authors)
        .join(queries_table(spark, sf_dir), "query_id")
        .join(texts, "doc_id")
        .select("docno", "round_number", "query_id", "author_id", "query", "text", "qrel", "ksrel", "pos")
    )


def texts(spark: SparkSession, sf_dir: str, *, authors: int = AUTHORS) -> DataFrame:
    """(docno, text) of all entries, worked out row by row."""
    n_queries = _number_of(table(spark, sf_dir, "benchmark"))
    dealt = table(spark, sf_dir, "documents").select("doc_id", "text", n_queries.alias("n_queries"))
    turn = f"(doc_id div n_queries) div {authors}", "doc_id % n_queries", f"(doc_id div n_queries) % {authors}"
    return dealt.select(F.format_string("ROUND-%02d-%03d-%02d", *[F.expr(e) for e in turn]).alias("docno"), "text")


def asked_entries(spark: SparkSession, sf_dir: str, *, authors: int = AUTHORS) -> DataFrame:
    """The competition table without its texts."""
    rows = entries(spark, sf_dir, authors=authors).join(queries_table(spark, sf_dir), "query_id")
    return rows.select("docno", "round_number", "query_id", "author_id", "query", "qrel", "ksrel", "pos")


def embedding_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in for a neural model: dot product of a document's and its query's vector."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    pairs = (
        entries(spark, sf_dir)
        .withColumn("n_vectors", _number_of(vectors))
        .select(
            "docno",
            "query_id",
            "round_number",
            F.expr("doc_id % n_vectors").alias("doc_vec"),
            F.expr("cast(query_id as bigint) % n_vectors").alias("query_vec"),
        )
    )
    doc_vectors = vectors.select(F.col("vec_id").alias("doc_vec"), F.col("v").alias("dv"))
    query_vectors = vectors.select(F.col("vec_id").alias("query_vec"), F.col("v").alias("qv"))
    product = F.aggregate(F.zip_with("dv", "qv", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    return (
        pairs.join(doc_vectors, "doc_vec")
        .join(query_vectors, "query_vec")
        .select("docno", "query_id", "round_number", product.alias("score"))
    )


# Three small trees: (tree, node, feature, threshold, left, right, value).
EXAMPLE_TREES = [
    (0, 0, 22, 4.5, 1, 2, None),
    (0, 1, 3, 60.5, 3, 4, None),
    (0, 2, 26, 0.55, 5, 6, None),
    (0, 3, None, None, None, None, -0.5),
    (0, 4, None, None, None, None, 0.125),
    (0, 5, None, None, None, None, 0.75),
    (0, 6, None, None, None, None, 1.25),
    (1, 0, 1, 2.5, 1, 2, None),
    (1, 1, None, None, None, None, -0.25),
    (1, 2, 26, 0.35, 3, 4, None),
    (1, 3, None, None, None, None, 0.0625),
    (1, 4, None, None, None, None, 0.5),
    (2, 0, 3, 300.5, 1, 2, None),
    (2, 1, None, None, None, None, 0.03125),
    (2, 2, 7, 3.5, 3, 4, None),
    (2, 3, None, None, None, None, -0.125),
    (2, 4, None, None, None, None, 0.25),
]


def example_model(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EXAMPLE_TREES, TREE_ENSEMBLE)


def _states(comp: DataFrame, bot: Column) -> DataFrame:
    return comp.select(
        "query_id",
        (F.col("round_number") + 1).alias("epoch"),
        bot.alias("bot"),
        F.when(F.col("author_id") == "00", bot).otherwise(F.col("author_id")).alias("author_id"),
        "text",
        F.col("pos").alias("rank"),
    )


def epoch_history(spark: SparkSession, sf_dir: str, *, bot_type: str, markov: bool = False) -> DataFrame:
    """Epoch states in which the first author's entries are the bot's."""
    return _states(competition(spark, sf_dir), F.lit(bot_name(bot_type, markov)))


def epoch_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those of all bots. An entry's text is read and joined once; its states follow each other."""
    bots = F.array(*[F.lit(name) for name in BOT_NAMES.values()])
    return _states(competition(spark, sf_dir).withColumn("bot", F.explode(bots)), F.col("bot"))


def candidate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generated text for each answer in conversations, as that of a bot of its own."""
    n_queries = _number_of(table(spark, sf_dir, "benchmark"))
    return (
        table(spark, sf_dir, "conversations")
        .where(F.col("role") == "assistant")
        .withColumn("n_queries", n_queries)
        .select(
            F.format_string("%03d", F.expr("conv_id % n_queries")).alias("query_id"),
            F.expr("conv_id div n_queries").cast("int").alias("epoch"),
            F.format_string("BOT%d.%d", "conv_id", "turn").alias("bot"),
            "text",
        )
    )


def topics_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A topic per document."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("topic_id"),
        F.col("source").alias("topic_title"),
        F.array(F.concat(F.lit('"'), "source", F.lit('"')), "lang", F.concat("lang", F.lit(" "), "source")).alias(
            "queries"
        ),
        F.concat(F.lit('A "'), "source", F.lit('" text')).alias("description"),
        F.col("text").alias("backstory"),
    )
