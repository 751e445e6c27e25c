"""Column types of the tables that the library reads and writes."""

from pyspark.sql import types as T

from rankarena.fixed_values import NEURAL_FEATURE

FEATURE_COLUMNS = [f"f{i}" for i in range(1, NEURAL_FEATURE + 1)]
TEXT_FEATURE_COLUMNS = FEATURE_COLUMNS[:-1]

COMPETITION = T.StructType(
    [
        T.StructField("docno", T.StringType()),
        T.StructField("round_number", T.IntegerType()),
        T.StructField("query_id", T.StringType()),
        T.StructField("author_id", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("qrel", T.IntegerType()),
        T.StructField("ksrel", T.IntegerType()),
        T.StructField("pos", T.IntegerType()),
    ]
)

DELTAS = T.StructType(
    COMPETITION.fields
    + [T.StructField(name, T.IntegerType()) for name in ("delta", "delta_2", "delta_3")]
)

PAIRS = T.StructType(
    DELTAS.fields
    + [T.StructField("completion", T.StringType()), T.StructField("prompt", T.StringType())]
)

RUN = T.StructType(
    [
        T.StructField("query_id", T.StringType()),
        T.StructField("q0", T.StringType()),
        T.StructField("docno", T.StringType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("run_id", T.StringType()),
    ]
)

QRELS = T.StructType(
    [
        T.StructField("query_id", T.StringType()),
        T.StructField("q0", T.StringType()),
        T.StructField("docno", T.StringType()),
        T.StructField("rel", T.IntegerType()),
    ]
)

EPOCH_STATE = T.StructType(
    [
        T.StructField("query_id", T.StringType()),
        T.StructField("epoch", T.IntegerType()),
        T.StructField("bot", T.StringType()),
        T.StructField("author_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("rank", T.IntegerType()),
    ]
)

TOPICS = T.StructType(
    [
        T.StructField("topic_id", T.StringType()),
        T.StructField("topic_title", T.StringType()),
        T.StructField("queries", T.ArrayType(T.StringType())),
        T.StructField("description", T.StringType()),
        T.StructField("backstory", T.StringType()),
        T.StructField("doc", T.StringType()),
    ]
)

TREE_ENSEMBLE = T.StructType(
    [
        T.StructField("tree", T.IntegerType()),
        T.StructField("node", T.IntegerType()),
        T.StructField("feature", T.IntegerType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("left", T.IntegerType()),
        T.StructField("right", T.IntegerType()),
        T.StructField("value", T.DoubleType()),
    ]
)
