"""How positions move from round to round."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTRY = ["query_id", "author_id", "round_number"]


def delta_name(lag: int) -> str:
    return "delta" if lag == 1 else f"delta_{lag}"


def rank_deltas(comp: DataFrame, *, lags: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Add the position ``lag`` rounds ago less the position now: positive means moved up.

    0 where that round has no entry of the author, so a gap in the rounds is not bridged. Should an entry
    exist twice, the better position counts as the earlier one.

    Each position is sent to the rounds that look back at it and met there on the full (query, author, round)
    key. Authors with very many rounds thus spread over all tasks, which a window per author would not allow.
    """
    seen = comp.select(
        "query_id",
        "author_id",
        "round_number",
        "pos",
        F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag"),
    )
    earlier = seen.groupBy(
        "query_id", "author_id", (F.col("round_number") + F.col("lag")).alias("round_number")
    ).agg(*[F.min(F.when(F.col("lag") == k, F.col("pos"))).alias(f"_pos_{k}") for k in lags])
    deltas = {
        delta_name(k): F.coalesce(F.col(f"_pos_{k}") - F.col("pos"), F.lit(0)).cast("int") for k in lags
    }
    return (
        comp.join(earlier, ENTRY, "left")
        .withColumns(deltas)
        .select(*comp.columns, *deltas)
    )


def trajectories(deltas: DataFrame) -> DataFrame:
    """The series of each author on each query, one row per round."""
    return deltas.select(
        "author_id", "query_id", "round_number", "delta", "pos", "qrel", "ksrel"
    )


def trajectory_spans(comp: DataFrame) -> DataFrame:
    """First and last round and the number of entries of each author on each query."""
    return comp.groupBy("author_id", "query_id").agg(
        F.min("round_number").alias("first_round"),
        F.max("round_number").alias("last_round"),
        F.count(F.lit(1)).alias("entries"),
    )
