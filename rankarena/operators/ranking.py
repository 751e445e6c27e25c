"""Ranking fields with a model, and stepping a competition from one epoch to the next."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankarena.functions.ids import internal_doc_id, internal_docno, last_segment
from rankarena.functions.text import within_word_limit
from rankarena.operators.ensemble import score_ensemble
from rankarena.operators.features import ltr_features
from rankarena.operators.neural import Scorer
from rankarena.operators.ordinals import HOT_ROWS, with_ordinal
from rankarena.operators.terms import TermIndex
from rankarena.sources.scratch import written

FIELD = ["query_id", "round_number"]
EPOCH_FIELD = ["query_id", "epoch", "bot"]


def rank_by_score(
    scores: DataFrame,
    *,
    scope_cols: list[str],
    sizes_from: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Rank 1 is the highest score of a scope; equal scores go by docno."""
    return with_ordinal(
        scores,
        scope=scope_cols,
        order={"score": False, "docno": True},
        name="rank",
        sizes_from=sizes_from,
        hot_rows=hot_rows,
    )


def rank_fields(
    *,
    docs: DataFrame,
    queries: DataFrame,
    model: DataFrame,
    scores: DataFrame | None = None,
    load_scorer: Callable[[], Scorer] | None = None,
    scope_cols: list[str] | None = None,
    index: TermIndex | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Rank the documents of every field in one job.

    Statistics and scaling cover one field each, the way a field is ranked on its own.
    """
    scope_cols = list(FIELD if scope_cols is None else scope_cols)
    features = ltr_features(
        docs=docs, queries=queries, scores=scores, load_scorer=load_scorer, scope_cols=scope_cols, mode="test", index=index
    )
    scored = score_ensemble(features, model, keep=[*scope_cols, "docno"])
    return rank_by_score(scored, scope_cols=scope_cols, sizes_from=docs, hot_rows=hot_rows)


def candidates_within_limit(candidates: DataFrame) -> DataFrame:
    """Flag candidate texts by the word limit; those over it have to be generated again."""
    return candidates.withColumn("accepted", within_word_limit(F.col("text")))


def upsert_candidates(field: DataFrame, candidates: DataFrame) -> DataFrame:
    """The field which each candidate joins: all other authors' texts and the candidate's, which replaces its own.

    ``field`` has ``query_id, epoch, author_id, text``; ``candidates`` has ``query_id, epoch, bot, text``.
    Authors are known by the last segment of their name; of several with one segment the one with the largest whole
    name counts.
    """
    author = last_segment(F.col("author_id"))
    bots = candidates.select(*EPOCH_FIELD)
    # An author who is there twice has the larger text.
    named = ["query_id", "epoch", "author_id"]
    segments = field.groupBy("query_id", "epoch", author.alias("_segment")).agg(F.max("author_id").alias("author_id"))
    others = (
        field.join(segments, named)
        .groupBy(*named, "_segment")
        .agg(F.max("text").alias("text"))
        .join(bots, ["query_id", "epoch"])
        .where(F.col("_segment") != last_segment(F.col("bot")))
        .select(*EPOCH_FIELD, F.col("_segment").alias("author_id"), "text")
    )
    own = candidates.select(*EPOCH_FIELD, last_segment(F.col("bot")).alias("author_id"), "text")
    return others.unionByName(own)


def opponents(states: DataFrame) -> DataFrame:
    return states.where(F.col("author_id") != F.col("bot"))


def epoch_step(
    *,
    field: DataFrame,
    candidates: DataFrame,
    queries: DataFrame,
    model: DataFrame,
    load_scorer: Callable[[], Scorer] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Let accepted candidates join their fields and rank these: the epoch's state, one row per author.

    A model that asks for the neural feature needs ``load_scorer``, which scores candidates like all others.
    """
    accepted = candidates.where(within_word_limit(F.col("text")))
    # Written, as its texts are asked for several times: by the index, the scorer and the result.
    members = written(upsert_candidates(field, accepted), "members")
    docs = members.withColumn("docno", internal_docno(F.col("author_id"))).drop("author_id")
    ranked = rank_fields(
        docs=docs, queries=queries, model=model, load_scorer=load_scorer, scope_cols=EPOCH_FIELD, hot_rows=hot_rows
    )
    placed = ranked.select(*EPOCH_FIELD, internal_doc_id(F.col("docno")).alias("author_id"), "rank")
    return members.join(placed, [*EPOCH_FIELD, "author_id"])
