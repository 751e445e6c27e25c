"""Scores of a neural (query, document) model."""

import uuid
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankarena.fixed_values import PAIR_SPECIAL_TOKENS, PAIR_TOKENS
from rankarena.functions.scores import relevance_from_logits

# Takes the queries and texts of a batch and gives an array of (pairs, logits).
Scorer = Callable[[list[str], list[str]], np.ndarray]


#: What a worker process has loaded last, by the call that it belongs to.
_LOADED: dict[str, Any] = {}


def _loaded(key: str, load: Callable[[], Any]) -> Any:
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = load()
    return _LOADED[key]


def query_document_pairs(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Each document with the text of its own query."""
    return docs.drop("query").join(queries.select("query_id", "query"), "query_id")


class Tokenizer(Protocol):
    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: list[int]) -> str: ...


def kept_of_pair(query_tokens: int, text_tokens: int, length: int) -> tuple[int, int]:
    """How many tokens of a query and of its text are left of a pair that is cut to ``length``, with the special tokens.

    The longer of both loses tokens first, and the text of two that are equally long.
    """
    excess = max(0, query_tokens + text_tokens + PAIR_SPECIAL_TOKENS - length)
    from_longer = min(excess, abs(query_tokens - text_tokens))
    rest = excess - from_longer
    cut = [rest // 2, rest - rest // 2]
    cut[0 if query_tokens > text_tokens else 1] += from_longer
    return max(0, query_tokens - cut[0]), max(0, text_tokens - cut[1])


def _cut_pair(tokenizer: Tokenizer, query: str, text: str, length: int) -> tuple[str, str]:
    ids = tokenizer.encode(query), tokenizer.encode(text)
    kept = kept_of_pair(len(ids[0]), len(ids[1]), length)
    # What needs no cut stays as it is, also where decoding would change it.
    query, text = (given if n == len(i) else tokenizer.decode(i[:n]) for given, i, n in zip((query, text), ids, kept, strict=True))
    return query, text


def neural_scores(
    pairs: DataFrame, load_scorer: Callable[[], Scorer], *, keep: list[str], batch_size: int = 64,
    load_tokenizer: Callable[[], Tokenizer] | None = None, pair_length: int = PAIR_TOKENS
) -> DataFrame:
    """``keep`` columns plus ``score`` for rows with ``query`` and ``text``; null ones count as empty.

    ``load_scorer`` is called once per worker process, where it may load a model. Equal pairs, told by digests, are scored
    once. A task sorts some thousands of pairs by length before it cuts them into batches, so that pairs of a batch are of
    like length. With ``load_tokenizer`` pairs are cut to ``pair_length`` tokens first; without, any limit is the scorer's own.
    """
    key = uuid.uuid4().hex

    @F.pandas_udf("array<double>")
    def logits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scorer, tokenizer = _loaded(key, lambda: (load_scorer(), load_tokenizer() if load_tokenizer else None))
        for queries, texts in batches:
            given = list(zip(queries.tolist(), texts.tolist(), strict=True))
            if tokenizer is not None:
                given = [_cut_pair(tokenizer, q, t, pair_length) for q, t in given]
            order = sorted(range(len(given)), key=lambda k: len(given[k][0]) + len(given[k][1]))
            found: list[list[float]] = [[] for _ in given]
            for start in range(0, len(order), batch_size):
                some = order[start : start + batch_size]
                scored = scorer([given[k][0] for k in some], [given[k][1] for k in some])
                for k, row in zip(some, np.asarray(scored), strict=True):
                    found[k] = [float(v) for v in row]
            yield pd.Series(found)

    texts = [F.coalesce(c, F.lit("")) for c in ("query", "text")]
    digests = [F.sha2(t, 256).alias(name) for t, name in zip(texts, ("_query", "_text"), strict=True)]
    once = pairs.groupBy(*digests).agg(F.first(texts[0]).alias("query"), F.first(texts[1]).alias("text"))
    raw = once.select("_query", "_text", logits("query", "text").alias("_logits"))
    scored = raw.select("_query", "_text", relevance_from_logits(F.col("_logits")).alias("score"))
    return pairs.select(*keep, *digests).join(scored, ["_query", "_text"]).select(*keep, "score")
