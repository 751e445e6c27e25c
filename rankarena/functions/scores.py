"""Score columns and budgets."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankarena.fixed_values import (
    COMPLETION_TOKEN_STEP,
    CONTEXT_TOKENS,
    MAX_COMPLETION_TOKENS,
    PROMPT_TOKEN_MARGIN,
)


def min_max(score: Column, lowest: Column, highest: Column) -> Column:
    """Scale to [0, 1]; 0 where all scores are equal."""
    return F.when(highest == lowest, F.lit(0.0)).otherwise((score - lowest) / (highest - lowest))


def relevance_from_logits(logits: Column) -> Column:
    """Log-softmax of the last logit; a single logit is the score itself."""
    highest = F.array_max(logits)
    exps = F.transform(logits, lambda x: F.exp(x - highest))
    total = F.aggregate(exps, F.lit(0.0), lambda acc, x: acc + x)
    last = F.element_at(logits, -1)
    return F.when(F.size(logits) > 1, last - highest - F.log(total)).otherwise(last)


def estimated_tokens(text: Column) -> Column:
    """Rough token count, for callers that have no tokenizer's count at hand."""
    return F.ceil(F.length(text) / F.lit(4)).cast("long")


def completion_tokens(prompt_tokens: Column) -> Column:
    """Tokens left for the completion: the maximum, less whole steps until everything fits the context.

    Zero or less means that the prompt cannot be sent.
    """
    excess = F.greatest(
        prompt_tokens + F.lit(PROMPT_TOKEN_MARGIN + MAX_COMPLETION_TOKENS - CONTEXT_TOKENS), F.lit(0)
    )
    steps = F.ceil(excess / F.lit(COMPLETION_TOKEN_STEP)).cast("long")
    return (F.lit(MAX_COMPLETION_TOKENS) - F.lit(COMPLETION_TOKEN_STEP) * steps).cast("long")


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
