"""Text pairs for fine-tuning, mined from position changes and from winners."""

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from rankarena.fixed_values import EXCLUDED_RELEVANCE, TOP_POSITIONS
from rankarena.functions.text import fine_tune_prompt, remove_backslashes
from rankarena.operators.rounds import ENTRY, delta_name

LAGS = (1, 2, 3)


def improved() -> Column:
    moved_up = F.lit(False)
    for lag in LAGS:
        moved_up = moved_up | (F.col(delta_name(lag)) > 0)
    return moved_up & (F.col("ksrel") != EXCLUDED_RELEVANCE)


def near_top(*, legacy: bool = False) -> Column:
    """Position in the top four; ``legacy`` also takes any position with one of the digits 1 to 4 in it."""
    top = F.col("pos").cast("string").rlike("[1-4]") if legacy else F.col("pos") <= TOP_POSITIONS
    return top & (F.col("ksrel") != EXCLUDED_RELEVANCE)


def _with_texts(
    found: DataFrame, texts: DataFrame, columns: list[str], *, lowest: Column | None = None, highest: Column | None = None
) -> DataFrame:
    """``columns`` and ``completion`` of one row for each pair of texts: the one with the lowest or the highest order.

    ``found`` has rows without text and the ``_other`` docno. Pairs are told apart by digests, on narrow rows; then the texts
    of those that are left meet them by docno, and both texts of a pair by their digests. So texts move twice at most.
    """
    def digest(text: str) -> Column:
        return F.unhex(F.sha2(text, 256))

    digests = texts.select("docno", digest("text").alias("_digest"))
    others = digests.select(F.col("docno").alias("_other"), F.col("_digest").alias("_other_digest"))
    met = found.join(digests, "docno").join(others, "_other")
    whole = F.struct(*found.columns)
    chosen = F.min_by(whole, lowest) if lowest is not None else F.max_by(whole, highest)
    kept = met.groupBy("_digest", "_other_digest").agg(chosen.alias("_row"))
    roles = F.array(
        F.struct(F.col("_row.docno").alias("docno"), F.col("_digest").alias("own"), F.lit("text").alias("role")),
        F.struct(F.col("_row._other").alias("docno"), F.col("_other_digest").alias("own"), F.lit("completion").alias("role")),
    )
    asked = kept.select("*", F.explode(roles).alias("_ask")).select("_digest", "_other_digest", "_row", "_ask.*")
    # A docno that is there twice may have another text.
    told = asked.join(texts.select("docno", "text"), "docno").where(digest("text").eqNullSafe(F.col("own")))
    both = told.groupBy("_digest", "_other_digest").agg(
        F.first("_row").alias("_row"), *[F.max(F.when(F.col("role") == role, F.col("text"))).alias(role) for role in ("text", "completion")]
    )
    return both.select("_row.*", "text", "completion").select(*columns, "completion")


def _split(rows: DataFrame, texts: DataFrame | None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows without text, (docno, text), and the columns that pairs have of them."""
    if texts is not None:
        narrow = rows.drop("text")
        place = narrow.columns.index("query") + 1 if "query" in narrow.columns else len(narrow.columns)
        return narrow, texts, [*narrow.columns[:place], "text", *narrow.columns[place:]]
    return rows.drop("text"), rows.select("docno", "text"), rows.columns


def _counted(rows: DataFrame, counts: Observation | None) -> DataFrame:
    """``rows``, with their number and that of rows without an ``_other`` text told to ``counts``."""
    if counts is None:
        return rows
    missing = F.count(F.when(F.col("_other").isNull(), 1))
    return rows.observe(counts, F.count(F.lit(1)).alias("rows"), missing.alias("without_other_text"))


def _with_prompt(pairs: DataFrame, *, clean_all: bool, direction: str) -> DataFrame:
    """Take backslashes out of the text (``clean_all``: also out of query and completion) and add the prompt.

    By default the prompt shows ``text``, the better of both, as published training data does; with
    ``worse_to_better`` it shows the worse one and the completion is the better one.
    """
    if direction not in ("better_to_worse", "worse_to_better"):
        raise ValueError(f"unknown direction {direction!r}")
    cleaned = {"text": remove_backslashes(F.col("text"))}
    if clean_all:
        cleaned |= {c: remove_backslashes(F.col(c)) for c in ("query", "completion")}
    pairs = pairs.withColumns(cleaned)
    if direction == "worse_to_better":
        pairs = pairs.withColumns({"text": F.col("completion"), "completion": F.col("text")})
    return pairs.withColumn("prompt", fine_tune_prompt(F.col("text"), F.col("query")))


def improvement_pairs(
    deltas: DataFrame,
    *,
    texts: DataFrame | None = None,
    match_lag: bool = False,
    clean_all: bool = False,
    direction: str = "better_to_worse",
    counts: Observation | None = None,
) -> DataFrame:
    """Texts that moved up, paired with the author's text of the round before.

    ``texts`` are (docno, text); without them ``deltas`` has the texts. With ``match_lag`` a text that moved up over k
    rounds is paired with the text of k rounds ago, for each such k. Rows whose earlier text is missing form no pair;
    ``counts`` is told, once the result is computed, how many ``rows`` moved up and how many are ``without_other_text``. Of
    equal pairs the one with the largest delta is kept, then the one with the lowest docno.
    """
    deltas, texts, columns = _split(deltas, texts)
    rows = deltas.where(improved())
    other = F.min_by("docno", F.struct("pos", "docno")).alias("_other")
    if match_lag:
        steps = F.array(*[F.when(F.col(delta_name(k)) > 0, F.lit(k)) for k in LAGS])
        rows = rows.withColumn("_lag", F.explode(F.array_compact(steps)))
        rows = rows.withColumn("_from", F.col("round_number") - F.col("_lag"))
        earlier = deltas.withColumnRenamed("round_number", "_from")
        key = ["query_id", "author_id", "_from"]
    else:
        # Shifted before they are grouped, so that the join finds them where the grouping left them.
        earlier = deltas.withColumn("round_number", F.col("round_number") + 1)
        key = ENTRY
    met = _counted(rows.join(earlier.groupBy(*key).agg(other), key, "left"), counts)
    found = met.where(F.col("_other").isNotNull()).select(*deltas.columns, "_other")
    kept = _with_texts(found, texts, columns, lowest=F.struct(-F.col("delta"), "docno"))
    return _with_prompt(kept, clean_all=clean_all, direction=direction)


def top_pairs(
    comp: DataFrame,
    *,
    texts: DataFrame | None = None,
    legacy: bool = False,
    clean_all: bool = False,
    direction: str = "better_to_worse",
    counts: Observation | None = None,
) -> DataFrame:
    """Winning texts, paired with the next lower text in the top of the same field.

    ``texts`` and ``counts`` are as in :func:`improvement_pairs`. A winner without such a text forms no pair. Of equal pairs
    the one with the highest query id is kept, then the latest round, then the highest docno.
    """
    comp, texts, columns = _split(comp, texts)
    rows = comp.where(near_top(legacy=legacy))
    runners_up = (
        rows.where(F.col("pos") > 1)
        .groupBy("query_id", "round_number")
        .agg(F.min_by("docno", F.struct("pos", "docno")).alias("_other"))
    )
    met = _counted(rows.where(F.col("pos") == 1).join(runners_up, ["query_id", "round_number"], "left"), counts)
    found = met.where(F.col("_other").isNotNull()).select(*comp.columns, "_other")
    kept = _with_texts(found, texts, columns, highest=F.struct("query_id", "round_number", "docno"))
    return _with_prompt(kept, clean_all=clean_all, direction=direction)
