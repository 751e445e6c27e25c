"""Document and query identifiers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankarena.fixed_values import BOT_NAMES, QUERY_ID_WIDTH


def zero_fill(value: Column, width: int | Column = QUERY_ID_WIDTH) -> Column:
    """Left-fill with zeros up to ``width``; longer values stay as they are (``lpad`` would cut them)."""
    width = F.lit(width) if isinstance(width, int) else width
    missing = F.greatest(width - F.length(value), F.lit(0))
    return F.concat(F.repeat(F.lit("0"), missing), value)


def canonical_query_id(value: Column) -> Column:
    """Numeric ids get one spelling (three digits at least), so ``2``, ``02`` and ``002`` join; others are kept."""
    value = F.trim(value.cast("string"))
    digits = F.regexp_replace(value, "^0+(?=[0-9])", "")
    return F.when(value.rlike("^[0-9]+$"), zero_fill(digits)).otherwise(value)


def docno_parts(docno: Column, *, strict: bool = False) -> dict[str, Column]:
    """Round, query and author held in ``ROUND-<round>-<query>-<author>``.

    Parts after the fourth are ignored, unless ``strict``: then any other number of parts is an error.
    """
    parts = F.split(docno, "-")
    if strict:
        parts = F.when(F.size(parts) == 4, parts).otherwise(
            F.raise_error(F.concat(F.lit("docno does not have four parts: "), docno)).cast("array<string>")
        )
    return {
        "round_number": F.get(parts, F.lit(1)).cast("int"),
        "query_id": canonical_query_id(F.get(parts, F.lit(2))),
        "author_id": F.get(parts, F.lit(3)),
    }


def epoch_to_round(docno: Column, *, anywhere: bool = False) -> Column:
    """``EPOCH-…`` docnos name the same documents as ``ROUND-…`` ones."""
    return F.regexp_replace(docno, "EPOCH" if anywhere else "^EPOCH", "ROUND")


def last_segment(value: Column) -> Column:
    return F.element_at(F.split(value, "-"), -1)


def internal_docno(doc_id: Column) -> Column:
    """Docno under which a field member without a docno of its own is written to a trectext file."""
    return F.format_string("ROUND-01-001-%s@internal", doc_id)


def internal_doc_id(docno: Column) -> Column:
    return F.regexp_extract(docno, "^ROUND-01-001-(.*)@internal$", 1)


def bot_name(bot_type: str, markov: bool = False) -> str:
    if (markov, bot_type) not in BOT_NAMES:
        raise ValueError(f"unknown bot type {bot_type!r} (markov={markov!r})")
    return BOT_NAMES[(markov, bot_type)]


def bot_name_column(bot_type: Column, markov: Column) -> Column:
    named = F.lit(None).cast("string")
    for (is_markov, kind), name in BOT_NAMES.items():
        named = F.when((bot_type == kind) & (markov == F.lit(is_markov)), F.lit(name)).otherwise(named)
    return named
