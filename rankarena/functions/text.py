"""Text columns: white space, words, quotes, prompts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankarena.fixed_values import (
    FINE_TUNE_PROMPT,
    INITIAL_DOCUMENT_PROMPT,
    MAX_WORDS,
    TOKEN,
    WHITE_SPACE,
)


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of every kind (``trim`` only removes spaces)."""
    without_head = F.regexp_replace(text, f"^[{WHITE_SPACE}]+", "")
    # A possessive run keeps long inner white space from being scanned again from each of its characters.
    return F.regexp_replace(without_head, f"(?<![{WHITE_SPACE}])[{WHITE_SPACE}]++\\z", "")


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(f"[^{WHITE_SPACE}]+"), F.lit(0)))


def within_word_limit(text: Column, limit: int = MAX_WORDS) -> Column:
    return word_count(text) <= limit


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def one_line(text: Column) -> Column:
    return F.regexp_replace(strip(text), f"[{WHITE_SPACE}]+", " ")


def remove_backslashes(text: Column) -> Column:
    return F.translate(text, "\\", "")


def single_quotes(text: Column) -> Column:
    return F.translate(text, '"', "'")


def escape_markup(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def ordinal_suffix(rank: Column) -> Column:
    """1st, 2nd, 3rd and "th" for everything else, 21 included."""
    return F.when(rank == 1, "st").when(rank == 2, "nd").when(rank == 3, "rd").otherwise("th")


# Characters which Python shows as an escape: controls, format characters, unassigned ones, separators but the space.
_ESCAPED = r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}\p{Zl}\p{Zp}\p{Zs}&&[^ ]]"


def _escape_code(char: Column) -> Column:
    code = F.ascii(char)
    digits = F.lower(F.hex(code))
    return (
        F.when(char == "\n", "\\n")
        .when(char == "\r", "\\r")
        .when(char == "\t", "\\t")
        .when(code < 256, F.concat(F.lit("\\x"), F.lpad(digits, 2, "0")))
        .when(code < 65536, F.concat(F.lit("\\u"), F.lpad(digits, 4, "0")))
        .otherwise(F.concat(F.lit("\\U"), F.lpad(digits, 8, "0")))
    )


def unquoted_literal(text: Column) -> Column:
    """Text as a Python string literal with all quotes taken out: the form opponents' texts have in a prompt.

    A text holding both kinds of quote has its single quotes escaped in a literal, so their backslashes remain.
    """
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    both = text.contains("'") & text.contains('"')
    unquoted = F.when(both, F.translate(doubled, "'\"", "\\")).otherwise(F.translate(doubled, "'\"", ""))
    chars = F.regexp_extract_all(unquoted, F.lit("(?s)."), F.lit(0))
    escaped = F.array_join(
        F.transform(chars, lambda c: F.when(c.rlike(_ESCAPED), _escape_code(c)).otherwise(c)), ""
    )
    line_breaks = F.replace(unquoted, F.lit("\n"), F.lit("\\n"))
    # Character by character only where something rarer than a line break is present.
    return F.when(line_breaks.rlike(_ESCAPED), escaped).otherwise(line_breaks)


def fine_tune_prompt(text: Column, query: Column) -> Column:
    return F.format_string(FINE_TUNE_PROMPT, query, text)


def initial_document_prompt(scenario: Column, subtopics: Column) -> Column:
    """Prompt for a first document; a topic needs three sub-topics at least."""
    return F.format_string(
        INITIAL_DOCUMENT_PROMPT, *[F.element_at(subtopics, i) for i in (1, 2, 3)], scenario
    )
