"""Text helpers: display amounts, abbreviations and note search."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_BREAK = r"[^\p{L}0-9]+"


def dollars(amount: Column) -> Column:
    """$1,234.56, rounded half up."""
    return F.concat(F.lit("$"), F.format_number(F.round(amount, 2), 2))


def percent(ratio: Column) -> Column:
    """12.3%, one decimal."""
    return F.concat(F.format_string("%.1f", F.round(ratio * 100, 1)), F.lit("%"))


def shortened(column: Column | str, limit: int) -> Column:
    """The first ``limit`` characters and an ellipsis when the text is longer."""
    value = F.col(column) if isinstance(column, str) else column
    cut = F.concat(F.substring(value, 1, limit), F.lit("..."))
    return F.when(F.length(value) > limit, cut).otherwise(value)


def contains_pattern(column: Column | str, search: str) -> Column:
    """Case-insensitive match anywhere; % and _ in the search act as wildcards."""
    value = F.col(column) if isinstance(column, str) else column
    return value.ilike(f"%{search}%")


def tokens(column: Column | str) -> Column:
    """The distinct lower-case words of a text."""
    value = F.col(column) if isinstance(column, str) else column
    words = F.array_distinct(F.split(F.lower(value), TOKEN_BREAK))
    return F.filter(words, lambda w: w != "")


def any_word(column: Column | str, words: Iterable[str]) -> Column:
    """True where one of the words occurs as a case-insensitive substring."""
    value = F.lower(F.col(column) if isinstance(column, str) else column)
    matches = [value.contains(w.lower()) for w in words]
    found = matches[0]
    for match in matches[1:]:
        found = found | match
    return found
