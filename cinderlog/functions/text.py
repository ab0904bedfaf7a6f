"""Text and regex Column helpers shared by every operator.

Patterns follow the reference's dialect, so two flag prefixes are used with Java's engine:
``CS`` (Unix line ends, Unicode classes) and ``CI`` (the same, ignoring case).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CS = "(?dU)"
CI = "(?idU)"

# The line ends at which a text is cut into lines.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def any_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags)


def all_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, flags, F.lit(True))


def has_any(col: Column, words) -> Column:
    """True when any of the literal words occurs (no pattern language)."""
    return any_of([col.contains(w) for w in words])


def fold(col: Column) -> Column:
    """One lower-cased copy of a text for all case-insensitive ASCII tests.

    Four characters outside ASCII fold into it (dotted and dotless i, long s, the Kelvin sign).
    They are mapped first where they occur, so a literal test on the copy equals a Unicode
    case-insensitive match on the text.
    """
    special = "\u0130\u0131\u017f\u212a"
    mapped = F.translate(col, special, "iisk")
    return F.lower(F.when(has_any(col, special), mapped).otherwise(col))


def strip(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def not_empty(col: Column) -> Column:
    """NULL in place of the empty string."""
    return F.when(col != "", col)


def first_match(col: Column, pattern: str, group: int = 0) -> Column:
    """First match of ``pattern``, '' when there is none."""
    return F.regexp_extract(col, pattern, group)


def all_matches(col: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(group))


def no_strings() -> Column:
    return F.array().cast("array<string>")


def lines_of(col: Column) -> Column:
    """Lines of a text; a final line break does not open another line."""
    parts = F.split(col, LINE_BREAK, -1)
    return F.when(
        F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)
    ).otherwise(parts)
