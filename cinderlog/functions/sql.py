"""Builders of SQL expression text.

The triage rules compile to a few hundred small expressions. As SQL text they reach the JVM in one
call per column and Catalyst sees the same tree as from the Column API.
"""

from __future__ import annotations


def quote(value: str) -> str:
    """A SQL string literal for any text."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return f"'{escaped}'"


def has(col: str, words) -> str:
    """Any of the literal words occurs."""
    return "(" + " OR ".join(f"contains({col}, {quote(w)})" for w in words) + ")"


def matches(col: str, pattern: str) -> str:
    return f"rlike({col}, {quote(pattern)})"


def first(col: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract({col}, {quote(pattern)}, {group})"


def every(col: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({col}, {quote(pattern)}, {group})"


def when(condition: str, value: str, otherwise: str = "NULL") -> str:
    return f"CASE WHEN {condition} THEN {value} ELSE {otherwise} END"


def strip(col: str) -> str:
    return f"regexp_replace({col}, {quote('(?U)^\\s+|\\s+$')}, '')"


def not_empty(col: str) -> str:
    return f"nullif({col}, '')"


NO_STRINGS = "cast(array() AS array<string>)"
