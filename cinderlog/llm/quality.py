"""Quality rules: lines are judged first, failing lines go, then documents that lose too much.

Defined results: a null text counts as empty. A document without words has no lines to lose and
fails the base rule (fewer than ``MIN_WORDS`` words). Blank lines are kept and never counted.
Repeated rows are judged each on their own. Extra columns pass through; a clashing column is
replaced only where it has the name of a result; `clean` rewrites ``text`` and ``n_chars`` alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.llm.shared import aside, held, words

MIN_WORDS = 50
#: Per cent of the words that may stand in repeated windows of three.
MAX_REPEAT = 50
#: Per cent of the characters outside white space that failing lines may hold.
MAX_LOST = 30

SYMBOLS = "[#*$%&|<>]"
#: A prose line holds a sentence end, maybe followed by closing marks.
SENTENCE = r"[.!?…。！？:;][\"'”’»)\]]*(\s|$)"
#: Four symbols, bars, arrows or shouts close together: menus, decorated and shouted words.
DENSE = "([#*$%&|<>!»›•→]+[^#*$%&|<>!»›•→]{1,24}){3}[#*$%&|<>!»›•→]"
#: A line of nothing but a menu word.
NAVIGATION = (
    r"^\s*(home|menu|login|log in|sign up|sign in|search|contact|about|next|previous|back|share|"
    r"top|skip to content)[\s.!:]*$"
)
BOILERPLATE = (
    "all rights reserved",
    "licensed under",
    "released under",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "uses cookies",
    "enable javascript",
    "lorem ipsum",
    "copyright ©",
    "copyright (c)",
)


def failing(line: Column, low: Column) -> Column:
    """Whether a line fails a rule, given it and its lower-case form; blank lines don't."""
    known = F.lit(False)
    for phrase in BOILERPLATE:
        known = known | F.contains(low, F.lit(phrase))
    return line.rlike(r"[^ \t-\r]") & (
        ~line.rlike(SENTENCE) | line.rlike(DENSE) | low.rlike(NAVIGATION) | known
    )


def _solid(found: Column) -> Column:
    """Characters of an array of words."""
    return F.length(F.array_join(found, ""))


def judge(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the measures, the verdict and the cleaned text of each document, prefixed ``q_``.

    One projection without a shuffle. Repeated windows are found by sorting a document's window
    digests with their places, so the work is n log n also for a text that repeats one line.
    Windows are compared by 64-bit digests.
    """
    plain, (text,) = aside(df, text)
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(t, "\n")
    low = F.split(F.lower(t), "\n")
    out = held(plain, q_words=words(t), q_lines=lines, q_low=low)
    w, n = F.col("q_words"), F.size("q_words")
    out = held(
        out,
        q_windows=F.when(
            n >= 3,
            F.transform(
                F.sequence(F.lit(0), n - 3),
                lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
        q_full=F.filter("q_lines", lambda x: x.rlike(r"[^ \t-\r]")),
        q_left=F.filter("q_lines", lambda x, i: ~failing(x, F.get("q_low", i))),
    )
    # Only a text that has a repeated window needs the places.
    windows = F.col("q_windows")
    out = held(
        out,
        q_sorted=F.when(
            F.size(F.array_distinct(windows)) < F.size(windows),
            F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    s = F.col("q_sorted")
    same = F.filter(
        s,
        lambda x, i: F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
        | F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)),
    )
    out = held(out, q_places=F.sort_array(F.transform(same, lambda x: x["i"])))
    p = F.col("q_places")
    # A window starting at p covers three words, or those up to the next such window.
    covered = F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    whole = F.size("q_left") == F.size("q_lines")
    out = out.withColumns(
        {
            "q_n_words": n.cast("long"),
            "q_word_chars": _solid(w).cast("long"),
            "q_n_symbols": F.when(
                t.rlike(SYMBOLS), F.regexp_count(t, F.lit(SYMBOLS))
            )
            .otherwise(0)
            .cast("long"),
            "q_n_dup_lines": (F.size("q_full") - F.size(F.array_distinct("q_full"))).cast("long"),
            "q_n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "q_text": F.when(whole, t).otherwise(F.array_join("q_left", "\n")),
            "q_lost_chars": F.when(whole, 0)
            .otherwise(_solid(w) - _solid(words(F.array_join("q_left", "\n"))))
            .cast("long"),
        }
    )
    out = out.withColumn(
        "q_base_failed",
        (F.col("q_n_words") < MIN_WORDS)
        | (F.col("q_n_repeat_words") * 100 > F.col("q_n_words") * MAX_REPEAT),
    )
    out = out.withColumn(
        "q_kept",
        ~F.col("q_base_failed")
        & (F.col("q_lost_chars") * 100 <= F.col("q_word_chars") * MAX_LOST),
    )
    made = [
        "q_n_words", "q_word_chars", "q_n_symbols", "q_n_dup_lines", "q_n_repeat_words", "q_text",
        "q_lost_chars", "q_base_failed", "q_kept",
    ]
    old = [(n, c) for n, c in zip(plain.columns, df.columns, strict=True) if c not in made]
    return out.select(*(F.col(n).alias(c) for n, c in old), *made)


def clean(df: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The documents that stay, without their failing lines, in the columns of df."""
    plain, (t,) = aside(df, text)
    out = judge(plain, t).where("q_kept").withColumn(t, F.col("q_text"))
    if n_chars in df.columns:
        count = plain.columns[df.columns.index(n_chars)]
        out = out.withColumn(count, F.length(t).cast(df.schema[n_chars].dataType))
    return out.select(*plain.columns).toDF(*df.columns)
