"""Filter interaction audit: what each filter removes in every order, and its Shapley share.

Filters are Boolean columns that tell which rows fail. A row's failures are a bit mask, rows are
counted by part and mask, and the counts of a part give the rows that each of the 32 coalitions of
filters removes together. Everything else is arithmetic on those 32 numbers: a filter at a step
removes what its coalition has over the coalition before it, so no order is ever run.

Shapley shares come from the least squares problem whose solution they are: shares weighted by the
Shapley kernel, fitted to the removals of all coalitions, adding up to the removal of all filters.
Its normal equations are solved once in rationals; the solution is linear in the removals, so Spark
multiplies each part's numbers by whole coefficients over one common denominator, without rounding.

Defined results: a null text counts as empty, a null part as the empty string, a row without labels
as neither good nor toxic; repeated labels of a doc_id count if one of them says so. Rows with a null
doc_id have no smaller doc_id and no labels. Repeated rows count each; those of one doc_id and text
are no copies of each other. An empty table has no parts. Extra columns are not read.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial, lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.llm.shared import held, stored, words

MIN_WORDS = 200
#: Per cent of the words that must be distinct, of the code points that may be A-Z.
MIN_DISTINCT, MAX_UPPER = 50, 2
SYMBOLS = "[#$%&*|]"
LETTERS = "ABCDE"
COALITIONS = range(1 << len(LETTERS))


def _solve(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """The solution of matrix x = right by elimination, for right sides side by side."""
    n = len(matrix)
    rows = [list(a) + list(b) for a, b in zip(matrix, right, strict=True)]
    for i in range(n):
        pivot = next(r for r in range(i, n) if rows[r][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [v / rows[i][i] for v in rows[i]]
        for r in range(n):
            if r != i and rows[r][i]:
                rows[r] = [a - rows[r][i] * b for a, b in zip(rows[r], rows[i], strict=True)]
    return [row[n:] for row in rows]


def shares(players: int) -> list[list[Fraction]]:
    """Coefficients: a player's share is their sum with the values of all coalitions, by bit mask.

    Minimises the sum over coalitions S of w(S) (v(S) - sum of the shares in S)^2, with the kernel
    w(S) = (n - 1) / (C(n, s) s (n - s)) for 0 < s < n, under the constraint that all shares add up
    to v(all). With a multiplier the normal equations are A x + m = b(v), sum of x = v(all). The
    value of no players at all is taken as 0.
    """
    n, last = players, (1 << players) - 1
    if n == 1:
        return [[Fraction(0), Fraction(1)]]
    size = [s.bit_count() for s in range(last + 1)]
    weight = [
        Fraction(n - 1, comb(n, k) * k * (n - k)) if 0 < k < n else Fraction(0) for k in size
    ]
    both = [
        [sum(w for s, w in enumerate(weight) if s >> i & 1 and s >> j & 1) for j in range(n)]
        for i in range(n)
    ]
    matrix = [[*map(Fraction, row), Fraction(1)] for row in both]
    matrix.append([Fraction(1)] * n + [Fraction(0)])
    right = [[w if s >> i & 1 else Fraction(0) for s, w in enumerate(weight)] for i in range(n)]
    right.append([Fraction(s == last) for s in range(last + 1)])
    return _solve(matrix, right)[:n]


def failures(df: DataFrame, text: str = "text") -> dict[str, Column]:
    """The failure conditions that a row's own text decides; df holds ``x_words``."""
    t, n = F.coalesce(F.col(text), F.lit("")), F.size("x_words")
    upper = F.length(F.regexp_replace(t, "[^A-Z]+", ""))
    return {
        "A": n < MIN_WORDS,
        "B": F.size(F.array_distinct("x_words")) * 100 < n * MIN_DISTINCT,
        "C": upper.cast("long") * 100 > F.length(t) * MAX_UPPER,
        "D": t.rlike(SYMBOLS),
    }


def masks(df: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, x_part, x_mask, x_good and x_toxic of every row.

    A row is a copy unless it has the least doc_id of its text. Those ids, one of each text, meet the
    rows by text digest *and* doc_id, so that a text with a third of all rows is no hot key.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    docs = held(df.select("doc_id", "source", "text"), x_words=words(F.col("text")))
    mask = F.lit(0)
    for bit, fails in enumerate(failures(docs).values()):
        mask = mask + F.when(fails, 1 << bit).otherwise(0)
    rows = stored(
        docs.select(
            "doc_id",
            F.coalesce("source", F.lit("")).alias("x_part"),
            F.unhex(F.sha2(t, 256)).alias("x_text"),
            mask.alias("x_own"),
        ),
        "failures",
    )
    first = rows.groupBy("x_text").agg(F.min("doc_id").alias("doc_id"))
    first = first.where("doc_id IS NOT NULL").withColumn("x_first", F.lit(True))
    marks = labels.groupBy("doc_id").agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("x_good"),
        F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("x_toxic"),
    )
    copy = F.col("x_first").isNull() & F.col("doc_id").isNotNull()
    joined = rows.join(first, ["x_text", "doc_id"], "left").join(marks, "doc_id", "left")
    return joined.select(
        "doc_id",
        "x_part",
        (F.col("x_own") + F.when(copy, 16).otherwise(0)).alias("x_mask"),
        F.coalesce("x_good", F.lit(False)).alias("x_good"),
        F.coalesce("x_toxic", F.lit(False)).alias("x_toxic"),
    )


def coalitions(rows: DataFrame) -> DataFrame:
    """One row per part: x_n rows, and arrays over the 32 coalitions, by bit mask, of the rows,
    good rows and toxic rows that they remove."""
    counted = rows.groupBy("x_part", "x_mask").agg(
        F.count(F.lit(1)).alias("x_rows"),
        F.count_if("x_good").alias("x_good"),
        F.count_if("x_toxic").alias("x_toxic"),
    )

    def removed(column: str) -> Column:
        hit = [F.col("x_mask").bitwiseAND(s) != 0 for s in COALITIONS]
        return F.array(*(F.coalesce(F.sum(F.when(h, F.col(column))), F.lit(0)) for h in hit))

    return counted.groupBy("x_part").agg(
        F.sum("x_rows").alias("x_n"),
        removed("x_rows").alias("x_removed"),
        removed("x_good").alias("x_lost_good"),
        removed("x_toxic").alias("x_lost_toxic"),
    )


def steps(table: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from the coalitions' removals."""
    n = len(LETTERS)
    weights = shares(n)
    whole = lcm(*(c.denominator for row in weights for c in row))
    # All orders of n filters hold a share n! times.
    totals = F.array(
        *(
            sum(
                (F.get("x_removed", F.lit(s)) * int(c * whole) for s, c in enumerate(row) if c),
                F.lit(0).cast("long"),
            )
            * factorial(n)
            for row in weights
        )
    )
    orders = F.array(*(F.lit("".join(o)) for o in permutations(LETTERS)))
    out = table.withColumn("x_totals", totals)
    out = out.withColumn("filter_order", F.explode(orders))
    out = out.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    letter = F.substr("filter_order", "step", F.lit(1))
    own = F.instr(F.lit(LETTERS), letter) - 1
    earlier = F.substr("filter_order", F.lit(1), F.col("step") - 1)
    before = sum(
        (F.when(F.instr(earlier, F.lit(x)) > 0, 1 << i).otherwise(0) for i, x in enumerate(LETTERS)),
        F.lit(0),
    )
    out = held(out, x_own=own, x_before=before)
    out = held(out, x_alone=F.pow(F.lit(2), F.col("x_own")).cast("int"))
    after, everything = F.col("x_before") + F.col("x_alone"), (1 << n) - 1

    def of(column: str, coalition: Column) -> Column:
        return F.get(column, coalition)

    def gained(column: str) -> Column:
        return of(column, after) - of(column, F.col("x_before"))

    removed = gained("x_removed")
    return out.select(
        F.col("x_part").alias("part"),
        "filter_order",
        "step",
        (F.col("x_n") - of("x_removed", after)).alias("kept"),
        removed.alias("removed"),
        (of("x_removed", F.col("x_alone")) - removed).alias("redundant"),
        (of("x_removed", F.lit(everything)) - of("x_removed", everything - F.col("x_alone"))).alias(
            "unique_fails"
        ),
        gained("x_lost_good").alias("good_lost"),
        gained("x_lost_toxic").alias("toxic_lost"),
        F.expr(f"get(x_totals, x_own) div {whole}").alias("shapley"),
    )


def audit(df: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over the parts of df (column ``source``)."""
    return steps(coalitions(masks(df, labels)))
