"""Majority votes, unanimous votes and cross-checks over tables of answers.

Every group-by here has a map-side part with one small row per group, so a question with most of
the candidates is no hot spot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts of the outcomes.
NOTHING_RAN = "empty/zero result"
DISAGREED = "router votes disagreed"
AGREE, DISAGREE, NOT_CHECKED = "AGREE", "DISAGREE", "NOT CHECKED"

MIN_VOTES = 2


def result_key(result: Column) -> Column:
    """Canonical text of a JSON result: object keys sorted, no layout; other text as it is.

    Only objects and arrays have a layout to remove; scalars keep their spelling, so 1 and 1.0
    stay different.
    """
    nested = result.rlike(r"^\s*[\[{]")
    canonical = F.to_json(F.try_parse_json(result))
    return F.when(nested, F.coalesce(canonical, result)).otherwise(F.trim(result))


def row_key(*columns: str) -> Column:
    """Canonical key of a result held in columns."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _answers(key: Column) -> Column:
    return F.col("err").isNull() & key.isNotNull() & ~key.isin("null", "[[]]")


def usable() -> Column:
    """No error, and a result: 0, [] and '' are answers, null and [[]] are not."""
    return _answers(result_key(F.col("result_json")))


def majority(candidates: DataFrame) -> DataFrame:
    """Winning result per question from ``question_id, pos, sql, result_json, err``.

    The most frequent result wins, ties go to the one seen first; ``sql`` is the earliest query
    with that result. A question whose candidates all failed keeps a row with the first error.

    Candidates are counted by result, then by count, then by question, with numbers only in the
    buffers, so every step is a hash aggregation with map-side combine. That settles the position of
    the winner, or of the first error; its texts come from a join on question and position, which
    spreads the candidates of one question. Of candidates at one position the one with the smallest
    texts counts.
    """
    ok = F.col("key").isNotNull()
    # The generator keeps the parsed result from being spelled out, and parsed, at every use.
    parsed = candidates.select(
        "question_id",
        "pos",
        "err",
        F.inline(F.array(F.struct(result_key(F.col("result_json")).alias("parsed")))),
    )
    keyed = parsed.select(
        "question_id",
        "pos",
        F.when(_answers(F.col("parsed")), F.col("parsed")).alias("key"),
        F.col("err").isNotNull().alias("failed"),
    )
    per_key = keyed.groupBy("question_id", "key").agg(
        F.count("*").alias("n"),
        F.min("pos").alias("pos"),
        F.min(F.when(F.col("failed"), F.col("pos"))).alias("err_pos"),
    )
    # Of results with one count the earliest stands for them; failures (NULL key) never win.
    per_count = per_key.groupBy("question_id", F.when(ok, F.col("n")).alias("votes")).agg(
        F.sum("n").alias("n"), F.min("pos").alias("pos"), F.min("err_pos").alias("err_pos")
    )
    per_question = per_count.groupBy("question_id").agg(
        F.max("votes").alias("votes"),
        F.max_by("pos", "votes").alias("won_pos"),
        F.sum("n").alias("n_candidates"),
        F.min(F.when(F.col("votes").isNull(), F.col("err_pos"))).alias("err_pos"),
    )
    won = F.col("votes").isNotNull()
    chosen = per_question.select(
        F.col("question_id").alias("_question"),
        F.when(won, F.col("won_pos")).otherwise(F.col("err_pos")).alias("_pos"),
        won.alias("ok"),
        F.coalesce("votes", F.lit(0)).alias("votes"),
        "n_candidates",
    )
    texts = candidates.select("question_id", "pos", "sql", "result_json", "err")
    same = F.col("question_id").eqNullSafe(F.col("_question")) & F.col("pos").eqNullSafe(F.col("_pos"))
    # A position of the winner may hold failures beside it, and the other way round. The results are
    # read again for the chosen rows only.
    key = F.when(usable(), result_key(F.col("result_json")))
    fits = F.when(F.col("ok"), key.isNotNull()).otherwise(F.col("err").isNotNull())
    found = (
        chosen.join(texts, same, "left")
        .groupBy("_question", "ok", "votes", "n_candidates")
        .agg(F.min(F.when(fits, F.struct(key.alias("key"), "sql", "err"))).alias("text"))
    )
    label = F.concat(
        F.col("votes").cast("string"), F.lit("/"), F.col("n_candidates").cast("string")
    )
    return found.select(
        F.col("_question").alias("question_id"),
        F.when(F.col("ok"), F.col("text.key")).alias("result"),
        F.when(F.col("ok"), F.col("text.sql")).alias("sql"),
        label.alias("votes"),
        "ok",
        F.when(~F.col("ok"), F.coalesce("text.err", F.lit(NOTHING_RAN))).alias("error"),
    )


def unanimous(votes: DataFrame) -> DataFrame:
    """Agreed plan per question from ``question_id, pos, plan, reason``.

    ``plan`` is the normalised plan as text, ``reason`` why a vote is invalid (NULL if valid).
    At least two votes must be valid and equal. Votes are first counted by plan and reason, with
    numbers in the buffers, so a question's votes are one row per distinct text before any text is
    compared. The reason given is that of the first invalid vote.
    """
    told = F.when(
        F.col("reason").isNotNull() | F.col("plan").isNull(), F.coalesce("reason", F.lit("no plan"))
    )
    per_text = votes.groupBy("question_id", "plan", told.alias("why")).agg(
        F.count("*").alias("n"), F.min("pos").alias("pos")
    )
    bad = F.col("why").isNotNull()
    counted = per_text.groupBy("question_id").agg(
        F.sum("n").alias("n"),
        F.min("plan").alias("low"),
        F.max("plan").alias("high"),
        F.bool_or(bad).alias("any_bad"),
        F.min(F.when(bad, F.struct("pos", "why"))).alias("first"),
    )
    why = F.col("first.why")
    reason = (
        F.when(F.col("any_bad"), F.concat(F.lit("invalid plan: "), why))
        .when(F.col("n") < MIN_VOTES, F.lit(f"fewer than {MIN_VOTES} votes"))
        .when(F.col("low") != F.col("high"), F.lit(DISAGREED))
    )
    return counted.select(
        "question_id",
        F.when(reason.isNull(), F.col("low")).alias("plan"),
        F.col("n").alias("n_votes"),
        reason.alias("reason"),
    )


def cross_check(answers: DataFrame, others: DataFrame) -> DataFrame:
    """Compare two answer tables ``question_id, result, ok`` on the question.

    A failed or missing other side is NOT CHECKED and leaves ``agree`` NULL, never false.
    """
    right = others.select(
        "question_id",
        F.col("result").alias("other_result"),
        F.col("ok").alias("other_ok"),
    )
    joined = answers.select("question_id", "result").join(right, "question_id", "left")
    executed = F.coalesce("other_ok", F.lit(False))
    same = result_key(F.col("result")).eqNullSafe(result_key(F.col("other_result")))
    agree = F.when(executed, same)
    return joined.select(
        "question_id",
        "result",
        "other_result",
        executed.alias("executed"),
        agree.alias("agree"),
        F.when(agree.isNull(), F.lit(NOT_CHECKED))
        .when(agree, F.lit(AGREE))
        .otherwise(F.lit(DISAGREE))
        .alias("outcome"),
    )
