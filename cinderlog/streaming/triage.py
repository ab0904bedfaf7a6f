"""Triage of tool output as it arrives.

``stream_verdicts`` is the batch projection on a stream of whole texts, without state.
``verdict_updates`` keeps state: artifacts arrive in pieces, in any order and over any number of
batches, and an artifact's verdict is given anew whenever one of its pieces came.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import signals as S
from ..operators.findings import (
    MULTI_RULES,
    SLOTS,
    finding,
    severity_of,
    severity_rank,
    slot_findings,
    verdict_of,
)
from ..operators.triage import triage_texts


def stream_texts(spark: SparkSession, path: str) -> DataFrame:
    """New files of a folder as ``artifact_id, text``."""
    arriving = spark.readStream.format("text").option("wholetext", "true").load(path)
    return arriving.select(
        F.col("_metadata.file_path").alias("artifact_id"),
        F.regexp_replace("value", "\r\n?", "\n").alias("text"),
    )


def stream_verdicts(texts: DataFrame) -> DataFrame:
    """Verdict and findings per arriving artifact; stateless."""
    return triage_texts(texts).select("artifact_id", "verdict", "findings")


def verdict_updates(pieces: DataFrame) -> DataFrame:
    """``artifact_id, piece_no, own, text`` -> verdict and priority finding of each artifact so far.

    A piece is a run of an artifact's lines (``own``), ``text`` the same with the lines behind it that
    a match may run on into, as `operators.triage.pieces` cuts them. Works on a stream, in update
    mode, and on a table, with the same results.

    The state of an artifact has a fixed size: signals that are true once or counted (bits and
    numbers), the earliest match of each pattern, the earliest evidence of each rule that reports
    every match. All of it is sums, minima and bit sets, so the order of arrival doesn't matter; a
    piece must arrive once, as an exactly-once source gives it, for counts to be right.
    """
    prepared = S.prepare(pieces, ["artifact_id", "piece_no"], own="own")
    rows = S.packed(prepared, ["artifact_id"], "cast(piece_no AS long)", False, alone=False)
    logon, third = S.flag_bit("e4624"), S.flag_bit("type3")
    has = F.col("mask").bitwiseAND
    state = rows.groupBy("artifact_id").agg(
        F.bit_or("mask").alias("mask"),
        F.sum(F.col("n4625").cast("long")).alias("s_n4625"),
        F.sum(F.col("n4625_text").cast("long")).alias("s_n4625_text"),
        F.bit_or("capability_bits").alias("s_capability_bits"),
        F.min(F.when(has(logon) != 0, F.col("at"))).alias("logon_at"),
        F.max(F.when(has(third) != 0, F.col("at"))).alias("third_at"),
        *(
            F.expr(
                f"min(IF(exists(firsts, f -> f.name = '{n}'), "
                f"struct(at, filter(firsts, f -> f.name = '{n}')[0].value AS value), NULL)) AS first_{n}"
            )
            for n in S.FIRST_NAMES
        ),
        *(
            F.expr(
                f"min(IF(exists(lists, e -> e.slot = '{r}'), "
                f"struct(at, filter(lists, e -> e.slot = '{r}')[0].evidence AS evidence), NULL)) AS list_{r}"
            )
            for r in MULTI_RULES
        ),
    )
    flag = {n: f"mask & {S.flag_bit(n)}L <> 0" for n in S.FLAG_NAMES}
    flag["remote_logon"] += " OR coalesce(logon_at < third_at, false)"
    signals = state.selectExpr(
        "artifact_id",
        "s_n4625",
        "s_n4625_text",
        "s_capability_bits",
        *(f"({e}) AS s_{n}" for n, e in flag.items()),
        *(f"coalesce(first_{n}.value, '') AS s_{n}" for n in S.FIRST_NAMES),
        *(f"list_{r}.evidence AS m_{r}" for r in MULTI_RULES),
    )
    def entry(slot: str, no: int) -> str:
        place = f"AS severity_rank, {no} AS slot_no"
        if slot in MULTI_RULES:
            rank = severity_rank(f"'{severity_of(slot)}'")
            one = f"struct({rank} {place}, 0 AS i, {finding(slot, f'm_{slot}')} AS f)"
            return f"array_compact(array(IF(m_{slot} IS NULL, NULL, {one})))"
        rank = severity_rank("f.severity")
        return f"transform({slot_findings(slot)}, (f, i) -> struct({rank} {place}, i, f))"

    # The least severity rank, then report order.
    entries = ", ".join(entry(s, i) for i, s in enumerate(SLOTS))
    ranked = signals.selectExpr("artifact_id", f"array_min(concat({entries})).f AS top")
    return ranked.selectExpr(
        "artifact_id",
        f"{verdict_of('top.severity')} AS verdict",
        "top.rule_id AS priority_rule",
        "top.indicator AS priority_indicator",
        "top.evidence AS priority_evidence",
    )


def write_verdicts(pieces: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the verdicts of a stream of pieces in a folder of tables, one per batch.

    A batch that is run again after a failure writes the same table again. With the checkpoint the
    state and the numbering go on after a restart.
    """

    def store(updates: DataFrame, batch: int) -> None:
        updates.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = verdict_updates(pieces).writeStream.outputMode("update").foreachBatch(store)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def current_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """The last verdict of each artifact that `write_verdicts` has kept."""
    updates = spark.read.parquet(path)
    columns = [c for c in updates.columns if c not in ("artifact_id", "batch")]
    last = updates.groupBy("artifact_id").agg(F.max_by(F.struct(*columns), "batch").alias("v"))
    return last.select("artifact_id", "v.*")
