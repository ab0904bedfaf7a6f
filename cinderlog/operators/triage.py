"""Triage: findings, verdicts and reports for tool output.

Two forms with equal results:

``triage_texts``   one row per artifact text; a pure ``select``, no shuffle at all.
``piece_findings`` / ``piece_verdicts``  artifacts given as numbered lines, cut into bounded
                   overlapping pieces, so one artifact may be any share of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import meet, settle, written
from . import signals as S
from .findings import (
    MULTI_RULES,
    SLOTS,
    finding,
    findings_array,
    severity_rank,
    slot_findings,
    slot_rank,
    verdict_of,
)


# ---------------------------------------------------------------- whole texts
def triage_texts(texts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys..., text`` -> ``keys..., text, findings, verdict``.

    The signals are projected first and the rules read them from there, so each pattern is
    evaluated once per text however many rules use it.
    """
    keys = keys or ["artifact_id"]
    found = text_signals(texts, keys).selectExpr(
        *keys, "text", f"{findings_array()} AS findings"
    )
    return settle(found, "findings").withColumn(
        "verdict", F.expr(verdict_of("get(findings, 0).severity"))
    )


def text_signals(texts: DataFrame, keys: list[str]) -> DataFrame:
    return S.prepare(texts, keys).selectExpr(
        *keys,
        "_text AS text",
        *S.signal_columns(S.scalars(whole=True), "s_"),
        *S.signal_columns(S.multis(), "m_"),
    )


def rule_findings(
    texts: DataFrame, rule_id: str, keys: list[str] | None = None
) -> DataFrame:
    """Findings of one rule; Catalyst prunes the signals it does not read."""
    keys = keys or ["artifact_id"]
    found = ", ".join(slot_findings(s) for s in SLOTS if s.startswith(rule_id))
    return (
        text_signals(texts, keys)
        .selectExpr(*keys, f"explode(concat({found})) AS f")
        .select(*keys, "f.*")
    )


def findings_table(triaged: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per finding, numbered in report order."""
    keys = keys or ["artifact_id"]
    rows = triaged.select(*keys, F.posexplode("findings").alias("n", "f"))
    return rows.select(*keys, (F.col("n") + 1).cast("long").alias("finding_no"), "f.*")


def priority(triaged: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The priority finding and the next steps; artifacts without findings stay."""
    keys = keys or ["artifact_id"]
    return triaged.selectExpr(
        *keys,
        "verdict",
        "cast(size(findings) AS long) AS n_findings",
        "get(findings, 0).rule_id AS priority_rule",
        "get(findings, 0).indicator AS priority_indicator",
        "get(findings, 0).evidence AS priority_evidence",
        "transform(slice(findings, 1, 3), f -> f.next) AS next_steps",
    )


def next_steps(findings: Column) -> Column:
    """The first three suggestions, repeats kept."""
    return F.transform(F.slice(findings, 1, 3), lambda f: f["next"])


def report_text(findings: Column) -> Column:
    """The analyst's report, from the columns ``findings`` and ``verdict``."""
    # The lines of the report.
    none = (
        "VERDICT: UNDETERMINED — no known indicators matched.\n"
        "Manual review of the raw output is required (no rule fired)."
    )
    top = findings[0]
    head = F.array(
        F.concat(F.lit("VERDICT: "), F.upper("verdict")),
        F.concat(
            F.lit("PRIORITY: ["), top["severity"], F.lit("] "), top["indicator"]
        ),
        F.concat(F.lit("   why: "), top["why"]),
        F.lit("FINDINGS:"),
    )
    body = F.transform(
        findings,
        lambda f: F.concat(
            F.lit("  - ["),
            f["severity"],
            F.lit("] "),
            f["indicator"],
            F.lit("  (evidence: "),
            f["evidence"],
            F.lit(")"),
        ),
    )
    steps = F.transform(
        next_steps(findings), lambda s: F.concat(F.lit("  - "), s)
    )
    lines = F.concat(head, body, F.array(F.lit("SUGGESTED NEXT COMMANDS:")), steps)
    return F.when(F.size(findings) == 0, F.lit(none)).otherwise(
        F.array_join(lines, "\n")
    )


def block_text(findings: Column) -> Column:
    """The numbered findings block that goes in front of an excerpt."""
    # The lines of the block.
    none = "PRE-EXTRACTION: no known indicators matched. Reason from the raw output directly."
    title = (
        "PRE-EXTRACTED FINDINGS (deterministic indicator scan; "
        "highest severity first):"
    )
    entries = F.transform(
        findings,
        lambda f, i: F.concat(
            (i + 1).cast("string"),
            F.lit(". ["),
            F.upper(f["severity"]),
            F.lit("] "),
            f["indicator"],
            F.lit("\n   evidence: "),
            f["evidence"],
            F.lit("\n   why: "),
            f["why"],
            F.lit("\n   suggested next: "),
            f["next"],
        ),
    )
    return F.when(F.size(findings) == 0, F.lit(none)).otherwise(
        F.concat(F.lit(title + "\n"), F.array_join(entries, "\n"))
    )


# ---------------------------------------------------------------- large artifacts
PIECE_LINES = 512
#: Lines with text on them that a piece sees behind its own.
PIECE_AHEAD = 64
#: Stands for the blank lines of whole pieces: more than any pattern with a bounded gap crosses.
BLANK_RUN = "\n" * 64


#: Pieces that are broadcast to fetch their lines, of about 50 bytes each.
MAX_PIECES = 1_000_000


def pieces(
    lines: DataFrame,
    size: int = PIECE_LINES,
    ahead: int = PIECE_AHEAD,
    only: DataFrame | None = None,
) -> DataFrame:
    """``artifact_id, line_no, line`` -> ``artifact_id, piece_no, own, text``.

    ``line_no`` counts an artifact's lines without gaps. A piece owns ``size`` lines and also
    sees the ``ahead`` lines *with text* that follow, however many blank lines lie between, so a
    match that runs over line ends is seen whole by the piece it starts in: no pattern joins more
    than 24 lines with text on them (the longest is a prologue with 40 characters between its
    halves), only blanks have no bound. Blank pieces start no match and are left out.

    Which pieces see the head of which others follows from the number of lines with text in each,
    a table with a row of three numbers per piece. Texts go through one shuffle, heads through
    another; a group is bounded by ``size`` lines and ``ahead`` heads. With ``only``, a table
    ``artifact_id, piece_no``, those pieces are made, and no other text travels than that of them
    and of the pieces whose head they see.
    """
    if size < 1 or ahead < 1:
        raise ValueError("size and ahead must be positive")
    line = F.coalesce("line", F.lit(""))
    placed = lines.select(
        "artifact_id",
        "line_no",
        line.alias("line"),
        F.expr(f"line_no DIV {int(size)}").alias("piece_no"),
        line.rlike(r"\S").alias("full"),
    )
    keys = ["artifact_id", "piece_no"]

    # A piece's head goes to those before it that have not seen enough lines with text yet.
    filled = placed.where("full").groupBy(*keys).agg(F.count("*").alias("n"))
    before = Window.partitionBy("artifact_id").orderBy("piece_no").rowsBetween(-ahead, -1)
    seen = F.collect_list(F.struct("piece_no", "n")).over(before)
    near = filled.select(*keys, "n", seen.alias("earlier")).selectExpr(
        "artifact_id",
        "piece_no AS from_no",
        "n",
        "get(earlier, size(earlier) - 1).piece_no AS last_no",
        f"explode(filter(earlier, (p, i) -> aggregate(slice(earlier, i + 2, {ahead}), 0L, "
        f"(total, q) -> total + q.n) < {ahead}).piece_no) AS piece_no",
    )
    if only is not None:
        near = written(near.join(only, keys, "left_semi"), "heads")
        wanted = near.select("artifact_id", F.col("from_no").alias("piece_no"))
        wanted = written(wanted.union(only.select(*keys)).distinct(), "pieces")
        placed = meet(placed, wanted, keys, MAX_PIECES)
    grouped = (
        placed.groupBy(*keys)
        .agg(
            F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY line_no)").alias("own"),
            F.bool_or("full").alias("full"),
        )
        .where("full")
        .drop("full")
    )
    first = F.regexp_extract("own", rf"^(?:\s*\S[^\n]*\n?){{1,{int(ahead)}}}", 0)
    head = F.when(F.col("n") < ahead, F.col("own")).otherwise(
        F.regexp_replace(first, r"\n\z", "")
    )
    gap = F.when(F.col("last_no") < F.col("from_no") - 1, F.lit(BLANK_RUN)).otherwise(F.lit(""))
    heads = (
        grouped.withColumnRenamed("piece_no", "from_no")
        .join(near, ["artifact_id", "from_no"])
        .select("artifact_id", "piece_no", "from_no", F.concat(gap, head).alias("head"))
        .groupBy(*keys)
        .agg(F.expr("listagg(head, '\n') WITHIN GROUP (ORDER BY from_no)").alias("rest"))
    )
    text = F.concat_ws("\n", "own", "rest")
    chosen = grouped if only is None else grouped.join(only, keys, "left_semi")
    return chosen.join(heads, keys, "left").select(*keys, text.alias("text"), "own")


def line_signals(
    lines: DataFrame, size: int = PIECE_LINES, ahead: int = PIECE_AHEAD
) -> DataFrame:
    """What the lines of each artifact show, packed: see `signals.packed`.

    Two phases. Every line is looked at on the scan, by itself; what it shows is a row of numbers and
    matches, and a line that shows nothing, like most, is gone. Matches that run over a line's end
    start in a line that ends in the beginning of one. Only the pieces that own such a line are put
    together, and only for the patterns that can do so: the text that travels follows those lines,
    not the input.
    """
    each = lines.select("artifact_id", "line_no", F.col("line").alias("text"))
    shown = S.packed(S.prepare(each, ["artifact_id", "line_no"]), ["artifact_id", "line_no"], "2 * line_no + 1", False)
    shown = written(shown, "leads")
    memory = shown.groupBy("artifact_id").agg(F.bit_or("mask").alias("mask"))
    memory = memory.where(F.col("mask").bitwiseAND(S.flag_bit("rwx")) != 0).select("artifact_id")
    start = shown.where("start <> 0").select(
        "artifact_id", F.expr(f"line_no DIV {int(size)}").alias("piece_no"), "start"
    )
    starting = start.groupBy("artifact_id", "piece_no").agg(F.bit_or("start").alias("start"))
    plain = starting.where(F.col("start").bitwiseAND(S.PLAIN_START) != 0)
    others = starting.where(F.col("start") == S.MEMORY_START).join(memory, "artifact_id", "left_semi")
    only = written(plain.union(others).select("artifact_id", "piece_no"), "starting")
    shown = shown.drop("line_no")
    if only.isEmpty():
        return shown
    cut = pieces(lines, size, ahead, only)
    keys = ["artifact_id", "piece_no"]
    crossing = S.packed(S.prepare(cut, keys, own="own"), ["artifact_id"], f"{2 * int(size)} * piece_no", True)
    return shown.unionByName(written(crossing, "crossing"))


def piece_findings(
    lines: DataFrame, size: int = PIECE_LINES, ahead: int = PIECE_AHEAD
) -> DataFrame:
    """Findings of large artifacts, one row each.

    ``severity_rank, slot, piece_no, match_no`` give the report order inside an artifact, where
    ``piece_no`` is the place of the line or piece that shows the match.
    """
    if size < 1 or ahead < 1:
        raise ValueError("size and ahead must be positive")
    shown = line_signals(lines, size, ahead)
    found = ", ".join(
        f"named_struct('slot', '{s}', 'found', {slot_findings(s)})"
        for s in SLOTS
        if s not in MULTI_RULES
    )
    single = (
        S.merged(shown, "artifact_id")
        .selectExpr("artifact_id", f"inline(array({found}))")
        .selectExpr(
            "artifact_id",
            "slot",
            "0L AS piece_no",
            "posexplode(found) AS (match_no, f)",
        )
        .select("artifact_id", "slot", "piece_no", "match_no", "f.*")
    )

    matches = shown.selectExpr("artifact_id", "at AS piece_no", "inline(lists)")
    # Repeats of one piece of evidence are folded before the shuffle.
    distinct = matches.groupBy("artifact_id", "slot", "evidence").agg(
        F.min(F.struct("piece_no", "match_no")).alias("at")
    )
    filled = " ".join(f"WHEN '{s}' THEN {finding(s, 'evidence')}" for s in MULTI_RULES)
    repeated = distinct.selectExpr(
        "artifact_id",
        "slot",
        "at.piece_no",
        "at.match_no",
        f"CASE slot {filled} END AS f",
    ).select("artifact_id", "slot", "piece_no", "match_no", "f.*")

    return (
        single.unionByName(repeated)
        .withColumn("severity_rank", F.expr(severity_rank("severity")))
        .withColumn("slot", F.expr(slot_rank("slot")))
    )


REPORT_ORDER = ("severity_rank", "slot", "piece_no", "match_no")


def piece_verdicts(
    lines: DataFrame, size: int = PIECE_LINES, ahead: int = PIECE_AHEAD
) -> DataFrame:
    """Verdict, finding count and priority finding of large artifacts.

    Artifacts without findings come from the line table itself and stay ``undetermined``.
    """
    found = piece_findings(lines, size, ahead)
    top = F.min(
        F.struct(*REPORT_ORDER, "severity", "rule_id", "indicator", "evidence")
    )
    best = found.groupBy("artifact_id").agg(
        F.count("*").alias("n"), top.alias("top")
    )
    everyone = lines.select("artifact_id").distinct()
    return everyone.join(best, "artifact_id", "left").select(
        "artifact_id",
        F.expr(verdict_of("top.severity")).alias("verdict"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_findings"),
        F.col("top.rule_id").alias("priority_rule"),
        F.col("top.indicator").alias("priority_indicator"),
        F.col("top.evidence").alias("priority_evidence"),
    )


def piece_next_steps(found: DataFrame) -> DataFrame:
    """The first three suggestions per artifact from a ``piece_findings`` table.

    The row limit is applied inside each task before the shuffle (window group limit), so an
    artifact with most of the findings sends three rows per task.
    """
    order = Window.partitionBy("artifact_id").orderBy(*REPORT_ORDER)
    return (
        found.withColumn("step_no", F.row_number().over(order).cast("long"))
        .where(F.col("step_no") <= 3)
        .select("artifact_id", "step_no", "next")
    )


# ---------------------------------------------------------------- roll-ups
def verdict_counts(triaged: DataFrame) -> DataFrame:
    return triaged.groupBy("verdict").agg(F.count("*").alias("n_artifacts"))


def indicator_counts(
    found: DataFrame, keys: list[str] | None = None
) -> DataFrame:
    """Findings and artifacts per rule and severity.

    Findings are first counted per artifact, so the second count needs no DISTINCT.
    """
    keys = keys or ["artifact_id"]
    each = found.groupBy("rule_id", "severity", *keys).agg(F.count("*").alias("n"))
    return each.groupBy("rule_id", "severity").agg(
        F.sum("n").alias("n_findings"), F.count("*").alias("n_artifacts")
    )
