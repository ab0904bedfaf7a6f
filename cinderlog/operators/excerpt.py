"""Bounded context for a summary: the findings block and the lines that carry the evidence.

``excerpts`` works on triaged texts, row by row and without a shuffle. ``piece_excerpts`` gives
the same for artifacts held as numbered lines, whatever share of the data one of them is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sql import quote
from ..functions.text import lines_of
from .findings import FINDING_TYPE
from .gram_index import contained
from .triage import REPORT_ORDER, block_text

# Default budget, room kept for the frame, and the texts of the frame.
BUDGET = 6000
FRAME = 160
HEAD = "RAW TOOL OUTPUT"
TAIL = "\n\nWrite a 2-4 sentence grounded summary."
TOKEN_BREAK = r"(?U)[\s,;:()\[\]\"']+"
TOKEN_LENGTH = 4


def _tokens_of(evidence: str) -> str:
    """Lower-case words of one evidence text that are at least four characters long."""
    words = f"split({evidence}, {quote(TOKEN_BREAK)}, -1)"
    return (
        f"transform(filter({words}, w -> length(w) >= {TOKEN_LENGTH}), w -> lower(w))"
    )


def evidence_tokens() -> str:
    """Distinct words of all evidence."""
    return f"array_distinct(flatten(transform(findings, f -> {_tokens_of('f.evidence')})))"


# Whole leading entries that fit: how many, by a fold that stops at the first overflow.
_LEADING = (
    "aggregate({lines}, named_struct('used', 0L, 'n', 0, 'open', true), "
    "(a, x) -> CASE WHEN a.open AND a.used + length(x) + 1 <= {limit} "
    "THEN named_struct('used', a.used + length(x) + 1, 'n', a.n + 1, 'open', true) "
    "ELSE named_struct('used', a.used, 'n', a.n, 'open', false) END, a -> a.n)"
)

# Lines that fit into what is left, in order; a line that does not fit is passed over. The cost
# is tested first, so once the budget is used up no further line is searched for evidence.
_FILL = (
    "aggregate({numbers}, named_struct('used', {used}, 'kept', cast(array() AS array<int>)), "
    "(a, i) -> CASE WHEN a.used + length(_lines[i]) + 1 <= _room AND {wanted} "
    "THEN named_struct('used', a.used + length(_lines[i]) + 1, 'kept', array_append(a.kept, i)) "
    "ELSE a END)"
)


def excerpts(
    triaged: DataFrame, budget: int = BUDGET, keys: list[str] | None = None
) -> DataFrame:
    """``keys..., text, findings`` -> ``keys..., n_lines, n_chosen, prompt``.

    The findings block gets at most half of the budget, the excerpt the rest. Lines holding an
    evidence word are chosen first, then the others, each in text order; both passes skip a line
    that does not fit. A line passed over in the first pass cannot fit in the second, so the
    second pass needs no evidence test.
    """
    keys = keys or ["artifact_id"]
    start = triaged.select(
        *keys,
        block_text(F.col("findings")).alias("_block"),
        lines_of(F.col("text")).alias("_lines"),
        F.expr(evidence_tokens()).alias("_tokens"),
    )
    blocked = start.withColumn("_block_lines", lines_of(F.col("_block"))).withColumn(
        "_total", F.size("_block_lines")
    )
    roomy = _fit_block(blocked, budget, keys, "_lines", "_tokens").selectExpr(
        "*",
        "CASE WHEN size(_lines) = 0 THEN cast(array() AS array<int>) "
        "ELSE sequence(0, size(_lines) - 1) END AS _numbers",
    )
    holds = "exists(_tokens, t -> contains(lower(_lines[i]), t))"
    chosen = _fill(roomy, "_numbers", holds).selectExpr(
        *keys,
        "_block",
        "cast(size(_lines) AS long) AS n_lines",
        "transform(_chosen, i -> _lines[i]) AS _shown",
    )
    return _assemble(chosen, budget, keys)


def _fit_block(df: DataFrame, budget: int, keys: list[str], *kept: str) -> DataFrame:
    """Cut the block to its leading lines if it is over half of the budget; room for the rest.

    ``_block_lines`` may hold only the lines that can matter; ``_total`` counts all of them.
    """
    limit = max(0, (budget - FRAME) // 2)
    note = quote(" more finding lines omitted to fit the model's context)")
    cut = (
        "concat(array_join(slice(_block_lines, 1, _n), '\\n'), '\\n... (', "
        f"cast(_total - _n AS string), {note})"
    )
    whole = f"length(_block) <= {limit} AND size(_block_lines) = _total"
    fitted = df.withColumn(
        "_n", F.expr(_LEADING.format(lines="_block_lines", limit=limit))
    ).selectExpr(*keys, *kept, f"CASE WHEN {whole} THEN _block ELSE {cut} END AS _block")
    return fitted.selectExpr(
        "*", f"greatest(0, {budget - FRAME} - length(_block)) AS _room"
    )


def _fill(df: DataFrame, numbers: str, holds: str) -> DataFrame:
    """Both passes over ``_lines``; adds the chosen indexes in text order as ``_chosen``."""
    first = df.withColumn(
        "_first", F.expr(_FILL.format(numbers=numbers, used="0", wanted=holds))
    )
    others = f"array_except({numbers}, _first.kept)"
    second = first.withColumn(
        "_second",
        F.expr(_FILL.format(numbers=others, used="_first.used", wanted="true")),
    )
    return second.withColumn(
        "_chosen", F.expr("array_sort(concat(_first.kept, _second.kept))")
    )


def _assemble(df: DataFrame, budget: int, keys: list[str]) -> DataFrame:
    omitted = (
        "concat(' (', cast(size(_shown) AS string), ' of ', cast(n_lines AS string), "
        "' lines shown; ', cast(n_lines - size(_shown) AS string), "
        f"{quote(chr(32) + 'omitted to fit the model' + chr(39) + 's context)')})"
    )
    prompt = (
        f"concat(_block, '\\n\\n', {quote(HEAD)}, "
        f"CASE WHEN size(_shown) < n_lines THEN {omitted} ELSE '' END, ':\\n', "
        f"array_join(_shown, '\\n'), {quote(TAIL)})"
    )
    return df.selectExpr(
        *keys,
        "n_lines",
        "cast(size(_shown) AS long) AS n_chosen",
        f"substring({prompt}, 1, {budget}) AS prompt",
    )


# ---------------------------------------------------------------- large artifacts
# No entry of the findings block is shorter than this.
SHORTEST_ENTRY = 40


def piece_excerpts(
    lines: DataFrame, found: DataFrame, budget: int = BUDGET
) -> DataFrame:
    """Excerpts of large artifacts: ``artifact_id, n_lines, n_chosen, prompt``.

    ``lines`` is ``artifact_id, line_no, line`` (as text mode gives them), ``found`` the table of
    ``triage.piece_findings``. The result equals ``excerpts`` on the joined text, and only what
    can be in an excerpt is ever gathered:

    * the used budget only grows, so of the lines of one length, the first ``budget // cost`` in
      priority order are the only ones that can be chosen. That limit is applied inside each task
      before the shuffle (window group limit) and leaves some ten thousand short lines at most;
    * of the findings, only as many as fit the block by their shortest form.

    Lines find their evidence words by an index of q-grams, so an artifact with many lines and many
    words costs its matches.

    ``found`` is read three times; Spark reuses the exchanges below it.
    """
    lines = lines.select(
        "artifact_id", "line_no", F.coalesce("line", F.lit("")).alias("line")
    )
    counted = lines.groupBy("artifact_id").agg(F.count("*").alias("n_lines"))

    words = found.selectExpr(
        "artifact_id", f"explode({_tokens_of('evidence')}) AS word"
    )
    fitting = lines.withColumn("cost", F.length("line") + 1).where(
        F.col("cost") <= budget
    )
    lowered = fitting.withColumn("lowered", F.lower("line"))
    held = contained(lowered, words, ["line_no"], line="lowered")
    hits = held.select("artifact_id", "line_no", "line", "cost").dropDuplicates(
        ["artifact_id", "line_no"]
    )
    ranked = Window.partitionBy("artifact_id", "cost").orderBy("line_no")

    def leading(df: DataFrame, hit: bool) -> DataFrame:
        numbered = df.withColumn("n", F.row_number().over(ranked))
        kept = numbered.where(
            (F.col("n") <= budget) & (F.col("n") <= F.floor(F.lit(budget) / F.col("cost")))
        )
        return kept.select("artifact_id", "line_no", "line", F.lit(hit).alias("hit"))

    candidates = (
        leading(hits, True)
        .unionByName(leading(fitting, False))
        .groupBy("artifact_id", "line_no")
        .agg(F.bool_or("hit").alias("hit"), F.any_value("line").alias("line"))
        .groupBy("artifact_id")
        .agg(F.array_sort(F.collect_list(F.struct("line_no", "line", "hit"))).alias("c"))
    )

    joined = (
        counted.join(candidates, "artifact_id", "left")
        .join(_leading_findings(found, budget), "artifact_id", "left")
        .selectExpr(
            "artifact_id",
            "n_lines",
            "coalesce(transform(c, x -> x.line), cast(array() AS array<string>)) AS _lines",
            "coalesce(transform(c, x -> x.hit), cast(array() AS array<boolean>)) AS _hits",
            f"coalesce(findings, cast(array() AS array<{FINDING_TYPE}>)) AS findings",
            "finding_lines",
        )
    )
    keys = ["artifact_id", "n_lines"]
    blocked = (
        joined.withColumn("_block", block_text(F.col("findings")))
        .withColumn("_block_lines", lines_of(F.col("_block")))
        .withColumn("_total", F.expr("coalesce(finding_lines + 1, size(_block_lines))"))
    )
    roomy = _fit_block(blocked, budget, keys, "_lines", "_hits").selectExpr(
        "*",
        "CASE WHEN size(_lines) = 0 THEN cast(array() AS array<int>) "
        "ELSE sequence(0, size(_lines) - 1) END AS _numbers",
    )
    chosen = _fill(roomy, "_numbers", "_hits[i]").selectExpr(
        *keys, "_block", "transform(_chosen, i -> _lines[i]) AS _shown"
    )
    return _assemble(chosen, budget, ["artifact_id"])


def _leading_findings(found: DataFrame, budget: int) -> DataFrame:
    """The findings that can be in the block, in report order, and the lines of all of them."""
    most = max(0, (budget - FRAME) // 2) // SHORTEST_ENTRY + 2
    order = Window.partitionBy("artifact_id").orderBy(*REPORT_ORDER)
    entry = "struct(rule_id, severity, indicator, evidence, why, next)"
    first = (
        found.withColumn("n", F.row_number().over(order))
        .where(F.col("n") <= most)
        .groupBy("artifact_id")
        .agg(F.expr(f"array_sort(collect_list(struct(n, {entry} AS f)))").alias("l"))
        .select("artifact_id", F.expr("transform(l, x -> x.f)").alias("findings"))
    )
    text = F.concat_ws("\n", "indicator", "evidence", "why", "next")
    total = found.groupBy("artifact_id").agg(
        F.sum(F.size(lines_of(text))).alias("finding_lines")
    )
    return first.join(total, "artifact_id")
