"""Answers to counting plans from stored sketches, merged for new files without reading old ones.

Exact answers (`answers.answer_all`) have to see every line again when files are added. Here each
artifact and plan keeps three things of a fixed size that merge: the number of lines, a HyperLogLog
sketch of the distinct values, and a sketch of the most frequent values. A table of them is written
once per load; any number of tables, in any order, merges into one.

Line counts are exact. A distinct count is off by about 1.04 / sqrt(2 ^ LG_K) of itself, one
standard error (0.8 per cent as set). The most frequent value and its count are exact while an artifact
holds fewer than three quarters of ``tracked`` different values under a plan; beyond, a value's count
is short by at most about 3.5 / ``tracked`` of the lines, so a value that leads by less may be missed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import catalog as C
from .answers import Plan, _facts

#: Size of a distinct-count sketch, as a power of two.
LG_K = 14
#: Values that a frequency sketch can hold.
TRACKED = 4096


def sketch(
    logs: DataFrame, plans: list[Plan], keys: list[str] | None = None, tracked: int = TRACKED
) -> DataFrame:
    """``keys..., plan_id, aggregate, lines, distinct, top`` of every plan that selects a line.

    One pass: words and extractions are projected once per line, and sketches are built on the map
    side, so what is shuffled is a sketch per task, artifact and plan. ``distinct`` and ``top`` are
    NULL for plans that only count lines.
    """
    keys = ["artifact_id"] if keys is None else keys
    plans = list(dict.fromkeys(plans))
    if not plans:
        raise ValueError("no plans")
    facts, condition = _facts(plans)

    def emit(n: int, p: Plan) -> str:
        value = "NULL" if p.aggregate == "count_rows" else f"x_{p.extract_field}"
        return f"IF({condition(p)}, struct({n} AS n, cast({value} AS string) AS v), NULL)"

    emitted = ", ".join(emit(n, p) for n, p in enumerate(plans))
    rows = logs.select(*keys, *facts).selectExpr(*keys, f"inline(array_compact(array({emitted})))")
    sketched = rows.groupBy(*keys, "n").agg(
        F.count("*").alias("lines"),
        F.hll_sketch_agg("v", F.lit(LG_K)).alias("distinct"),
        F.expr(f"approx_top_k_accumulate(v, {int(tracked)})").alias("top"),
    )
    named = F.array(*(F.struct(F.lit(p.plan_id).alias("id"), F.lit(p.aggregate).alias("a")) for p in plans))
    plan = F.get(named, F.col("n"))
    counting = plan["a"] == C.AGGREGATES[0]
    return sketched.select(
        *keys,
        plan["id"].alias("plan_id"),
        plan["a"].alias("aggregate"),
        "lines",
        F.when(~counting, F.col("distinct")).alias("distinct"),
        F.when(~counting, F.col("top")).alias("top"),
    )


def merge(tables: list[DataFrame], keys: list[str] | None = None) -> DataFrame:
    """One table from several: what one pass over all their lines would have kept."""
    keys = ["artifact_id"] if keys is None else keys
    every = reduce(DataFrame.unionByName, tables)
    held = every.groupBy(*keys, "plan_id", "aggregate").agg(
        F.sum("lines").alias("lines"),
        F.hll_union_agg("distinct").alias("distinct"),
    )
    # Counting plans have no frequency sketch to combine.
    tops = every.where("top IS NOT NULL").groupBy(*keys, "plan_id").agg(
        F.expr("approx_top_k_combine(top)").alias("top")
    )
    theirs = tops.toDF(*(f"_{k}" for k in keys), "_plan", "top")
    same = F.col("plan_id") == F.col("_plan")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return held.join(theirs, same, "left").select(
        *keys, "plan_id", "aggregate", "lines", "distinct", "top"
    )


def estimates(table: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys..., plan_id, v, c`` as `answers.answer_all` gives them, from sketches.

    As there, NULL comes after equally frequent values but can win by count; of more than sixteen
    equally frequent values not always the smallest is given.
    """
    keys = ["artifact_id"] if keys is None else keys
    # Read through a union, a sketch gives the same estimate whether or not it was merged.
    read = merge([table], keys).selectExpr(
        "*", "IF(top IS NULL, NULL, approx_top_k_estimate(top, 16)) AS _most"
    )
    best = F.expr("array_sort(transform(_most, x -> struct(-x.count AS n, x.item IS NULL AS z, x.item AS v)))[0]")
    is_top, counting = (F.col("aggregate") == C.AGGREGATES[i] for i in (2, 0))
    return read.withColumn("_best", best).select(
        *keys,
        "plan_id",
        F.when(is_top, F.col("_best.v")).alias("v"),
        F.when(counting, F.col("lines"))
        .when(is_top, -F.col("_best.n"))
        .otherwise(F.hll_sketch_estimate("distinct"))
        .alias("c"),
    )
