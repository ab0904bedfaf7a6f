"""Answers to counting plans: one plan over one log, or many plans over many artifacts at once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions.frames import written
from ..functions.predicates import (
    drops_wrappers,
    extracted,
    is_wrapper,
    lines_for,
    root_lines,
    text_column,
    words_of,
)
from ..functions.sql import quote


@dataclass(frozen=True)
class Plan:
    """A validated plan: which lines, which value, which aggregate."""

    event_filter: str = "all_events"
    extract_field: str = "none"
    aggregate: str = "count_rows"
    root: bool = False
    phrases: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        if (
            self.event_filter not in C.FILTERS
            or self.extract_field not in C.EXTRACTIONS
            or self.aggregate not in C.AGGREGATES
        ):
            raise ValueError("value outside the catalog")
        if self.event_filter == "quoted_phrase" and not self.phrases:
            raise ValueError("quoted_phrase needs a phrase")
        if self.root and not C.FILTERS[self.event_filter].root_text:
            raise ValueError(f"{self.event_filter} has no canonical root form")
        if self.aggregate == "count_rows":
            object.__setattr__(self, "extract_field", "none")
        elif self.extract_field == "none":
            raise ValueError(f"{self.aggregate} needs an extract_field")
        carriers = C.CARRIED_BY.get(self.extract_field)
        if carriers is not None and self.event_filter not in carriers:
            raise ValueError(f"{self.event_filter} lines do not carry {self.extract_field}")

    @property
    def plan_id(self) -> str:
        parts = [self.event_filter, self.extract_field, self.aggregate]
        if self.root:
            parts.append("root")
        return "/".join([*parts, *self.phrases])

    def lines(self) -> Column:
        return lines_for(
            self.event_filter,
            self.aggregate,
            self.extract_field,
            self.root,
            self.phrases,
        )


def answer(logs: DataFrame, plan: Plan, exact: bool = True) -> DataFrame:
    """One plan over one log as ``v STRING, c BIGINT``.

    A count has no value. ``exact=False`` lets a distinct count be approximate.
    """
    nothing = F.lit(None).cast("string").alias("v")
    if plan.aggregate == "count_rows":
        return logs.where(plan.lines()).agg(F.count("*").alias("c")).select(nothing, "c")
    # The value is a column of the aggregation only: a filter on it would be moved below and run
    # the extraction a second time. A value without a match is NULL instead.
    rows = logs.where(
        lines_for(plan.event_filter, plan.aggregate, "none", plan.root, plan.phrases)
    )
    value = extracted(plan.extract_field)
    matched = bool(C.EXTRACTIONS[plan.extract_field].pattern)
    if matched:
        value = F.nullif(value, F.lit(""))
    if plan.aggregate == "count_distinct_values":
        n = F.count_distinct(value) if exact else F.approx_count_distinct(value)
        return rows.agg(n.alias("c")).select(nothing, "c")
    counted = rows.groupBy(value.alias("v")).agg(F.count("*").alias("c"))
    order = [F.desc("c"), F.asc_nulls_last("v")]
    if not matched:
        return counted.orderBy(*order).limit(1)
    # Lines without a match are one NULL group, ranked after all others and then dropped.
    top = counted.orderBy(F.col("v").isNull(), *order).limit(1)
    return top.where(F.col("v").isNotNull())


def answer_all(
    logs: DataFrame, plans: list[Plan], keys: list[str] | None = None
) -> DataFrame:
    """Every plan for every artifact in one pass: ``keys..., plan_id, v, c``.

    Words, root forms and extractions are projected once per line, however many plans use them.
    Plans over one field form a group with a slot per distinct condition. A line emits, per group
    that selects it, one row with the field's value and a 0/1 per slot; plain counts are a group
    without a value. ``(group, value)`` rows are summed with map-side combine over plain numbers,
    so one row per distinct value is shuffled, not one per line. The second fold takes one row
    per plan and value and combines before its shuffle too. Neither a hot artifact nor a hot
    value gathers in one task.
    """
    keys = ["artifact_id"] if keys is None else keys
    plans = list(dict.fromkeys(plans))
    if not plans:
        raise ValueError("no plans")
    number = {p: i for i, p in enumerate(plans)}
    facts, condition = _facts(plans)
    groups = _groups(plans, condition)
    width = max(len(g.conditions) for g in groups)

    def emit(n: int, group: _Group) -> str:
        slots = [f"int({c})" for c in group.conditions]
        slots += ["0"] * (width - len(slots))
        listed = ", ".join(f"'s{i}', {c}" for i, c in enumerate(slots))
        value = f"cast(x_{group.field} AS string)" if group.field else "cast(NULL AS string)"
        row = f"named_struct('g', {n}, 'v', {value}, {listed})"
        if not group.field:
            return row
        chosen = " OR ".join(f"({c})" for c in group.conditions)
        return f"IF({chosen}, {row}, NULL)"

    rows = ", ".join(emit(n, g) for n, g in enumerate(groups))
    emitted = logs.select(*keys, *facts).selectExpr(*keys, f"inline(array({rows}))")
    emitted = emitted.where("g IS NOT NULL")
    per_value = emitted.groupBy(*keys, "g", "v").agg(
        *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)]
    )

    # Back to one row per plan and value. Every artifact has the group without a value, which
    # also gives a distinct count over no line its zero.
    def expand(n: int, group: _Group) -> str:
        listed = [
            f"named_struct('plan', {number[p]}, 'v', v, 'n', s{slot})"
            for p, slot in group.slots
        ]
        if group.field:
            return f"WHEN g = {n} THEN filter(array({', '.join(listed)}), r -> r.n > 0)"
        listed += [
            f"named_struct('plan', {number[p]}, 'v', v, 'n', 0L)"
            for p in plans
            if n == 0 and p.aggregate == "count_distinct_values"
        ]
        if not listed:
            return f"WHEN g = {n} THEN cast(array() AS array<struct<plan:int,v:string,n:bigint>>)"
        return f"WHEN g = {n} THEN array({', '.join(listed)})"

    expanded = " ".join(expand(n, g) for n, g in enumerate(groups))
    parts = per_value.selectExpr(*keys, f"inline(CASE {expanded} END)")
    # Most frequent first, ties to the smallest value, NULL after every value.
    folded = parts.groupBy(*keys, "plan").agg(
        F.sum("n").alias("lines"),
        F.count("v").alias("values"),
        F.expr("min(struct(-n AS n, v IS NULL AS z, v))").alias("top"),
    )
    described = F.broadcast(
        logs.sparkSession.createDataFrame(
            [(i, p.plan_id, p.aggregate) for p, i in number.items()],
            "plan int, plan_id string, aggregate string",
        )
    )
    is_top = F.col("aggregate") == C.AGGREGATES[2]
    return folded.join(described, "plan").select(
        *keys,
        "plan_id",
        F.when(is_top, F.col("top.v")).alias("v"),
        F.when(is_top, -F.col("top.n"))
        .when(F.col("aggregate") == C.AGGREGATES[1], F.col("values"))
        .otherwise(F.col("lines"))
        .alias("c"),
    )


# Conditions per group; further ones open another group.
SLOTS = 32


@dataclass(frozen=True)
class _Group:
    """Plans over one field (None: plain counts) and the distinct conditions they share."""

    field: str | None
    conditions: list[str]
    slots: list[tuple[Plan, int]]


def _groups(plans: list[Plan], condition) -> list[_Group]:
    groups = [_Group(None, [], [])]
    current: dict[str | None, _Group] = {None: groups[0]}
    for p in plans:
        name = None if p.aggregate == "count_rows" else p.extract_field
        c = condition(p)
        group = current.get(name)
        if group is None or (c not in group.conditions and len(group.conditions) == SLOTS):
            group = current[name] = _Group(name, [], [])
            groups.append(group)
        if c not in group.conditions:
            group.conditions.append(c)
        group.slots.append((p, group.conditions.index(c)))
    return groups


def _facts(plans: list[Plan]):
    """Columns the plans share, and a function giving a plan's condition over them as SQL."""
    words: dict[str, int] = {}
    roots: dict[str, int] = {}
    fields: dict[str, None] = {}
    for p in plans:
        root_text = C.FILTERS[p.event_filter].root_text if p.root else None
        for w in words_of(p.event_filter, p.root, p.phrases):
            target = roots if w == root_text else words
            target.setdefault(w, len(target))
        if p.extract_field != "none":
            fields[p.extract_field] = None

    columns = [
        *[text_column().contains(w).alias(f"w{i}") for w, i in words.items()],
        *[root_lines(t).alias(f"r{i}") for t, i in roots.items()],
        is_wrapper().alias("wrapped"),
        *[extracted(f).alias(f"x_{f}") for f in fields],
    ]

    def condition(p: Plan) -> str:
        root_text = C.FILTERS[p.event_filter].root_text if p.root else None
        chosen = words_of(p.event_filter, p.root, p.phrases)
        parts = [f"r{roots[w]}" if w == root_text else f"w{words[w]}" for w in chosen]
        if drops_wrappers(chosen, p.aggregate):
            parts.append("NOT wrapped")
        if C.EXTRACTIONS[p.extract_field].pattern:
            parts.append(f"x_{p.extract_field} <> ''")
        return " AND ".join(parts) or "true"

    return columns, condition


def catalog_plans() -> list[Plan]:
    """Every plan of the catalog that needs no phrase."""
    found = []
    for name, entry in C.FILTERS.items():
        if name == "quoted_phrase":
            continue
        for root in (False, True) if entry.root_text else (False,):
            found.append(Plan(name, root=root))
            for value in list(C.EXTRACTIONS)[1:]:
                if name in C.CARRIED_BY.get(value, (name,)):
                    for aggregate in C.AGGREGATES[1:]:
                        found.append(Plan(name, value, aggregate, root))
    return found


# Asked plans that travel with a line in one row, on average.
PACK = 64
ASKED = [
    "words",
    "skip_wrappers",
    "account_scope",
    "extract_field",
    "aggregate",
]


def answer_questions(logs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Answers to checked questions: ``artifact_id, question_id, v, c, reason``.

    ``wanted`` has ``artifact_id, question_id``, the columns ``words, skip_wrappers,
    account_scope, extract_field, aggregate`` that ``questions.check_plans`` gives a valid plan, and
    the ``reason`` that ``family.restrict_plans`` gives where the artifact cannot answer. Such a
    question keeps its reason and gets no number.

    Questions asking the same of the same artifact are answered once. An artifact's distinct asked
    plans are packed, about 64 to a row, so a line meets them packed and emits only the plans that
    select it; these are counted per value before the shuffle. Packs are dealt by a digest, so no
    window runs over an artifact's plans. The join key is the artifact, where AQE can split the
    lines of a hot one. ``wanted`` is written once and read twice, as checking plans costs more than
    the rows do. Counts without a line are 0; a top value without a line is NULL in both columns.
    """
    wanted = written(wanted.select("artifact_id", "question_id", *ASKED, "reason"), "wanted")
    asked = (
        wanted.where("reason IS NULL")
        .groupBy("artifact_id", *ASKED)
        .agg(F.count("question_id").alias("n_asked"))
    )
    packs = asked.groupBy("artifact_id").agg(F.ceil(F.count("*") / PACK).alias("n_packs"))
    packed = (
        asked.join(packs, "artifact_id")
        .withColumn("pack", F.pmod(F.xxhash64(*ASKED), F.col("n_packs")))
        .groupBy("artifact_id", "pack")
        .agg(F.collect_list(F.struct(*ASKED)).alias("plans"))
    )
    roots = [f.root_text for f in C.FILTERS.values() if f.root_text]
    fields = [n for n in C.EXTRACTIONS if n != "none"]
    lines = logs.select(
        "artifact_id",
        C.TEXT,
        is_wrapper().alias("wrapped"),
        *[root_lines(t).alias(f"r{i}") for i, t in enumerate(roots)],
        *[extracted(f).cast("string").alias(f"x_{f}") for f in fields],
    )
    rooted = " ".join(
        f"WHEN p.account_scope = 'root' AND w = {quote(t)} THEN r{i}"
        for i, t in enumerate(roots)
    )
    found = f"forall(p.words, w -> CASE {rooted} ELSE contains({C.TEXT}, w) END)"
    value = " ".join(f"WHEN '{f}' THEN x_{f}" for f in fields)
    guarded = ", ".join(f"'{f}'" for f in fields if C.EXTRACTIONS[f].pattern)
    value = f"CASE p.extract_field {value} END"
    chosen = (
        f"transform(filter(plans, p -> NOT (p.skip_wrappers AND wrapped) AND {found} "
        f"AND (p.extract_field NOT IN ({guarded}) OR {value} <> '')), "
        f"p -> struct({', '.join('p.' + a for a in ASKED)}, {value} AS v))"
    )
    per_value = (
        lines.join(packed, "artifact_id")
        .selectExpr("artifact_id", f"inline({chosen})")
        .groupBy("artifact_id", *ASKED, "v")
        .agg(F.count("*").alias("k"))
    )
    # Most frequent first, ties to the smallest value, NULL after every value.
    folded = per_value.groupBy("artifact_id", *ASKED).agg(
        F.sum("k").alias("lines"),
        F.count("v").alias("values"),
        F.expr("min(struct(-k AS k, v IS NULL AS z, v))").alias("top"),
    )
    is_top = F.col("aggregate") == C.AGGREGATES[2]
    zero = F.lit(0).cast("long")
    answered = F.col("reason").isNull()
    return wanted.join(folded, ["artifact_id", *ASKED], "left").select(
        "artifact_id",
        "question_id",
        F.when(answered & is_top, F.col("top.v")).alias("v"),
        F.when(answered & is_top, -F.col("top.k"))
        .when(answered & (F.col("aggregate") == C.AGGREGATES[1]), F.coalesce("values", zero))
        .when(answered, F.coalesce("lines", zero))
        .alias("c"),
        "reason",
    )


__all__ = [
    "Plan",
    "answer",
    "answer_all",
    "answer_questions",
    "catalog_plans",
]
