"""The registered queries: each runs an operator over whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions import rules as R
from ..functions.frames import shared_folder
from ..functions.predicates import extracted, like
from ..functions.text import lines_of
from ..operators import answers as A
from ..operators import family, questions, triage, votes
from ..operators.answers import Plan
from ..operators.excerpt import excerpts, piece_excerpts
from ..operators.profile import profile
from ..sources import tool_text
from ..sources.logs import parse_csv_lines, read_logs, to_csv_line, write_logs
from . import views as V

Query = Callable[[SparkSession, str], DataFrame]

# Quoted phrases used by the phrase queries.
PHRASE = "port 22"
REFINED = "check pass; user unknown"
IMPLIED = "PASSWORD"
UNDERSCORE = "utm_source=f"
SPECIAL = "%%% "

EXCERPT_BUDGET = 500
DOCUMENT_BUDGET = 1200
BIG_BUDGET = 3000

# The plans behind the single-plan queries.
PLANS = {
    **{
        f"flt_{name}": Plan(name)
        for name in C.FILTERS
        if name != "quoted_phrase"
    },
    "flt_quoted_phrase": Plan("quoted_phrase", phrases=(PHRASE,)),
    "flt_session_root": Plan("session_opened", root=True),
    "flt_wrapper_only": Plan("quoted_phrase", phrases=(C.WRAPPER,)),
    "flt_phrase_refines": Plan("pam_user_unknown", phrases=(REFINED,)),
    "flt_phrase_implied": Plan("failed_password", phrases=(IMPLIED,)),
    "flt_phrase_added": Plan("failed_password", phrases=(PHRASE,)),
    "distinct_source_ip": Plan("all_events", "source_ip", C.AGGREGATES[1]),
    "distinct_rhost_ip": Plan("all_events", "pam_rhost_ip", C.AGGREGATES[1]),
    "distinct_invalid_username": Plan(
        "invalid_user", "invalid_username", C.AGGREGATES[1]
    ),
    "distinct_event_id": Plan("all_events", "event_id", C.AGGREGATES[1]),
    "distinct_failed_source_ip": Plan("failed_password", "source_ip", C.AGGREGATES[1]),
    "top_source_ip": Plan("all_events", "source_ip", C.AGGREGATES[2]),
    "top_rhost_ip": Plan("pam_auth_failure", "pam_rhost_ip", C.AGGREGATES[2]),
    "top_invalid_username": Plan("invalid_user", "invalid_username", C.AGGREGATES[2]),
    "top_event_id": Plan("all_events", "event_id", C.AGGREGATES[2]),
    "top_failed_source_ip": Plan("failed_password", "source_ip", C.AGGREGATES[2]),
}


def _plan_query(plan: Plan) -> Query:
    if plan.aggregate == C.AGGREGATES[2]:
        return lambda spark, sf: A.answer(V.auth_log(spark, sf), plan)
    return lambda spark, sf: A.answer(V.auth_log(spark, sf), plan).select("c")


def like_characters(spark: SparkSession, sf: str) -> DataFrame:
    pages = V.table(spark, sf, "pages").withColumnRenamed("html", C.TEXT)
    return A.answer(pages, Plan("quoted_phrase", phrases=(SPECIAL,))).select("c")


def like_underscore(spark: SparkSession, sf: str) -> DataFrame:
    pages = V.table(spark, sf, "pages").withColumnRenamed("url", C.TEXT)
    return A.answer(pages, Plan("quoted_phrase", phrases=(UNDERSCORE,))).select("c")


def batch_plans(spark: SparkSession, sf: str) -> DataFrame:
    return A.answer_all(V.auth_logs(spark, sf), A.catalog_plans())


def family_scan(spark: SparkSession, sf: str) -> DataFrame:
    return family.scan(V.mixed_logs(spark, sf)).select(
        "artifact_id", "family", "reason", "has_ipv6", "n_lines", "n_marked", "n_ipv6"
    )


def present_filters(spark: SparkSession, sf: str) -> DataFrame:
    return family.scan(V.mixed_logs(spark, sf)).select(
        "artifact_id", F.array_join("present_filters", ",").alias("present")
    )


def marker_counts(spark: SparkSession, sf: str) -> DataFrame:
    return family.marker_counts(V.mixed_logs(spark, sf))


def ipv6_scan(spark: SparkSession, sf: str) -> DataFrame:
    return (
        family.scan(V.mixed_logs(spark, sf), [])
        .select("has_ipv6", "n_ipv6", "n_lines")
    )


def _joined(profiled: DataFrame, *keys: str) -> DataFrame:
    return profiled.select(
        *keys,
        "column_name",
        "column_type",
        F.array_join("examples", "|").alias("examples"),
    )


def profile_log(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(profile(V.auth_log(spark, sf)))


def profile_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(
        profile(V.mixed_logs(spark, sf), keys=["artifact_id"]), "artifact_id"
    )


def profile_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(profile(V.table(spark, sf, "documents")))


def csv_lines(spark: SparkSession, sf: str) -> DataFrame:
    """CSV text with quotes and commas in it, parsed by the log reader's rules."""
    written = V.table(spark, sf, "events").select(
        to_csv_line("event_id", "event_type", "props").alias("line")
    )
    schema = "event_id bigint, event_type string, props string"
    parsed = written.select(parse_csv_lines(F.col("line"), schema).alias("r"))
    return parsed.groupBy("r.event_type", "r.props").agg(
        F.count("*").alias("n"), F.sum("r.event_id").alias("id_sum")
    )


def text_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line ends normalised, then cut into lines."""
    docs = V.table(spark, sf, "documents")
    crlf = F.regexp_replace("text", "\n", "\r\n")
    text = F.regexp_replace(crlf, "\r\n?", "\n")
    return docs.select(
        "doc_id",
        F.size(lines_of(text)).cast("long").alias("n_lines"),
        F.length(text).cast("long").alias("n_text"),
    )


# ---------------------------------------------------------------- files
def _artifact_of(path: str):
    """The artifact that a file's folder names."""
    return F.regexp_extract(path, "artifact=([0-9]+)", 1).cast("bigint")


def _tool_files(spark: SparkSession, sf: str) -> str:
    """The long artifacts as text files, one each."""
    folder = shared_folder(spark, "tool-files")
    lines = V.big_tool_lines(spark, sf).withColumn("artifact", F.col("artifact_id"))
    placed = lines.repartition("artifact").sortWithinPartitions("artifact", "line_no")
    placed.select("artifact", "line").write.partitionBy("artifact").text(folder)
    return f"{folder}/*/*.txt"


def file_line_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Text files read as numbered lines."""
    lines = tool_text.read_lines(spark, _tool_files(spark, sf))
    return triage.piece_verdicts(lines.withColumn("artifact_id", _artifact_of("artifact_id")))


def file_text_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Text files read as whole texts."""
    texts = tool_text.read_texts(spark, _tool_files(spark, sf))
    found = triage.priority(triage.triage_texts(texts)).drop("next_steps")
    return found.withColumn("artifact_id", _artifact_of("artifact_id"))


def _log_files(spark: SparkSession, sf: str) -> str:
    """Folders of the auth logs as CSV files; half of them with another order of columns and a further one."""
    folder = shared_folder(spark, "log-files")
    logs = V.auth_logs(spark, sf).withColumn("artifact", F.col("artifact_id"))
    plain = ["LineId", "Content", "EventId", "EventTemplate"]
    other = ["EventTemplate", "Component", "EventId", "LineId", "Content"]
    for name, columns, chosen in (("a", plain, "artifact % 2 = 0"), ("b", other, "artifact % 2 <> 0")):
        write_logs(logs.where(chosen), f"{folder}/{name}", "artifact", columns)
    return f"{folder}/*/*"


def file_answers(spark: SparkSession, sf: str) -> DataFrame:
    """CSV files of two layouts, read as one glob, and every plan for each."""
    logs = read_logs(spark, _log_files(spark, sf), named="*.csv")
    logs = logs.withColumn("artifact_id", _artifact_of("artifact_id"))
    return A.answer_all(logs, A.catalog_plans())


def file_families(spark: SparkSession, sf: str) -> DataFrame:
    """The family that each file's own header and lines give."""
    logs = read_logs(spark, _log_files(spark, sf), named="*.csv")
    found = family.scan(logs.withColumn("artifact_id", _artifact_of("artifact_id")))
    return found.select("artifact_id", F.col("family").isNotNull().alias("known"), "n_lines")


# ---------------------------------------------------------------- triage
def triaged(spark: SparkSession, sf: str) -> DataFrame:
    return triage.triage_texts(V.tool_output(spark, sf))


def triage_findings(spark: SparkSession, sf: str) -> DataFrame:
    return triage.findings_table(triaged(spark, sf))


def triage_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return triage.priority(triaged(spark, sf)).withColumn(
        "next_steps", F.array_join("next_steps", "|")
    )


def triage_report(spark: SparkSession, sf: str) -> DataFrame:
    return triaged(spark, sf).select(
        "artifact_id", triage.report_text(F.col("findings")).alias("report")
    )


def findings_block(spark: SparkSession, sf: str) -> DataFrame:
    return triaged(spark, sf).select(
        "artifact_id", triage.block_text(F.col("findings")).alias("block")
    )


def triage_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return triage.verdict_counts(triaged(spark, sf))


def indicator_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return triage.indicator_counts(triage_findings(spark, sf))


def triage_documents(spark: SparkSession, sf: str) -> DataFrame:
    return triage.priority(triage.triage_texts(V.texts(spark, sf))).drop("next_steps")


def big_findings(spark: SparkSession, sf: str) -> DataFrame:
    return triage.piece_findings(V.big_tool_lines(spark, sf)).select(
        "artifact_id", "rule_id", "severity", "indicator", "evidence", "why", "next"
    )


def big_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return triage.piece_verdicts(V.big_tool_lines(spark, sf))


def big_next_steps(spark: SparkSession, sf: str) -> DataFrame:
    return triage.piece_next_steps(triage.piece_findings(V.big_tool_lines(spark, sf)))


def _rule_query(rule_id: str) -> Query:
    return lambda spark, sf: triage.rule_findings(
        V.tool_output(spark, sf), rule_id
    ).select("artifact_id", "severity", "indicator", "evidence")


def excerpt(spark: SparkSession, sf: str) -> DataFrame:
    return excerpts(triaged(spark, sf), EXCERPT_BUDGET)


def big_excerpt(spark: SparkSession, sf: str) -> DataFrame:
    lines = V.big_tool_lines(spark, sf)
    return piece_excerpts(lines, triage.piece_findings(lines), BIG_BUDGET)


def excerpt_documents(spark: SparkSession, sf: str) -> DataFrame:
    return excerpts(triage.triage_texts(V.texts(spark, sf)), DOCUMENT_BUDGET)


# ---------------------------------------------------------------- questions
def question_audit(spark: SparkSession, sf: str) -> DataFrame:
    read = questions.read_questions(V.questions(spark, sf).drop("plan"))
    return read.select(
        "question_id",
        F.array_join("phrases", "|").alias("phrases"),
        "root_scope",
        "how_many",
        F.array_join("kinds", ",").alias("kinds"),
        "unquoted",
        "decline_code",
        "decline_reason",
    )


def decline_report(spark: SparkSession, sf: str) -> DataFrame:
    return questions.decline_report(
        questions.read_questions(V.questions(spark, sf).drop("plan"))
    )


def checked_plans(spark: SparkSession, sf: str) -> DataFrame:
    return questions.check_plans(questions.read_questions(V.questions(spark, sf)))


def plan_check(spark: SparkSession, sf: str) -> DataFrame:
    return checked_plans(spark, sf).select(
        "question_id",
        "reason",
        F.when(F.col("reason").isNull(), F.col("event_filter")).alias("event_filter"),
        F.when(F.col("reason").isNull(), F.col("extract_field")).alias("extract_field"),
        F.when(F.col("reason").isNull(), F.col("account_scope")).alias("account_scope"),
        F.array_join("words", "|").alias("words"),
        "skip_wrappers",
        "explanation",
    )


def plan_restrict(spark: SparkSession, sf: str) -> DataFrame:
    valid = checked_plans(spark, sf).where("reason IS NULL")
    plans = valid.select("artifact_id", "question_id", "event_filter", "extract_field")
    return family.restrict_plans(plans, family.scan(V.mixed_logs(spark, sf)))


def question_answers(spark: SparkSession, sf: str) -> DataFrame:
    """From questions and plans to answers or a reason, for every artifact."""
    return _answered(spark, sf, checked_plans(spark, sf).where("reason IS NULL"))


def _answered(spark: SparkSession, sf: str, valid: DataFrame) -> DataFrame:
    logs = V.mixed_logs(spark, sf)
    columns = list(dict.fromkeys(["artifact_id", "question_id", "event_filter", *A.ASKED]))
    wanted = family.restrict_plans(valid.select(*columns), family.scan(logs))
    return A.answer_questions(logs, wanted.withColumnRenamed("artifact_reason", "reason"))


def phrase_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Line counts of the valid plain-count plans, by the literal words of each."""
    valid = checked_plans(spark, sf).where(
        "reason IS NULL AND aggregate = 'count_rows' AND account_scope = 'any_user'"
    )
    return _answered(spark, sf, valid).drop("v")


# ---------------------------------------------------------------- votes
def vote_majority(spark: SparkSession, sf: str) -> DataFrame:
    return votes.majority(V.candidates(spark, sf))


def vote_unanimous(spark: SparkSession, sf: str) -> DataFrame:
    cast = V.table(spark, sf, "events").selectExpr(
        "CASE WHEN event_id % 3 = 0 THEN 0L ELSE 1L + event_id DIV 8 END AS question_id",
        "event_id AS pos",
        "concat('plan ', user_id % 2) AS plan",
        "CASE WHEN event_type = 'error' AND user_id % 5 = 0 THEN 'bad vote' END AS reason",
    )
    return votes.unanimous(cast)


def cross_check(spark: SparkSession, sf: str) -> DataFrame:
    first = votes.majority(V.candidates(spark, sf)).select(
        "question_id", "result", "ok"
    )
    """Against the votes of another run over the same candidates, which failed on other ones."""
    again = F.when(F.col("pos") % 5 == 0, F.lit("Timeout"))
    second = V.candidates(spark, sf).withColumn("err", again)
    other = votes.majority(second).select("question_id", "result", "ok")
    return votes.cross_check(first, other)


def result_keys(spark: SparkSession, sf: str) -> DataFrame:
    keyed = V.candidates(spark, sf).select(
        votes.result_key(F.col("result_json")).alias("key"),
        votes.usable().alias("is_usable"),
    )
    return keyed.groupBy("key", "is_usable").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- the SELECT subset
def _sel(build) -> Query:
    return lambda spark, sf: build(V.auth_log(spark, sf))


def _value(log: DataFrame, pattern: str, name: str) -> DataFrame:
    value = F.regexp_extract(C.TEXT, pattern, 1)
    return log.select(value.alias(name)).where(F.col(name) != "")


SELECTS: dict[str, Query] = {
    "sel_mentions": _sel(
        lambda log: log.where(F.col(C.TEXT).contains("session opened")).agg(
            F.count("*").alias("c")
        )
    ),
    "sel_port_top": _sel(
        lambda log: _value(log, r"port (\d+)", "p")
        .groupBy("p")
        .agg(F.count("*").alias("c"))
        .orderBy(F.desc("c"), F.asc_nulls_last("p"))
        .limit(1)
    ),
    "sel_distinct_pid": _sel(
        lambda log: log.agg(F.count_distinct("Pid").alias("c"))
    ),
    "sel_round": _sel(
        lambda log: log.select(F.round(F.col("Pid"), -1).alias("x"))
        .groupBy("x")
        .agg(F.count("*").alias("c"))
    ),
    "sel_filter_agg": _sel(
        lambda log: log.groupBy("Component").agg(
            F.count_if(F.col(C.TEXT).contains("Failed")).alias("c"),
            F.expr("count(DISTINCT EventId) FILTER (WHERE Pid > 75)").alias("u"),
            F.count("EventId").alias("n"),
        )
    ),
    "sel_or_precedence": _sel(
        lambda log: log.where(
            F.col(C.TEXT).contains("Failed")
            | F.col(C.TEXT).contains("Accepted") & (F.col("Pid") <= 50)
        ).agg(F.count("*").alias("c"))
    ),
    "sel_compare": _sel(
        lambda log: log.where(
            (F.col("Pid") != 7)
            & (F.col("Pid") >= 2)
            & (F.col("EventTemplate") > "click")
            & (F.col("EventTemplate") <= "view")
        )
        .groupBy(F.col("EventTemplate").alias("t"))
        .agg(
            F.count("*").alias("c"),
            F.count_if(F.col("Pid") < 40).alias("low"),
            F.count_if(F.col("Pid") == 40).alias("same"),
        )
    ),
    "sel_like": _sel(
        lambda log: log.where(
            like(F.col(C.TEXT), "%user=ro_t") & ~like(F.col(C.TEXT), "%[%")
        ).agg(F.count("*").alias("c"))
    ),
    "sel_whole_match": _sel(
        lambda log: log.select(
            F.regexp_extract(C.TEXT, r"user=\w+", 0).alias("x")
        )
        .groupBy("x")
        .agg(F.count("*").alias("c"))
    ),
    "sel_order_limit": _sel(
        lambda log: log.groupBy("EventId", extracted("source_ip").alias("ip"))
        .agg(F.count("*").alias("c"))
        .orderBy(
            F.desc_nulls_last("c"),
            F.asc_nulls_last("EventId"),
            F.desc_nulls_last("ip"),
        )
        .limit(20)
    ),
}

QUERIES: dict[str, Query] = {
    **{name: _plan_query(plan) for name, plan in PLANS.items()},
    "flt_like_characters": like_characters,
    "flt_like_underscore": like_underscore,
    "batch_plans": batch_plans,
    "family_scan": family_scan,
    "present_filters": present_filters,
    "marker_counts": marker_counts,
    "ipv6_scan": ipv6_scan,
    "profile": profile_log,
    "profile_artifacts": profile_artifacts,
    "profile_documents": profile_documents,
    "csv_lines": csv_lines,
    "text_lines": text_lines,
    "file_line_verdicts": file_line_verdicts,
    "file_text_verdicts": file_text_verdicts,
    "file_answers": file_answers,
    "file_families": file_families,
    "triage_findings": triage_findings,
    "triage_verdicts": triage_verdicts,
    "triage_report": triage_report,
    "findings_block": findings_block,
    "triage_rollup": triage_rollup,
    "indicator_rollup": indicator_rollup,
    "triage_documents": triage_documents,
    "big_findings": big_findings,
    "big_verdicts": big_verdicts,
    "big_next_steps": big_next_steps,
    **{f"rule_{rule_id}": _rule_query(rule_id) for rule_id in R.REPORTS},
    "excerpt": excerpt,
    "excerpt_documents": excerpt_documents,
    "big_excerpt": big_excerpt,
    "question_audit": question_audit,
    "decline_report": decline_report,
    "plan_check": plan_check,
    "plan_restrict": plan_restrict,
    "phrase_answers": phrase_answers,
    "question_answers": question_answers,
    "vote_majority": vote_majority,
    "vote_unanimous": vote_unanimous,
    "cross_check": cross_check,
    "result_keys": result_keys,
    **SELECTS,
}
