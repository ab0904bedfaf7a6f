"""Oracle SQL of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

from ..functions import catalog as C
from .oracle_questions import question_oracles
from .oracle_triage import lit, triage_oracles
from .registry import (
    BIG_BUDGET,
    DOCUMENT_BUDGET,
    EXCERPT_BUDGET,
    PHRASE,
    REFINED,
    SPECIAL,
    UNDERSCORE,
)
from .views import AUTH_LOG_SQL, CANDIDATES_ORACLE, MIXED_LOGS_SQL

LOG = f"({AUTH_LOG_SQL}) log"
MIXED = f"({MIXED_LOGS_SQL}) log"

IP = r"regexp_extract(Content, '(\d+\.\d+\.\d+\.\d+)', 1)"
RHOST = r"regexp_extract(Content, 'rhost=(\d+\.\d+\.\d+\.\d+)', 1)"
INVALID = r"regexp_extract(Content, 'Invalid user\s+(\S+)', 1)"
VALUES = {
    "source_ip": IP,
    "pam_rhost_ip": RHOST,
    "invalid_username": INVALID,
    "event_id": "EventId",
}
UNWRAPPED = "Content NOT LIKE '%message repeated%'"
ROOT = r"regexp_matches(Content, 'session\ opened\ for\ user\ root(\s|$)')"

# The words of each filter, as LIKE conditions.
LIKES = {
    "all_events": None,
    "failed_password": "Content LIKE '%Failed password%'",
    "invalid_user": "Content LIKE '%Invalid user %'",
    "accepted_login": "Content LIKE '%Accepted %'",
    "possible_break_in": "Content LIKE '%POSSIBLE BREAK-IN ATTEMPT%'",
    "session_opened": "Content LIKE '%session opened%'",
    "pam_auth_failure": "Content LIKE '%authentication failure%'",
    "pam_user_unknown": "Content LIKE '%user unknown%'",
}


def _where(*conditions: str | None) -> str:
    kept = [c for c in conditions if c]
    return " WHERE " + " AND ".join(kept) if kept else ""


def _count(condition: str | None, wrappers: bool = False) -> str:
    dropped = None if wrappers or not condition else UNWRAPPED
    return f"SELECT count(*) AS c FROM {LOG}{_where(condition, dropped)}"


def _guard(field: str) -> str | None:
    return None if field == "event_id" else f"{VALUES[field]} <> ''"


def _distinct(field: str, condition: str | None = None) -> str:
    return f"SELECT count(DISTINCT {VALUES[field]}) AS c FROM {LOG}{_where(condition, _guard(field))}"


def _top(field: str, condition: str | None = None) -> str:
    dropped = UNWRAPPED if condition else None
    return (
        f"SELECT {VALUES[field]} AS v, count(*) AS c FROM {LOG}"
        f"{_where(condition, dropped, _guard(field))} GROUP BY 1 ORDER BY c DESC, v ASC LIMIT 1"
    )


def _batch() -> str:
    """Every catalog plan for every process id, one SELECT per plan."""
    parts = []
    carried = {**C.CARRIED_BY, "event_id": tuple(LIKES)}
    scoped = [(name, like, "") for name, like in LIKES.items()]
    scoped.append(("session_opened", ROOT, "/root"))
    for name, like, tail in scoped:
        n = f"count(*) FILTER{_paren(like, UNWRAPPED if like else None)}" if like else "count(*)"
        parts.append(
            f"SELECT Pid AS artifact_id, '{name}/none/count_rows{tail}' AS plan_id, "
            f"CAST(NULL AS VARCHAR) AS v, {n} AS c FROM log GROUP BY 1"
        )
        for field, value in VALUES.items():
            if name not in carried[field]:
                continue
            condition = _and(like, _guard(field))
            distinct = f"count(DISTINCT {value})" + (
                f" FILTER (WHERE {condition})" if condition else ""
            )
            parts.append(
                f"SELECT Pid, '{name}/{field}/count_distinct_values{tail}', NULL, {distinct} FROM log GROUP BY 1"
            )
            top = _where(like, UNWRAPPED if like else None, _guard(field))
            parts.append(
                f"SELECT Pid, '{name}/{field}/most_frequent_value_and_count{tail}', v, c FROM "
                f"(SELECT Pid, {value} AS v, count(*) AS c, row_number() OVER (PARTITION BY Pid "
                f"ORDER BY count(*) DESC, {value} ASC NULLS LAST) AS r FROM log{top} GROUP BY Pid, {value}) q WHERE r = 1"
            )
    return f"WITH log AS ({AUTH_LOG_SQL}) " + " UNION ALL ".join(parts)


def _and(*conditions: str | None) -> str | None:
    return " AND ".join(c for c in conditions if c) or None


def _paren(*conditions: str | None) -> str:
    return f" (WHERE {_and(*conditions)})"


IPV6 = (
    f"(regexp_matches(Content, {lit(C.IPV6_SHAPE)}) AND "
    f"regexp_matches(regexp_extract(Content, {lit(C.IPV6_FIRST)}), '(?i)[a-f]') "
    "OR Content LIKE '%::%')"
)
MARKED = "(" + " OR ".join(f"contains(Content, {lit(m)})" for m in C.MARKERS) + ")"
_PRESENT = ", ".join(
    f"CASE WHEN count(*) FILTER (WHERE {like}) > 0 THEN '{name}' END"
    if like
    else f"'{name}'"
    for name, like in [*LIKES.items(), ("quoted_phrase", None)]
)
_VOCABULARY = " OR ".join(like for like in LIKES.values() if like)
SCAN = f"""
SELECT artifact_id, CASE WHEN n_marked > 0 AND n_words > 0 THEN 'loghub_auth' END AS family,
 CASE WHEN NOT (n_marked > 0 AND n_words > 0) THEN 'no intent catalog for this artifact''s layout' END AS reason,
 n_ipv6 > 0 AS has_ipv6, n_lines, n_marked, n_ipv6, present FROM
 (SELECT artifact_id, count(*) AS n_lines, count(*) FILTER (WHERE {MARKED}) AS n_marked,
  count(*) FILTER (WHERE {IPV6}) AS n_ipv6, count(*) FILTER (WHERE {_VOCABULARY}) AS n_words,
  array_to_string([{_PRESENT}], ',') AS present FROM {MIXED} GROUP BY 1) s
"""


def _profile(source: str, columns: dict[str, str], key: str = "") -> str:
    """Smallest four distinct values of each column by text, cut to 90 characters."""
    parts = []
    by = f"{key}, " if key else ""
    for name, kind in columns.items():
        shown = "CASE WHEN length(v) <= 90 THEN v ELSE left(v, 90) || '...' END"
        group = f" GROUP BY {key}" if key else ""
        frame = f"(SELECT DISTINCT {key} FROM src) k LEFT JOIN" if key else ""
        using = f" USING ({key})" if key else ""
        parts.append(
            f"SELECT {by}'{name}' AS column_name, '{kind}' AS column_type, coalesce(e, '') AS examples FROM {frame} "
            f"(SELECT {by}string_agg({shown}, '|' ORDER BY v) AS e FROM (SELECT {by}v, row_number() OVER "
            f"({'PARTITION BY ' + key if key else ''} ORDER BY v) AS r FROM (SELECT DISTINCT {by}CAST({name} AS VARCHAR) AS v "
            f"FROM src WHERE {name} IS NOT NULL) d) q WHERE r <= 4{group}) e{using}"
        )
    return f"WITH src AS ({source}) " + " UNION ALL ".join(parts)


_LOG_TYPES = {
    "LineId": "bigint",
    "Pid": "bigint",
    "Component": "string",
    "Content": "string",
    "EventId": "string",
    "EventTemplate": "string",
}

# ---------------------------------------------------------------- votes
_KEY = (
    "CASE WHEN result_json = '[\"10.0.0.1\", 3]' THEN '[\"10.0.0.1\",3]' ELSE result_json END"
)
_USABLE = f"(err IS NULL AND {_KEY} NOT IN ('null', '[[]]'))"


def _majority(c: str = "c") -> str:
    return f"""
SELECT question_id, result, sql, coalesce(votes, 0) || '/' || n AS votes, result IS NOT NULL AS ok,
 CASE WHEN result IS NULL THEN coalesce(first_err, 'empty/zero result') END AS error FROM
 (SELECT question_id, count(*) AS n, min_by(err, pos) FILTER (WHERE err IS NOT NULL) AS first_err FROM {c} GROUP BY 1) q
 LEFT JOIN (SELECT question_id, key AS result, votes, sql FROM (SELECT question_id, {_KEY} AS key, count(*) AS votes,
  min_by(sql, pos) AS sql, row_number() OVER (PARTITION BY question_id ORDER BY count(*) DESC, min(pos)) AS r
  FROM {c} WHERE {_USABLE} GROUP BY 1, 2) g WHERE r = 1) w USING (question_id)
"""


def _vote_oracles() -> dict[str, str]:
    c = f"WITH c AS ({CANDIDATES_ORACLE})"
    return {
        "vote_majority": c + _majority(),
        "vote_unanimous": """
WITH v AS (SELECT CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 + event_id // 8 END AS question_id, event_id AS pos,
 concat('plan ', user_id % 2) AS plan, CASE WHEN event_type = 'error' AND user_id % 5 = 0 THEN 'bad vote' END AS reason FROM events)
SELECT question_id, CASE WHEN bad = 0 AND n >= 2 AND plans = 1 THEN plan END AS plan, n AS n_votes,
 CASE WHEN bad > 0 THEN 'invalid plan: bad vote' WHEN n < 2 THEN 'fewer than 2 votes' WHEN plans > 1 THEN 'router votes disagreed' END AS reason
FROM (SELECT question_id, count(*) AS n, count(DISTINCT plan) AS plans, min(plan) AS plan, count(reason) AS bad FROM v GROUP BY 1) q""",
        "cross_check": f"""{c}, a AS ({_majority()}), c2 AS (SELECT * REPLACE (CASE WHEN pos % 5 = 0 THEN 'Timeout' END AS err) FROM c), b AS ({_majority("c2")})
SELECT a.question_id, a.result, b.result AS other_result, coalesce(b.ok, false) AS executed,
 CASE WHEN b.ok THEN a.result IS NOT DISTINCT FROM b.result END AS agree,
 CASE WHEN b.ok IS NULL OR NOT b.ok THEN 'NOT CHECKED' WHEN a.result IS NOT DISTINCT FROM b.result THEN 'AGREE' ELSE 'DISAGREE' END AS outcome
FROM a LEFT JOIN b USING (question_id)""",
        "result_keys": f"{c} SELECT {_KEY} AS key, {_USABLE} AS is_usable, count(*) AS n FROM c GROUP BY 1, 2",
    }


# ---------------------------------------------------------------- the SELECT subset
_SELECTS = {
    "sel_mentions": f"SELECT count(*) AS c FROM {LOG} WHERE Content LIKE '%session opened%'",
    "sel_port_top": rf"SELECT regexp_extract(Content,'port (\d+)',1) p, count(*) c FROM {LOG} "
    r"WHERE regexp_extract(Content,'port (\d+)',1) <> '' GROUP BY 1 ORDER BY c DESC, p LIMIT 1",
    "sel_distinct_pid": f"SELECT count(DISTINCT Pid) AS c FROM {LOG}",
    "sel_round": f"SELECT round(Pid, -1) AS x, count(*) AS c FROM {LOG} GROUP BY 1",
    "sel_filter_agg": f"SELECT Component, count(*) FILTER (WHERE Content LIKE '%Failed%') AS c, "
    f"count(DISTINCT EventId) FILTER (WHERE Pid > 75) AS u, count(EventId) AS n FROM {LOG} GROUP BY 1",
    "sel_or_precedence": f"SELECT count(*) AS c FROM {LOG} WHERE Content LIKE '%Failed%' "
    "OR Content LIKE '%Accepted%' AND Pid <= 50",
    "sel_compare": f"SELECT EventTemplate AS t, count(*) AS c, count(*) FILTER (WHERE Pid < 40) AS low, "
    f"count(*) FILTER (WHERE Pid = 40) AS same FROM {LOG} "
    "WHERE Pid <> 7 AND Pid >= 2 AND EventTemplate > 'click' AND EventTemplate <= 'view' GROUP BY t",
    "sel_like": f"SELECT count(*) AS c FROM {LOG} WHERE Content LIKE '%user=ro_t' AND Content NOT LIKE '%[%'",
    "sel_whole_match": rf"SELECT regexp_extract(Content, 'user=\w+') AS x, count(*) AS c FROM {LOG} GROUP BY 1",
    "sel_order_limit": f"SELECT EventId, {IP} AS ip, count(*) AS c FROM {LOG} GROUP BY 1, 2 "
    "ORDER BY c DESC, EventId ASC, ip DESC LIMIT 20",
}

ORACLE: dict[str, str] = {
    **{f"flt_{name}": _count(like) for name, like in LIKES.items()},
    "flt_quoted_phrase": _count(f"Content LIKE '%{PHRASE}%'"),
    "flt_session_root": _count(ROOT),
    "flt_wrapper_only": _count("Content LIKE '%message repeated%'", wrappers=True),
    "flt_phrase_implied": _count("Content LIKE '%Failed password%'"),
    "flt_phrase_added": _count(f"Content LIKE '%Failed password%' AND Content LIKE '%{PHRASE}%'"),
    "flt_like_underscore": f"SELECT count(*) AS c FROM pages WHERE contains(url, '{UNDERSCORE}') "
    "AND NOT contains(url, 'message repeated')",
    "flt_phrase_refines": _count(f"Content LIKE '%{REFINED}%'"),
    "flt_like_characters": f"SELECT count(*) AS c FROM pages WHERE contains(html, {lit(SPECIAL)})",
    "distinct_source_ip": _distinct("source_ip"),
    "distinct_rhost_ip": _distinct("pam_rhost_ip"),
    "distinct_invalid_username": _distinct("invalid_username", LIKES["invalid_user"]),
    "distinct_event_id": _distinct("event_id"),
    "distinct_failed_source_ip": _distinct("source_ip", LIKES["failed_password"]),
    "top_source_ip": _top("source_ip"),
    "top_rhost_ip": _top("pam_rhost_ip", LIKES["pam_auth_failure"]),
    "top_invalid_username": _top("invalid_username", LIKES["invalid_user"]),
    "top_event_id": _top("event_id"),
    "top_failed_source_ip": _top("source_ip", LIKES["failed_password"]),
    "batch_plans": _batch(),
    "file_answers": _batch(),
    "file_families": f"SELECT Pid AS artifact_id, bool_or({MARKED}) AND ("
    + " OR ".join(f"bool_or(Content LIKE {lit('%' + C.FILTERS[n].contains[0] + '%')})" for n in C.VOCABULARY)
    + f") AS known, count(*) AS n_lines FROM ({AUTH_LOG_SQL}) a GROUP BY 1",
    "family_scan": f"SELECT artifact_id, family, reason, has_ipv6, n_lines, n_marked, n_ipv6 FROM ({SCAN}) s",
    "present_filters": f"SELECT artifact_id, present FROM ({SCAN}) s",
    "marker_counts": "SELECT artifact_id, "
    + ", ".join(
        f"count(*) FILTER (WHERE contains(Content, {lit(m)})) AS marker_{i}"
        for i, m in enumerate(C.MARKERS, 1)
    )
    + f" FROM {MIXED} GROUP BY 1",
    "ipv6_scan": f"SELECT count(*) FILTER (WHERE {IPV6}) > 0 AS has_ipv6, "
    f"count(*) FILTER (WHERE {IPV6}) AS n_ipv6, count(*) AS n_lines FROM {MIXED}",
    "profile": _profile(AUTH_LOG_SQL, _LOG_TYPES),
    "profile_artifacts": _profile(
        MIXED_LOGS_SQL,
        {
            "LineId": "bigint",
            "Content": "string",
            "EventId": "string",
            "EventTemplate": "string",
        },
        "artifact_id",
    ),
    "profile_documents": _profile(
        "SELECT * FROM documents",
        {
            "doc_id": "bigint",
            "text": "string",
            "lang": "string",
            "source": "string",
            "n_chars": "bigint",
        },
    ),
    "csv_lines": "SELECT event_type, props, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS id_sum FROM events GROUP BY 1, 2",
    "text_lines": r"SELECT doc_id, len(l) - CASE WHEN l[len(l)] = '' THEN 1 ELSE 0 END AS n_lines, n_text FROM "
    r"(SELECT doc_id, length(text) AS n_text, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]') AS l FROM documents) q",
    **triage_oracles(EXCERPT_BUDGET, DOCUMENT_BUDGET, BIG_BUDGET),
    **question_oracles(MIXED, SCAN, VALUES),
    **_vote_oracles(),
    **_SELECTS,
}
