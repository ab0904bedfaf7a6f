"""Oracle SQL for triage, written for DuckDB: one row per match, then window ranks.

The patterns and texts are the library's fixed values; everything else is set out here afresh.
"""

from __future__ import annotations

from ..functions import rules as R
from .views import BIG_TOOL_SQL, TOOL_OUTPUT_SQL


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rx(pattern: str, flags: str = "", col: str = "text") -> str:
    full = f"(?{flags}){pattern}" if flags else pattern
    return f"regexp_matches({col}, {lit(full)})"


def got(pattern: str, flags: str = "", group: int = 0, col: str = "text") -> str:
    full = f"(?{flags}){pattern}" if flags else pattern
    return f"regexp_extract({col}, {lit(full)}, {group})"


def words(items, col: str = "lower(text)") -> str:
    return "(" + " OR ".join(f"contains({col}, {lit(w)})" for w in items) + ")"


CHILD = r"(?:^|[^Pa])Image[,:]\s*([^\n,;]+\.exe)"

_SIGNALS = {
    "img": f"trim({got(CHILD, 'i', 1)})",
    "par": f"trim({got(R.PARENT_IMAGE, 'i', 1)})",
    "host": "CASE "
    + " ".join(
        f"WHEN contains(lower(text), '{h}') THEN '{h}.exe'" for h in R.SCRIPT_HOSTS
    )
    + " END",
    "net": rx(R.NETWORK_SIGN),
    "rwx": rx("PAGE_EXECUTE_READWRITE|VadS"),
    "pname": f"lower(CASE WHEN {got(R.VAD_PROCESS, 'i', 1)} <> '' THEN {got(R.VAD_PROCESS, 'i', 1)} "
    f"WHEN {got(R.ANY_PROCESS, '', 1)} <> '' THEN {got(R.ANY_PROCESS, '', 1)} ELSE 'a process' END)",
    "jit": rx(r"clrjit\.dll|clr\.dll|\.NET", "i"),
    "prologue": rx(R.PROLOGUE, "is"),
    "mz": rx(R.PE_HEADER, "im"),
    "tramp": rx(R.TRAMPOLINE, "i"),
    "c2": got(R.C2_TEXT, "i"),
    "moved": f"{rx(chr(92) + 'b4648' + chr(92) + 'b')} AND {rx(R.REMOTE_LOGON, 's')} AND {rx('NTLM|NtLmSsp', 'i')}",
    "n4625": r"len(regexp_extract_all(text, '\b4625\b'))",
    "one_wrong": r"regexp_matches(text, '\b4624\b') AND regexp_matches(text, 'Type\s*2') "
    "AND regexp_matches(text, '(?i)0xC000006A') "
    r"AND len(regexp_extract_all(text, '\b4625\b')) = 1",
    "task": r"regexp_matches(text, '\b(4698|106)\b')",
    "tname": f"trim({got(R.TASK_NAME, '', 1)})",
    "updater": r"regexp_matches(text, 'GoogleUpdate|\\Microsoft\\Windows\\') "
    "AND regexp_matches(text, 'Program Files') AND regexp_matches(text, '(?i)SYSTEM')",
    "caps": f"list_sort(list_distinct(list_transform(regexp_extract_all(text, {lit('(?i)' + R.CAPABILITY)}), lambda c: lower(c))))",
    "capa": rx(r"\bcapa\b|ATT&CK|MBC|capability", "i"),
}

_ODD = "(mz OR tramp OR c2 <> '' OR contains(pname, 'lsass'))"
_PAIR = "(img <> '' AND par <> '')"
_OFFICE = f"({_PAIR} AND {words(R.OFFICE_APPS, 'lower(par)')} AND {words(R.SCRIPT_HOSTS, 'lower(img)')})"
_SHELL = words(R.SHELLS, "lower(img)")


def _once() -> list[tuple[str, int, int, str, str]]:
    """(rule, detector, emit order, condition, evidence)."""
    e = {k: lit(v) for k, v in R.EVIDENCE.items()}
    pair = "par || ' -> ' || img"
    rules = [
        ("T01", 0, 0, _OFFICE, pair),
        (
            "T02",
            0,
            0,
            f"{_PAIR} AND NOT {_OFFICE} AND contains(lower(par), 'services.exe') AND {_SHELL}",
            pair,
        ),
        (
            "T03",
            0,
            0,
            f"{_PAIR} AND NOT {_OFFICE} AND NOT contains(lower(par), 'services.exe') "
            f"AND {words(R.WEB_WORKERS, 'lower(par)')} AND {_SHELL}",
            pair,
        ),
    ]
    for i, office in enumerate(R.OFFICE_APPS, 1):
        rules.append(
            (
                "T01",
                0,
                i,
                f"NOT {_PAIR} AND {rx(office, 'i')} AND host IS NOT NULL",
                f"'{office}.exe -> ' || host",
            )
        )
    rules += [
        (
            "T02",
            0,
            9,
            f"{rx(r'services\.exe', 'i')} AND {rx(r'(powershell|cmd)\.exe', 'i')} AND {rx('pstree|PPID', 'i')}",
            e["T02"],
        ),
        (
            "T04",
            1,
            0,
            rx(R.HIDDEN_POWERSHELL, "i"),
            f"CASE WHEN {got(R.ENCODED_BLOB, 'i')} <> '' THEN left({got(R.ENCODED_BLOB, 'i')}, 60) ELSE {e['T04']} END",
        ),
        ("T05", 2, 0, f"{rx(r'\bcertutil\b', 'i')} AND net", e["T05"]),
        ("T06", 2, 1, f"{rx(r'\bwscript\b', 'i')} AND {rx(r'\.vbs|\.js\b|Temp', 'i')}", e["T06"]),
        ("T07", 2, 2, f"{rx(r'\bcscript\b', 'i')} AND {rx(r'\.vbs|\.js\b|Temp', 'i')}", e["T07"]),
        ("T08", 3, 0, "rwx AND contains(pname, 'lsass')", f"pname || {e['T08']}"),
        ("T09", 3, 1, "rwx AND mz", e["T09"]),
        ("T10", 3, 2, "rwx AND tramp AND NOT prologue", e["T10"]),
        ("T11", 3, 3, "rwx AND c2 <> ''", "c2"),
        (
            "T12",
            3,
            4,
            f"rwx AND (jit OR prologue) AND NOT {_ODD}",
            f"CASE WHEN jit THEN {e['T12 jit']} ELSE {e['T12 prologue']} END",
        ),
        ("T15", 5, 0, "moved", e["T15"]),
        ("T16", 5, 1, "NOT (moved) AND one_wrong", e["T16"]),
        (
            "T17",
            5,
            2,
            "NOT (moved) AND NOT (one_wrong) AND n4625 >= 3",
            "len(regexp_extract_all(text, '4625')) || 'x 4625'",
        ),
        ("T18", 5, 3, rx(r"\b7045\b"), e["T18"]),
        ("T19", 5, 4, "task AND updater", f"CASE WHEN tname <> '' THEN tname ELSE {e['T19']} END"),
        ("T20", 5, 5, "task AND NOT (updater)", f"CASE WHEN tname <> '' THEN tname ELSE {e['T20']} END"),
        ("T22", 7, 0, f"{rx(r'\b1102\b')} AND {rx(R.LOG_CLEARED, 'i')}", e["T22"]),
        ("T23", 7, 1, rx(r"\b4720\b"), e["T23"]),
        ("T24", 7, 2, f"{rx(r'\b(4732|4728)\b')} AND {rx('admin', 'i')}", e["T24"]),
        (
            "T25",
            8,
            0,
            f"({rx(r'\b4104\b')} OR {rx('ScriptBlock', 'i')}) AND "
            + rx(
                r"DownloadString|DownloadFile|IEX|Invoke-Expression|FromBase64String|-enc\b|Net\.WebClient|Reflection\.Assembly|hidden",
                "i",
            ),
            e["T25"],
        ),
        ("T26", 9, 0, f"{rx(r'\b4769\b')} AND {rx('0x17|RC4', 'i')}", e["T26"]),
        (
            "T27",
            10,
            0,
            rx(r"\\Run\b|\\RunOnce\b|CurrentVersion\\Run", "i")
            + " AND "
            + rx(r"powershell|rundll32|mshta|\\Temp\\|\\AppData\\|-enc|http", "i"),
            e["T27"],
        ),
        (
            "T28",
            10,
            1,
            rx("ImagePath", "i") + " AND " + rx(r"\\Temp\\|\\AppData\\|powershell|rundll32|cmd /c", "i"),
            e["T28"],
        ),
        (
            "T30",
            12,
            0,
            f"{rx('psxview|psscan', 'i')} AND {rx(r'\bFalse\b')} AND {rx('pslist', 'i')}",
            e["T30"],
        ),
        ("T31", 13, 0, "capa AND len(caps) > 0", "left(array_to_string(caps, ', '), 90)"),
    ]
    return rules


def _severity(rule: str) -> str:
    if rule != "T31":
        return lit(R.REPORTS[rule].severity)
    joined = "array_to_string(caps, ', ')"
    return f"CASE WHEN {words(R.CAPABILITY_MALICIOUS, joined)} THEN 'malicious' ELSE 'suspicious' END"


def triage_ctes(source: str) -> str:
    """``src`` and ``final``: the numbered findings of every artifact."""
    signals = ", ".join(f"{sql} AS {name}" for name, sql in _SIGNALS.items())
    found = [
        f"SELECT artifact_id, '{rule}' AS rule_id, {_severity(rule)} AS severity, {det} AS det, {emit} AS emit, "
        f"{lit(R.REPORTS[rule].indicator)} AS indicator, {evidence} AS evidence, '' AS proc FROM sig WHERE {condition}"
        for rule, det, emit, condition, evidence in _once()
    ]
    nets = " OR ".join(f"starts_with(ip, {lit(n)})" for n in R.VENDOR_NETS)
    bins = ", ".join(lit(b) for b in R.LOLBINS)
    vendor, lolbin = R.REPORTS["T13"], R.REPORTS["T14"]
    found.append(
        f"SELECT artifact_id, CASE WHEN {nets} THEN 'T13' ELSE 'T14' END, "
        f"CASE WHEN {nets} THEN {lit(vendor.severity)} ELSE {lit(lolbin.severity)} END, 4, i, "
        f"CASE WHEN {nets} THEN {lit(vendor.indicator)} ELSE replace({lit(lolbin.indicator)}, '{{proc}}', proc) END, "
        "proc || ' -> ' || ip || ':' || port, proc FROM sockets "
        f"WHERE {nets} OR lower(split_part(proc, '.', 1)) IN ({bins})"
    )
    for rule, det, evidence, table in (
        ("T21", 6, f"{got(R.WEB_SCRIPT, 'i', 1, 'm')} || ' in ' || {got(R.WEB_SCRIPT, 'i', 2, 'm')}", "scripts"),
        ("T29", 11, "left(m, 80)", "staged"),
    ):
        report = R.REPORTS[rule]
        found.append(
            f"SELECT artifact_id, '{rule}', {lit(report.severity)}, {det}, i, {lit(report.indicator)}, {evidence}, '' FROM {table}"
        )
    texts = ", ".join(
        f"('{rule}', {lit(r.why)}, {lit(r.next)})" for rule, r in R.REPORTS.items()
    )

    def listed(name: str, pattern: str) -> str:
        every = f"regexp_extract_all(text, {lit(pattern)})"
        return (
            f"{name} AS (SELECT artifact_id, i, l[i] AS m FROM (SELECT artifact_id, l, "
            f"unnest(range(1, len(l) + 1)) AS i FROM (SELECT artifact_id, {every} AS l FROM src) q) r)"
        )

    return f"""WITH src AS ({source}),
sig AS (SELECT artifact_id, text, {signals} FROM src),
{listed("hits", R.SOCKET)},
sockets AS (SELECT artifact_id, i, {got(R.SOCKET, "", 1, "m")} AS ip, {got(R.SOCKET, "", 2, "m")} AS port,
 {got(R.SOCKET, "", 4, "m")} AS proc FROM hits),
{listed("scripts", "(?i)" + R.WEB_SCRIPT)},
{listed("staged", "(?i)" + R.STAGED_FILE)},
found AS ({" UNION ALL ".join(found)}),
texts(rule_id, why, next) AS (VALUES {texts}),
once AS (SELECT *, row_number() OVER (PARTITION BY artifact_id, indicator, evidence ORDER BY det, emit) AS rep FROM found),
final AS (SELECT artifact_id, row_number() OVER (PARTITION BY artifact_id ORDER BY
  CASE severity WHEN 'malicious' THEN 0 WHEN 'suspicious' THEN 1 WHEN 'benign-signal' THEN 2 ELSE 3 END, det, emit) AS finding_no,
 rule_id, severity, indicator, evidence, replace(why, '{{proc}}', proc) AS why, next
 FROM once JOIN texts USING (rule_id) WHERE rep = 1),
verdicts AS (SELECT src.artifact_id, CASE min(CASE severity WHEN 'malicious' THEN 0 WHEN 'suspicious' THEN 1 WHEN 'benign-signal' THEN 2 END)
  WHEN 0 THEN 'malicious' WHEN 1 THEN 'suspicious' WHEN 2 THEN 'benign' ELSE 'undetermined' END AS verdict,
 count(finding_no) AS n_findings FROM src LEFT JOIN final USING (artifact_id) GROUP BY 1)
"""


_PRIORITY = (
    "SELECT v.artifact_id, verdict, n_findings, rule_id AS priority_rule, "
    "indicator AS priority_indicator, evidence AS priority_evidence"
)
_TOP = "FROM verdicts v LEFT JOIN final f ON f.artifact_id = v.artifact_id AND finding_no = 1"
_STEPS = (
    "coalesce((SELECT string_agg(next, '|' ORDER BY finding_no) FROM final n "
    "WHERE n.artifact_id = v.artifact_id AND finding_no <= 3), '') AS next_steps"
)
_COLUMNS = "artifact_id, finding_no, rule_id, severity, indicator, evidence, why, next"

# Report and block texts.
_REPORT = """
SELECT v.artifact_id, CASE WHEN n_findings = 0 THEN 'VERDICT: UNDETERMINED — no known indicators matched.' || chr(10) ||
  'Manual review of the raw output is required (no rule fired).'
 ELSE 'VERDICT: ' || upper(verdict) || chr(10) || 'PRIORITY: [' || t.severity || '] ' || t.indicator || chr(10) ||
  '   why: ' || t.why || chr(10) || 'FINDINGS:' || chr(10) || body || chr(10) || 'SUGGESTED NEXT COMMANDS:' || chr(10) || steps END AS report
FROM verdicts v LEFT JOIN final t ON t.artifact_id = v.artifact_id AND t.finding_no = 1
LEFT JOIN (SELECT artifact_id,
  string_agg('  - [' || severity || '] ' || indicator || '  (evidence: ' || evidence || ')', chr(10) ORDER BY finding_no) AS body,
  string_agg('  - ' || next, chr(10) ORDER BY finding_no) FILTER (WHERE finding_no <= 3) AS steps
  FROM final GROUP BY 1) b ON b.artifact_id = v.artifact_id
"""
BLOCKS = """
blocks AS (SELECT v.artifact_id, CASE WHEN n_findings = 0
  THEN 'PRE-EXTRACTION: no known indicators matched. Reason from the raw output directly.'
  ELSE 'PRE-EXTRACTED FINDINGS (deterministic indicator scan; highest severity first):' || chr(10) || body END AS block
FROM verdicts v LEFT JOIN (SELECT artifact_id, string_agg(finding_no || '. [' || upper(severity) || '] ' || indicator || chr(10) ||
  '   evidence: ' || evidence || chr(10) || '   why: ' || why || chr(10) || '   suggested next: ' || next, chr(10) ORDER BY finding_no) AS body
  FROM final GROUP BY 1) b USING (artifact_id))
"""

DOCUMENTS = "SELECT doc_id AS artifact_id, text FROM documents"


def excerpt_sql(source: str, budget: int, frame: int = 160) -> str:
    """Greedy fill by a recursive walk over the lines in priority order."""
    limit = (budget - frame) // 2
    breaks = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"
    return (
        triage_ctes(source).replace("WITH src", "WITH RECURSIVE src", 1)
        + ","
        + BLOCKS
        + f""",
block_lines AS (SELECT artifact_id, block, i, l[i] AS line, len(l) AS n FROM (SELECT artifact_id, block, l, unnest(range(1, len(l) + 1)) AS i
 FROM (SELECT artifact_id, block, regexp_split_to_array(block, '{breaks}') AS l FROM blocks) a) b),
run AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY artifact_id ORDER BY i) AS used FROM block_lines),
fitted AS (SELECT artifact_id, CASE WHEN length(any_value(block)) <= {limit} THEN any_value(block)
 ELSE coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE used <= {limit}), '') || chr(10) || '... (' ||
  (any_value(n) - count(*) FILTER (WHERE used <= {limit})) || ' more finding lines omitted to fit the model''s context)' END AS block
 FROM run GROUP BY 1),
room AS (SELECT artifact_id, block, greatest(0, {budget} - {frame} - length(block)) AS room FROM fitted),
cut AS (SELECT artifact_id, CASE WHEN l[len(l)] = '' THEN l[:len(l) - 1] ELSE l END AS l
 FROM (SELECT artifact_id, regexp_split_to_array(text, '{breaks}') AS l FROM src) q),
lines AS (SELECT artifact_id, i, l[i] AS line, length(l[i]) + 1 AS cost FROM
 (SELECT artifact_id, l, unnest(range(1, len(l) + 1)) AS i FROM cut) q),
tokens AS (SELECT DISTINCT artifact_id, lower(t) AS t FROM (SELECT artifact_id,
 unnest(regexp_split_to_array(evidence, '[\\s,;:()\\[\\]"'']+')) AS t FROM final) q WHERE length(t) >= 4),
marked AS (SELECT l.*, EXISTS (SELECT 1 FROM tokens k WHERE k.artifact_id = l.artifact_id AND contains(lower(l.line), k.t)) AS hit FROM lines l),
ranked AS (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY hit DESC, i) AS rank FROM marked),
fill AS (SELECT artifact_id, room, 0::BIGINT AS rank, 0::BIGINT AS used, 0::BIGINT AS i, false AS taken FROM room
 UNION ALL SELECT f.artifact_id, f.room, r.rank, CASE WHEN f.used + r.cost <= f.room THEN f.used + r.cost ELSE f.used END, r.i,
  f.used + r.cost <= f.room FROM fill f JOIN ranked r ON r.artifact_id = f.artifact_id AND r.rank = f.rank + 1),
chosen AS (SELECT artifact_id, count(*) FILTER (WHERE taken) AS n_chosen, count(*) FILTER (WHERE rank > 0) AS n_lines,
 coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE taken), '') AS body FROM fill LEFT JOIN lines USING (artifact_id, i) GROUP BY 1)
SELECT artifact_id, n_lines, n_chosen, left(block || chr(10) || chr(10) || 'RAW TOOL OUTPUT' || CASE WHEN n_chosen < n_lines
 THEN ' (' || n_chosen || ' of ' || n_lines || ' lines shown; ' || (n_lines - n_chosen) || ' omitted to fit the model''s context)' ELSE '' END
 || ':' || chr(10) || body || chr(10) || chr(10) || 'Write a 2-4 sentence grounded summary.', {budget}) AS prompt
FROM chosen JOIN room USING (artifact_id)"""
    )


def triage_oracles(
    excerpt_budget: int, document_budget: int, big_budget: int
) -> dict[str, str]:
    small, big, docs = (
        triage_ctes(TOOL_OUTPUT_SQL),
        triage_ctes(BIG_TOOL_SQL),
        triage_ctes(DOCUMENTS),
    )
    return {
        "triage_findings": f"{small} SELECT {_COLUMNS} FROM final",
        "triage_verdicts": f"{small} {_PRIORITY}, {_STEPS} {_TOP}",
        "triage_report": small + _REPORT,
        "findings_block": f"{small}, {BLOCKS} SELECT artifact_id, block FROM blocks",
        "triage_rollup": f"{small} SELECT verdict, count(*) AS n_artifacts FROM verdicts GROUP BY 1",
        "indicator_rollup": f"{small} SELECT rule_id, severity, count(*) AS n_findings, "
        "count(DISTINCT artifact_id) AS n_artifacts FROM final GROUP BY 1, 2",
        "triage_documents": f"{docs} {_PRIORITY} {_TOP}",
        "big_findings": f"{big} SELECT {_COLUMNS.replace(' finding_no,', '')} FROM final",
        "big_verdicts": f"{big} {_PRIORITY} {_TOP}",
        "file_line_verdicts": f"{big} {_PRIORITY} {_TOP}",
        "file_text_verdicts": f"{big} {_PRIORITY} {_TOP}",
        "big_next_steps": f"{big} SELECT artifact_id, finding_no AS step_no, next FROM final WHERE finding_no <= 3",
        **{
            f"rule_{rule}": f"{small} SELECT artifact_id, severity, indicator, evidence FROM final WHERE rule_id = '{rule}'"
            for rule in R.REPORTS
        },
        "excerpt": excerpt_sql(TOOL_OUTPUT_SQL, excerpt_budget),
        "excerpt_documents": excerpt_sql(DOCUMENTS, document_budget),
        "big_excerpt": excerpt_sql(BIG_TOOL_SQL, big_budget),
    }
