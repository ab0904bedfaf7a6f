"""From signals to findings: the rule conditions, in report order.

Every expression here reads the ``s_`` columns of ``signals.py`` and, for the multi-match rules,
an array column of evidence strings.
"""

from __future__ import annotations

from ..functions import rules as R
from ..functions.sql import has, not_empty, quote, strip, when

FINDING_TYPE = (
    "struct<rule_id:string,severity:string,indicator:string,"
    "evidence:string,why:string,next:string>"
)
MULTI_RULES = ("T13", "T14", "T21", "T29")

# Order in which rules report. T01 and T02 have a second source that comes after the first.
SLOTS = (
    "T01",
    "T02",
    "T03",
    "T01 names",
    "T02 tree",
    *[f"T{i:02d}" for i in range(4, 32)],
    "T31 minor",
)


def slot_rule(slot: str) -> str:
    return slot[:3]


def severity_of(slot: str) -> str:
    return "suspicious" if slot == "T31 minor" else R.REPORTS[slot_rule(slot)].severity


def finding(slot: str, evidence: str) -> str:
    """The finding struct of a rule; ``{proc}`` is the evidence's process name."""
    report = R.REPORTS[slot_rule(slot)]

    def text(template: str) -> str:
        if "{proc}" not in template:
            return quote(template)
        proc = f"substring_index({evidence}, ' -> ', 1)"
        return f"concat({proc}, {quote(template.replace('{proc}', ''))})"

    return (
        f"named_struct('rule_id', {quote(slot_rule(slot))}, "
        f"'severity', {quote(severity_of(slot))}, 'indicator', {text(report.indicator)}, "
        f"'evidence', {evidence}, 'why', {text(report.why)}, 'next', {quote(report.next)})"
    )


# The Image / ParentImage pair, when both were found.
_PAIRED = "(s_child_image <> '' AND s_parent_image <> '')"


def scalar_rules() -> dict[str, tuple[str, str]]:
    """Slot -> (condition, evidence) for the rules that report at most once."""
    says = {k: quote(v) for k, v in R.EVIDENCE.items()}

    child, parent = "lower(s_child_image)", "lower(s_parent_image)"
    pair = f"concat({strip('s_parent_image')}, ' -> ', {strip('s_child_image')})"
    by_office = (
        f"({_PAIRED} AND {has(parent, R.OFFICE_APPS)} AND {has(child, R.SCRIPT_HOSTS)})"
    )
    of_services, shell = has(parent, ["services.exe"]), has(child, R.SHELLS)
    by_services = f"({_PAIRED} AND NOT {by_office} AND {of_services} AND {shell})"
    by_web = (
        f"({_PAIRED} AND NOT {by_office} AND NOT {of_services} "
        f"AND {has(parent, R.WEB_WORKERS)} AND {shell})"
    )

    process = (
        f"lower(coalesce({not_empty('s_vad_process')}, {not_empty('s_any_process')}, "
        "'a process'))"
    )
    lsass, c2 = has(process, ["lsass"]), "s_c2_text <> ''"
    odd = f"(s_pe_header OR s_trampoline OR {c2} OR {lsass})"

    # Logon events form one if / else-if chain.
    lateral = "(s_e4648 AND s_remote_logon AND s_ntlm)"
    mistyped = (
        f"(NOT {lateral} AND s_n4625 = 1 AND s_e4624 AND s_type2 AND s_wrong_password)"
    )
    brute = f"(NOT {lateral} AND NOT {mistyped} AND s_n4625 >= 3)"

    updater = "(s_vendor AND s_program_files AND s_system)"
    task_name = not_empty(strip("s_task_name"))

    phrases = ", ".join(
        when(f"s_capability_bits & {1 << i} <> 0", quote(p))
        for i, p in enumerate(R.CAPABILITY_PHRASES)
    )
    listed = f"array_join(array({phrases}), ', ')"
    capable = "(s_capa AND s_capability_bits <> 0)"
    severe = " | ".join(
        str(1 << i)
        for i, p in enumerate(R.CAPABILITY_PHRASES)
        if any(word in p for word in R.CAPABILITY_MALICIOUS)
    )
    severe = f"(s_capability_bits & ({severe}) <> 0)"

    return {
        "T01": (by_office, pair),
        "T02": (by_services, pair),
        "T03": (by_web, pair),
        "T02 tree": (
            "s_services AND s_shell_exe AND s_process_tree "
            f"AND NOT ({by_services} AND {pair} = {says['T02']})",
            says["T02"],
        ),
        "T04": (
            "s_hidden_powershell",
            f"coalesce({not_empty('substring(s_encoded_blob, 1, 60)')}, {says['T04']})",
        ),
        "T05": ("s_certutil AND s_network_sign", says["T05"]),
        "T06": ("s_wscript AND s_script_or_temp", says["T06"]),
        "T07": ("s_cscript AND s_script_or_temp", says["T07"]),
        "T08": (f"s_rwx AND {lsass}", f"concat({process}, {says['T08']})"),
        "T09": ("s_rwx AND s_pe_header", says["T09"]),
        "T10": ("s_rwx AND s_trampoline AND NOT s_prologue", says["T10"]),
        "T11": (f"s_rwx AND {c2}", "s_c2_text"),
        "T12": (
            f"s_rwx AND (s_jit OR s_prologue) AND NOT {odd}",
            when("s_jit", says["T12 jit"], says["T12 prologue"]),
        ),
        "T15": (lateral, says["T15"]),
        "T16": (mistyped, says["T16"]),
        "T17": (brute, f"concat(cast(s_n4625_text AS string), {says['T17']})"),
        "T18": ("s_e7045", says["T18"]),
        "T19": (f"s_task AND {updater}", f"coalesce({task_name}, {says['T19']})"),
        "T20": (f"s_task AND NOT {updater}", f"coalesce({task_name}, {says['T20']})"),
        "T22": ("s_e1102 AND s_log_cleared", says["T22"]),
        "T23": ("s_e4720", says["T23"]),
        "T24": ("s_group_add AND s_admin", says["T24"]),
        "T25": ("(s_e4104 OR s_script_block) AND s_cradle", says["T25"]),
        "T26": ("s_e4769 AND s_rc4", says["T26"]),
        "T27": ("s_run_key AND s_run_value", says["T27"]),
        "T28": ("s_image_path AND s_image_path_value", says["T28"]),
        "T30": ("s_pool_scan AND s_is_false AND s_pslist", says["T30"]),
        "T31": (f"{capable} AND {severe}", f"substring({listed}, 1, 90)"),
        "T31 minor": (f"{capable} AND NOT {severe}", f"substring({listed}, 1, 90)"),
    }


def office_names() -> str:
    """Fallback evidence of T01: each Office name present, with the first script host present."""
    host = ", ".join(when(f"s_host_{h}", quote(h + ".exe")) for h in R.SCRIPT_HOSTS)
    pairs = ", ".join(
        when(
            f"NOT {_PAIRED} AND s_office_{o}",
            f"concat({quote(o + '.exe -> ')}, coalesce({host}))",
        )
        for o in R.OFFICE_APPS
    )
    return f"array_compact(array({pairs}))"


def slot_findings(slot: str, evidence_lists: str = "m_") -> str:
    """Findings of one slot as an array expression."""
    if slot == "T01 names":
        return f"transform({office_names()}, e -> {finding(slot, 'e')})"
    if slot in MULTI_RULES:
        return f"transform({evidence_lists}{slot}, e -> {finding(slot, 'e')})"
    condition, evidence = scalar_rules()[slot]
    empty = f"cast(array() AS array<{FINDING_TYPE}>)"
    return when(condition, f"array({finding(slot, evidence)})", empty)


def findings_array() -> str:
    """All findings of an artifact, most severe first, in report order inside a severity.

    A rule's severity is fixed, so concatenating slots by severity *is* the stable sort; and a
    rule's evidence lists hold no repeats, so there is nothing left to de-duplicate.
    """
    rules = scalar_rules()
    parts: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            parts.append(f"array_compact(array({', '.join(run)}))")
            run.clear()

    for severity in R.SEVERITIES:
        for slot in SLOTS:
            if severity_of(slot) != severity:
                continue
            if slot in rules:
                condition, evidence = rules[slot]
                run.append(when(condition, finding(slot, evidence)))
            else:
                flush()
                parts.append(slot_findings(slot))
    flush()
    return f"concat({', '.join(parts)})"


def slot_rank(slot: str) -> str:
    slots = ", ".join(quote(s) for s in SLOTS)
    return f"cast(array_position(array({slots}), {slot}) AS int)"


def severity_rank(severity: str) -> str:
    ranks = " ".join(f"WHEN {quote(s)} THEN {i}" for i, s in enumerate(R.SEVERITIES))
    return f"CASE {severity} {ranks} ELSE 9 END"


def verdict_of(severity: str) -> str:
    """Verdict of a most-severe severity; NULL means no finding."""
    known = " ".join(
        f"WHEN {quote(s)} THEN {quote(v)}" for s, v in R.VERDICTS.items()
    )
    return (
        f"CASE WHEN {severity} IS NULL THEN {quote(R.NO_FINDING_VERDICT)} "
        f"ELSE CASE {severity} {known} ELSE {quote(R.OTHER_VERDICT)} END END"
    )
