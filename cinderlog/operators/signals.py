"""Signals: the elementary facts the triage rules are made of.

A signal is one expression over a text: a flag, a first match, a count, a bit set, or the list of
matches of a multi-match rule. Signals are computed per *piece* of an artifact. A whole text is
one piece; a large artifact is many pieces whose signals ``merge`` combines with ordinary partial
aggregation, so no artifact ever has to fit into one row.

A prepared piece has three columns: ``_text`` is what a pattern may look at, ``_low`` its folded
copy, ``_own`` the part in front that belongs to the piece alone. Text and own part differ only
where pieces overlap. A flag or a set is unaffected by seeing a match twice, counts read ``_own``,
and a first match must start in it.

Cost: a text without any indicator is the common case. A few cheap *leads* are projected first; a
signal is computed only where its lead holds. Behind a lead, literal ``contains`` tests on the
folded copy come before any regex.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.frames import settle
from ..functions.sql import NO_STRINGS, every, first, has, matches, quote, when
from ..functions.text import CI, CS, fold


def _low(*words: str) -> str:
    return has("_low", words)


def _number(*ids: str, col: str = "_text") -> str:
    """An event number standing as a word."""
    return (
        "("
        + " OR ".join(
            f"{has(col, [i])} AND {matches(col, rf'{CS}\b{i}\b')}" for i in ids
        )
        + ")"
    )


# Leads: a literal (or a digit shape) without which some signals cannot hold.
LEADS = {
    "digits": matches("_text", "[147][0-9][0-9]"),
    "script": _low("script"),
    "powershell": _low("powershell"),
    "host": _low("script", "powershell", "mshta", "cmd"),
    "certutil": _low("certutil"),
    "memory": has("_text", ["PAGE_EXECUTE_READWRITE", "VadS"]),
    "image": _low("image"),
    "services": _low("services.exe"),
    "backslash": _low("\\"),
    "pool": _low("psxview", "psscan"),
    "capability": _low("capa", "att&ck", "mbc"),
}

# A signal that contains its lead's literal: skipping it without the lead is always right.
IMPLIED = {
    "host_wscript": "script",
    "host_cscript": "script",
    "wscript": "script",
    "cscript": "script",
    "script_block": "script",
    "host_powershell": "powershell",
    "hidden_powershell": "powershell",
    "certutil": "certutil",
    "child_image": "image",
    "parent_image": "image",
    "image_path": "image",
    "services": "services",
    "run_key": "backslash",
    "rwx": "memory",
    "pool_scan": "pool",
    "capa": "capability",
    **dict.fromkeys(
        (
            "e4648",
            "e4624",
            "e7045",
            "task",
            "e1102",
            "e4720",
            "group_add",
            "e4104",
            "e4769",
            "remote_logon",
            "n4625",
            "n4625_text",
        ),
        "digits",
    ),
}

# A signal that matters only next to its lead: skipped where the piece is the whole text.
NEEDED = {
    **dict.fromkeys([f"office_{o}" for o in R.OFFICE_APPS], "host"),
    "shell_exe": "services",
    "process_tree": "services",
    "network_sign": "certutil",
    "script_or_temp": "script",
    "encoded_blob": "powershell",
    "image_path_value": "image",
    "run_value": "backslash",
    "is_false": "pool",
    "pslist": "pool",
    "capability_bits": "capability",
    "cradle": "digits script",
    **dict.fromkeys(
        (
            "jit",
            "prologue",
            "pe_header",
            "trampoline",
            "vad_process",
            "any_process",
            "c2_text",
        ),
        "memory",
    ),
    **dict.fromkeys(
        (
            "ntlm",
            "type2",
            "type3",
            "wrong_password",
            "vendor",
            "program_files",
            "system",
            "task_name",
            "log_cleared",
            "admin",
            "rc4",
        ),
        "digits",
    ),
}


def _guarded(name: str, expr: str, whole: bool, otherwise: str) -> str:
    lead = IMPLIED.get(name) or (NEEDED.get(name) if whole else None)
    if not lead:
        return expr
    return when(" OR ".join(f"l_{x}" for x in lead.split()), expr, otherwise)


def flags() -> dict[str, str]:
    return {
        **{f"office_{o}": _low(o) for o in R.OFFICE_APPS},
        **{f"host_{h}": _low(h) for h in R.SCRIPT_HOSTS},
        "services": _low("services.exe"),
        "shell_exe": _low(*[s + ".exe" for s in R.SHELLS]),
        "process_tree": _low("pstree", "ppid"),
        "hidden_powershell": _low("powershell")
        + " AND "
        + matches("_text", CI + R.HIDDEN_POWERSHELL),
        "certutil": _low("certutil") + " AND " + matches("_text", CI + r"\bcertutil\b"),
        "wscript": _low("wscript") + " AND " + matches("_text", CI + r"\bwscript\b"),
        "cscript": _low("cscript") + " AND " + matches("_text", CI + r"\bcscript\b"),
        # The address form ends in port 80 or 443; the other forms hold one of the words.
        "network_sign": has(
            "_text",
            ["ESTABLISHED", "http://", "-urlcache", "ForeignAddr", "80", "443"],
        )
        + " AND "
        + matches("_text", CS + R.NETWORK_SIGN),
        "script_or_temp": _low(".vbs", "temp")
        + " OR "
        + _low(".js")
        + " AND "
        + matches("_text", CI + r"\.js\b"),
        "rwx": has("_text", ["PAGE_EXECUTE_READWRITE", "VadS"]),
        "jit": _low(*R.JIT_WORDS),
        "prologue": _low("push")
        + " AND "
        + _low("mov")
        + " AND "
        + matches("_text", "(?idsU)" + R.PROLOGUE),
        "pe_header": _low("4d", "mz")
        + " AND "
        + matches("_text", "(?idmU)" + R.PE_HEADER),
        "trampoline": _low("e9")
        + " AND "
        + _low("90")
        + " AND "
        + matches("_text", CI + R.TRAMPOLINE),
        "e4648": _number("4648"),
        "e4624": _number("4624", col="_own"),
        "remote_logon": has("_own", ["4624"])
        + " AND "
        + has("_text", ["Type"])
        + " AND "
        + matches("_text", "(?dsU)" + R.REMOTE_LOGON),
        "ntlm": _low("ntlm"),
        "type2": has("_text", ["Type"]) + " AND " + matches("_text", CS + r"Type\s*2"),
        "type3": has("_text", ["Type"]) + " AND " + matches("_text", CS + r"Type\s*3"),
        "wrong_password": _low("0xc000006a"),
        "e7045": _number("7045"),
        "task": _number("4698", "106"),
        "vendor": has("_text", ["GoogleUpdate", "\\Microsoft\\Windows\\"]),
        "program_files": has("_text", ["Program Files"]),
        "system": _low("system"),
        "e1102": _number("1102"),
        "log_cleared": _low("clear") + " AND " + matches("_text", CI + R.LOG_CLEARED),
        "e4720": _number("4720"),
        "group_add": _number("4732", "4728"),
        "admin": _low("admin"),
        "e4104": _number("4104"),
        "script_block": _low("scriptblock"),
        "cradle": _low(*R.CRADLE_WORDS)
        + " OR "
        + _low("-enc")
        + " AND "
        + matches("_text", CI + r"-enc\b"),
        "e4769": _number("4769"),
        "rc4": _low("0x17", "rc4"),
        "run_key": _low("\\run") + " AND " + matches("_text", CI + R.RUN_KEY),
        "run_value": _low(*R.RUN_VALUE_WORDS),
        "image_path": _low("imagepath"),
        "image_path_value": _low(*R.IMAGE_PATH_WORDS),
        "pool_scan": _low("psxview", "psscan"),
        "is_false": has("_text", ["False"])
        + " AND "
        + matches("_text", CS + r"\bFalse\b"),
        "pslist": _low("pslist"),
        "capa": _low("att&ck", "mbc", "capability")
        + " OR "
        + _low("capa")
        + " AND "
        + matches("_text", CI + r"\bcapa\b"),
    }


def firsts(whole: bool = True) -> dict[str, str]:
    """First match of a pattern, '' when absent.

    A piece has only the match that starts in its own part; further on, the text may end inside
    one, and the piece that owns its start sees all of it.
    """

    def gated(gate: str, pattern: str, group: int) -> str:
        if not whole:
            gate += f" AND regexp_instr(_text, {quote(pattern)}) BETWEEN 1 AND length(_own)"
        return when(gate, first("_text", pattern, group), "''")

    exe = " AND " + _low(".exe")
    return {
        "child_image": gated(_low("image") + exe, CI + R.CHILD_IMAGE, 1),
        "parent_image": gated(_low("parentimage") + exe, CI + R.PARENT_IMAGE, 1),
        "encoded_blob": gated(_low("-e"), CI + R.ENCODED_BLOB, 0),
        "vad_process": gated(_low("vads") + exe, CI + R.VAD_PROCESS, 1),
        "any_process": gated(has("_text", [".exe"]), CS + R.ANY_PROCESS, 1),
        "c2_text": gated(_low(*R.C2_WORDS), CI + R.C2_TEXT, 0),
        "task_name": gated(has("_text", ["Task"]), CS + R.TASK_NAME, 1),
    }


def counts() -> dict[str, str]:
    def counted(pattern: str) -> str:
        n = f"cast(regexp_count(_own, {quote(pattern)}) AS long)"
        return when(has("_own", ["4625"]), n, "0L")

    return {"n4625": counted(CS + r"\b4625\b"), "n4625_text": counted("4625")}


def capability_bits() -> dict[str, str]:
    """One bit per capability phrase found."""
    bits = ", ".join(
        f"{quote(p)}, {1 << i}" for i, p in enumerate(R.CAPABILITY_PHRASES)
    )
    gate = _low(*dict.fromkeys(p.split(" ")[0] for p in R.CAPABILITY_PHRASES))
    found = when(gate, every("_low", R.CAPABILITY), NO_STRINGS)
    return {
        "capability_bits": f"aggregate({found}, 0, (acc, p) -> acc | map({bits})[p])"
    }


def scalars(whole: bool, alone: bool = False) -> dict[str, str]:
    """All scalar signals behind their leads.

    ``whole`` if a piece is a whole text, ``alone`` if it is all its own, as a line is.
    """
    empty = {
        **dict.fromkeys(flags(), "false"),
        **dict.fromkeys(firsts(), "''"),
        **dict.fromkeys(counts(), "0L"),
        **dict.fromkeys(capability_bits(), "0"),
    }
    exprs = {**flags(), **firsts(whole or alone), **counts(), **capability_bits()}
    return {n: _guarded(n, f"({e})", whole, empty[n]) for n, e in exprs.items()}


def multis() -> dict[str, str]:
    """Evidence of the rules that report once per match, in match order, without repeats.

    A match read again on its own splits into the same groups, so the text is scanned once.
    """
    socket, script = CS + R.SOCKET, CI + R.WEB_SCRIPT
    sockets = when(has("_text", ["ESTABLISHED"]), every("_text", socket), NO_STRINGS)
    scripts = when(
        f"{_low(*R.WEB_DIRS)} AND {_low(*R.WEB_SCRIPT_ENDS)}",
        every("_text", script),
        NO_STRINGS,
    )
    staged = when(
        f"l_backslash AND {_low(*R.STAGING_DIRS)}",
        every("_text", CI + R.STAGED_FILE),
        NO_STRINGS,
    )
    talks = (
        f"array_distinct(transform({sockets}, m -> concat("
        f"{first('m', socket, 4)}, ' -> ', {first('m', socket, 1)}, ':', "
        f"{first('m', socket, 2)})))"
    )
    vendor = " OR ".join(
        f"startswith(substring_index(e, ' -> ', -1), {quote(net)})"
        for net in R.VENDOR_NETS
    )
    lolbins = ", ".join(quote(b) for b in R.LOLBINS)
    return {
        "T13": f"filter({talks}, e -> {vendor})",
        "T14": f"filter({talks}, e -> NOT ({vendor}) "
        f"AND lower(substring_index(e, '.', 1)) IN ({lolbins}))",
        "T21": f"array_distinct(transform({scripts}, m -> concat("
        f"{first('m', script, 1)}, ' in ', {first('m', script, 2)})))",
        "T29": f"array_distinct(transform({staged}, m -> substring(m, 1, 80)))",
    }


def prepare(df: DataFrame, keys: list[str], own: str = "text") -> DataFrame:
    """Project the folded copy and the leads next to the text, for the signals to share."""
    text = F.coalesce(F.col("text"), F.lit(""))
    folded = df.select(
        *keys,
        text.alias("_text"),
        F.coalesce(F.col(own), F.lit("")).alias("_own"),
        fold(text).alias("_low"),
    )
    return folded.selectExpr("*", *signal_columns(LEADS, "l_"))


def signal_columns(exprs: dict[str, str], prefix: str) -> list[str]:
    return [f"{e} AS {prefix}{name}" for name, e in exprs.items()]


# ---------------------------------------------------------------- line by line
# Signals whose pattern can run over a line's end; a line shows all others.
CROSSING = (
    "child_image",
    "parent_image",
    "hidden_powershell",
    "encoded_blob",
    "network_sign",
    "vad_process",
    "prologue",
    "pe_header",
    "trampoline",
    "type2",
    "type3",
    "remote_logon",
    "task_name",
)
CROSSING_LISTS = ("T13", "T14")

PLAIN_START, MEMORY_START = 1, 2


def starters() -> dict[int, str]:
    """What a line must end in for a match to start in it and run on, by kind.

    Each is a beginning of a pattern that reaches the line's end. Those of the second kind matter
    only in an artifact that shows a memory region.
    """

    def ends(gate: str, pattern: str) -> str:
        return f"({gate} AND {matches('_text', pattern + chr(92) + 's*' + chr(92) + 'z')})"

    address = r"\d+\.\d+\.\d+\.\d+(\s+\d{1,5}(\s+ESTABLISHED(\s+\d+)?)?)?"
    plain = [
        ends(_low("image"), CI + r"Image[,:]"),
        ends(_low("-w"), CI + r"-w"),
        ends(_low("-e"), CI + r"-e(?:nc)?"),
        ends(has("_text", ["."]), CS + address),
        ends(has("_text", ["Type"]), CS + "Type"),
        ends(has("_text", ["Task"]), CS + r"Task(?:Name)?[,:]"),
    ]
    pushed = r"push(\s+(rbp|ebp).{0,40}(mov|mov\s+(ebp|rbp),)?)?"
    memory = [
        ends(_low(".exe"), CI + r"\.exe(\s+0x[0-9a-f]+){0,2}"),
        ends(_low("push"), CI + pushed),
        ends(_low("4d"), CI + r"\b4d"),
        ends(_low("e9"), CI + r"\be9\b(\s+[0-9a-f]{2}){0,5}"),
    ]
    return {PLAIN_START: " OR ".join(plain), MEMORY_START: " OR ".join(memory)}


FLAG_NAMES = tuple(flags())
FIRST_NAMES = tuple(firsts())
if len(FLAG_NAMES) > 62:
    raise AssertionError("flags must fit a long")


def flag_bit(name: str) -> int:
    return 1 << FLAG_NAMES.index(name)


#: Whether a packed row shows anything.
SHOWS = " OR ".join(
    [
        *(f"{n} <> 0" for n in ["mask", "start", *counts(), *capability_bits()]),
        "size(firsts) > 0",
        "size(lists) > 0",
    ]
)


def packed(
    prepared: DataFrame, keys: list[str], order: str, crossing: bool, alone: bool | None = None
) -> DataFrame:
    """A row of plain numbers and short arrays per piece or line that shows anything at all.

    ``keys..., at, mask, start, n4625, n4625_text, capability_bits, firsts, lists``. ``crossing``
    keeps only what a line cannot show; ``order`` places the row in the artifact; ``alone`` says
    that rows see nothing but their own, as lines do; if it is given, rows without a sign stay.
    """
    exprs = scalars(whole=False, alone=not crossing if alone is None else alone)
    wanted = [n for n in FLAG_NAMES if not crossing or n in CROSSING]
    mask = " | ".join(f"IF({exprs[n]}, {flag_bit(n)}L, 0L)" for n in wanted)
    named = [n for n in FIRST_NAMES if not crossing or n in CROSSING]
    values = ", ".join(f"struct('{n}' AS name, {exprs[n]} AS value)" for n in named)
    chosen = {k: v for k, v in multis().items() if not crossing or k in CROSSING_LISTS}
    listed = ", ".join(
        f"transform({e}, (e, i) -> struct('{k}' AS slot, i AS match_no, e AS evidence))"
        for k, e in chosen.items()
    )
    numbers = [*counts(), *capability_bits()]
    start = " | ".join(f"IF({c}, {bit}, 0)" for bit, c in starters().items())
    rows = prepared.selectExpr(
        *keys,
        f"{order} AS at",
        f"{mask} AS mask",
        f"{'0' if crossing else start} AS start",
        *(f"{'0' if crossing else exprs[n]} AS {n}" for n in numbers),
        f"filter(array({values}), f -> f.value <> '') AS firsts",
        f"concat({listed}) AS lists",
    )
    made = ["at", "mask", "start", *numbers, "firsts", "lists"]
    rows = settle(rows, *made)
    return rows.where(SHOWS) if alone is None else rows


def merged(rows: DataFrame, key: str) -> DataFrame:
    """The scalar signals of each artifact from its packed rows.

    Flags, counts and places are numbers in a hash aggregation. 'Logon, later Type 3' is true inside
    one row or across two of them.
    """
    logon, third = flag_bit("e4624"), flag_bit("type3")
    summed = rows.groupBy(key).agg(
        F.bit_or("mask").alias("mask"),
        F.sum(F.col("n4625").cast("long")).alias("s_n4625"),
        F.sum(F.col("n4625_text").cast("long")).alias("s_n4625_text"),
        F.bit_or("capability_bits").alias("s_capability_bits"),
        F.min(F.when(F.col("mask").bitwiseAND(logon) != 0, F.col("at"))).alias("logon_at"),
        F.max(F.when(F.col("mask").bitwiseAND(third) != 0, F.col("at"))).alias("third_at"),
    )
    earliest = (
        rows.selectExpr(key, "at", "inline(firsts)")
        .groupBy(key, "name")
        .agg(F.min(F.struct("at", "value")).getField("value").alias("value"))
        .groupBy(key)
        .agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("firsts"))
    )
    theirs = earliest.select(F.col(key).alias("_key"), "firsts")
    joined = summed.join(theirs, F.col(key).eqNullSafe(F.col("_key")), "left")
    flag = {n: f"mask & {flag_bit(n)}L <> 0" for n in FLAG_NAMES}
    flag["remote_logon"] += " OR coalesce(logon_at < third_at, false)"
    return joined.selectExpr(
        key,
        "s_n4625",
        "s_n4625_text",
        "s_capability_bits",
        *(f"({e}) AS s_{n}" for n, e in flag.items()),
        *(f"coalesce(firsts['{n}'], '') AS s_{n}" for n in FIRST_NAMES),
    )
