"""Triage rules, one positive and one negative each, and the triage pipeline."""

import random

import pytest
from pyspark.sql import functions as F

from cinderlog.functions import rules as R
from cinderlog.operators import triage as T

OFFICE = "ParentImage: C:\\Office\\WINWORD.EXE\nImage: C:\\W\\wscript.exe"
MEM = "VadS PAGE_EXECUTE_READWRITE"

# rule, text that reports it, expected evidence, text that does not
CASES = [
    ("T01", "x Image: C:\\W\\wscript.exe\nParentImage: C:\\Office\\WINWORD.EXE", "C:\\Office\\WINWORD.EXE -> C:\\W\\wscript.exe", "Image: a.exe\nParentImage: WINWORD.EXE"),
    ("T01", "Excel then CMD here", "excel.exe -> cmd.exe", "excel alone"),
    ("T02", "pstree services.exe cmd.exe", "services.exe -> powershell.exe", "services.exe cmd.exe"),
    ("T02", "Image: c:\\cmd.exe\nParentImage: c:\\services.exe", "c:\\services.exe -> c:\\services.exe", "Image: calc.exe\nParentImage: services.exe"),
    ("T03", "Image: c:\\cmd.exe\nParentImage: c:\\w3wp.exe", None, "Image: c:\\x.exe\nParentImage: c:\\w3wp.exe"),
    ("T04", "POWERSHELL -nop -enc SQBFAFgAIAAoAE4AZQB3AC0A", "-enc SQBFAFgAIAAoAE4AZQB3AC0A", "powershell\n-nop"),
    ("T04", "powershell -w  hidden", "powershell -nop -w hidden -enc ...", "powershell -weird"),
    ("T05", "CertUtil x 1.2.3.4 443", "certutil.exe + outbound socket", "certutil established"),
    ("T05", "certutil ForeignAddr", "certutil.exe + outbound socket", "mycertutils ESTABLISHED"),
    ("T06", "wscript a template", "wscript ... .vbs/.js", "wscript a.json"),
    ("T07", "cscript.exe x.vbs", "cscript ... .vbs/.js", "xcscript x.vbs"),
    ("T08", "notepad.exe\nLSASS.exe 0x1f 0x2f VadS", "lsass.exe VadS PAGE_EXECUTE_READWRITE", "lsass.exe 0x1f 0x2f vads"),
    ("T09", f"{MEM}\nMZ header", "bytes begin 4D 5A", f"{MEM} MZ header"),
    ("T09", f"{MEM} 4d\n5a", "bytes begin 4D 5A", "4d 5a"),
    ("T10", f"{MEM} e9 01 02\n90 90", "e9 .. 90 90", f"{MEM} e9 90 90 push rbp\nmov rbp, rsp"),
    ("T11", f"{MEM} \\\\.\\pipe\\x", "\\\\.\\pipe", f"{MEM} \\.\\pipe"),
    ("T11", f"{MEM} Beacon", "Beacon", "Beacon"),
    ("T12", f"{MEM} clr.dll", "clrjit.dll loaded", f"{MEM} clr.dll cobalt"),
    ("T12", f"{MEM} push ebp {'x' * 20}\nmov ebp, esp", "valid managed prologue", f"{MEM} push ebp {'x' * 60} mov ebp, esp"),
    ("T13", "20.190.1.2 443 ESTABLISHED 7 svchost.exe", "svchost.exe -> 20.190.1.2:443", "20.190.1.2 443 established 7 svchost.exe"),
    ("T14", "9.9.9.9 443 ESTABLISHED 7 MSHTA.exe", "MSHTA.exe -> 9.9.9.9:443", "9.9.9.9 443 ESTABLISHED 7 chrome.exe"),
    ("T15", "4648 4624 x\nType 3 ntlm", "4648 + 4624 Type3 NTLM + 4672", "4648 Type 3 4624 ntlm"),
    ("T16", "4625 4624 Type 2 0xc000006a", "one 4625 Type2 0xC000006A then 4624 Type2", "4625 4625 4624 Type 2 0xc000006a"),
    ("T17", "4625 4625 4625 x4625", "4x 4625", "4625 4625 x4625"),
    ("T18", "EID 7045", "EID 7045", "EID 17045"),
    ("T19", "4698 Task: \\GoogleUpdate Program Files SYSTEM", "\\GoogleUpdate Program Files SYSTEM", "4698 Task: \\GoogleUpdate program files SYSTEM"),
    ("T20", "106 things", "EID 4698/106", "1060 things"),
    ("T20", "4698 TaskName:  \\Up dater \t, more", "\\Up dater", "469 TaskName: x"),
    ("T21", "Shell.ASPX in .\\inetpub", "Shell.ASPX in inetpub", "shell.aspx\ninetpub"),
    ("T22", "1102 the audit log was cleared", "EID 1102", "1102 the audit\nwas clear"),
    ("T23", "4720", "EID 4720", "47201"),
    ("T24", "4728 Admins", "EID 4732/4728 -> admin group", "4729 Admins"),
    ("T25", "scriptblock iex", "4104 w/ download/IEX/base64", "scriptblock"),
    ("T26", "4769 rc4", "4769 EncryptionType 0x17", "4768 rc4"),
    ("T27", "HKCU\\RunOnce = http://x", "...\\CurrentVersion\\Run -> script/temp/encoded", "HKCU\\Runner = http://x"),
    ("T28", "imagepath cmd /c x", "service ImagePath -> temp/script", "imagepath c:\\x.exe"),
    ("T29", "C:\\Users\\Public\\a.exe", "C:\\Users\\Public\\a.exe", "C:\\Users\\Public\\a.txt"),
    ("T30", "psscan pslist False", "psxview: pslist=False", "psscan pslist false"),
    ("T31", "capa: Ransom, persist", "persist, ransom", "ransom"),
    ("T31", "capability: persist", "persist", "capability: none"),
]


def triaged(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "artifact_id long, text string")
    return T.triage_texts(df)


def by_artifact(df):
    return {r.artifact_id: r for r in df.collect()}


@pytest.fixture(scope="module")
def results(spark):
    texts = [t for case in CASES for t in (case[1], case[3])]
    return by_artifact(triaged(spark, texts))


@pytest.mark.parametrize("i", range(len(CASES)))
def test_rule(results, i):
    rule, _, evidence, _ = CASES[i]
    hits = [f for f in results[2 * i].findings if f.rule_id == rule]
    assert hits, results[2 * i].findings
    if rule == "T02" and "ParentImage" in CASES[i][1]:
        # The child pattern also matches inside 'ParentImage', but 'Image' comes first here.
        assert hits[0].evidence == "c:\\services.exe -> c:\\cmd.exe"
    elif evidence is not None:
        assert evidence in [f.evidence for f in hits]
    report = R.REPORTS[rule]
    assert hits[0].next == report.next
    missed = [f for f in results[2 * i + 1].findings if f.rule_id == rule]
    assert not missed, missed


def test_quirks_are_kept(spark):
    got = by_artifact(
        triaged(
            spark,
            [
                OFFICE,  # ParentImage first: the child pattern finds the parent's own path
                "winword cmdline",  # 'cmd' inside another word
                "wscript attempt",  # 'Temp' inside another word
                "capability: persist",  # minor capability
                None,
            ],
        )
    )
    assert got[0].findings == [] and got[0].verdict == "undetermined"
    assert got[1].findings[0].evidence == "winword.exe -> cmd.exe"
    assert got[2].findings[0].rule_id == "T06"
    assert got[3].verdict == "suspicious"
    assert got[4].verdict == "undetermined"


def test_unicode_case(spark):
    text = "beacon".replace("b", "B") + f" {MEM} \u212aeylog capa WSCR\u0130PT t\u0065mp po\u017ft p\u017fxview p\u017flist False"
    got = by_artifact(triaged(spark, [text]))[0]
    assert {f.rule_id for f in got.findings} >= {"T11", "T30", "T31"}


def test_order_dedup_and_report(spark):
    text = "\n".join(
        [
            "C:\\Users\\Public\\a.exe",
            "20.190.1.2 443 ESTABLISHED 7 svchost.exe",
            "C:\\Users\\Public\\a.exe",
            "C:\\Users\\Public\\b.exe",
            "psscan pslist False",
            "7045",
        ]
    )
    df = triaged(spark, [text, "nothing"])
    got = by_artifact(df)
    assert [(f.rule_id, f.evidence[-5:]) for f in got[0].findings] == [
        ("T30", "False"),
        ("T18", " 7045"),
        ("T29", "a.exe"),
        ("T29", "b.exe"),
        ("T13", "2:443"),
    ]
    assert got[0].verdict == "malicious" and got[1].verdict == "undetermined"
    steps = {r.artifact_id: r.next_steps for r in T.priority(df).collect()}
    assert steps[0] == [f.next for f in got[0].findings[:3]] and steps[1] == []
    reports = {
        r.artifact_id: r.report
        for r in df.select("artifact_id", T.report_text(F.col("findings")).alias("report")).collect()
    }
    assert reports[0].startswith("VERDICT: MALICIOUS\nPRIORITY: [malicious] Process hidden")
    assert reports[0].count("\n  - [") == 5
    assert reports[1].startswith("VERDICT: UNDETERMINED — no known indicators matched.")
    blocks = {
        r.artifact_id: r.block
        for r in df.select("artifact_id", T.block_text(F.col("findings")).alias("block")).collect()
    }
    assert "\n5. [BENIGN-SIGNAL] Outbound to Microsoft/CDN space\n" in blocks[0]
    assert blocks[1].startswith("PRE-EXTRACTION: no known indicators")
    rolled = {r.verdict: r.n_artifacts for r in T.verdict_counts(df).collect()}
    assert rolled == {"malicious": 1, "undetermined": 1}
    kinds = {r.rule_id: (r.n_findings, r.n_artifacts) for r in T.indicator_counts(T.findings_table(df)).collect()}
    assert kinds["T29"] == (2, 1)


# Lines whose matches run over line ends, among others.
POOL = [
    "noise", "", "  ", "ESTABLISHED 7", "certutil.exe", "9.9.9.9 443", "9.9.9.9 443 ESTABLISHED",
    "20.190.1.2 443 ESTABLISHED 42 svchost.exe", "4d", "5a", "MZ", "e9", "01", "90", "90 90",
    "push", "rbp", "mov rbp,", "rsp", "4624", "Type", "3", "Type 3", "4648 NTLM", "4625", "x4625",
    "0xC000006A Type 2", "Image:", "a\\cmd.exe", "ParentImage:", "b\\w3wp.exe", "ParentImage: services.exe",
    "Image: powershell.exe", "lsass.exe", "0x1 0x2", "VadS", "q.exe PAGE_EXECUTE_READWRITE", "TaskName:", "\\Up",
    "4698", "-enc", "SQBFAFgAIAAoAE4AZQB3AC0A", "powershell -w", "hidden", "a.php wwwroot", "C:\\Temp\\a.exe",
    "C:\\Temp\\b.dll and \\Downloads\\c.js", "capa ransom", "capability persist", "excel", "psxview", "pslist",
    "False", "beacon", "clr.dll", "1102 log", "log clear", "106",
]


def _lines(spark, texts):
    rows = [(i, n, line) for i, t in enumerate(texts) for n, line in enumerate(t.split("\n"))]
    lines = spark.createDataFrame(rows, "artifact_id long, line_no long, line string")
    return lines.repartition(4, "line_no")


def _in_order(found):
    got = {}
    for r in found:
        got.setdefault(r.artifact_id, []).append((r.rule_id, r.severity, r.indicator, r.evidence))
    return got


def _same_in_pieces(spark, texts, sizes):
    whole = T.findings_table(triaged(spark, texts)).collect()
    want = _in_order(sorted(whole, key=lambda r: (r.artifact_id, r.finding_no)))
    lines = _lines(spark, texts)
    for size in sizes:
        found = T.piece_findings(lines, size, 64).orderBy("artifact_id", *T.REPORT_ORDER)
        assert _in_order(found.collect()) == want, size
    verdicts = {r.artifact_id: r for r in T.piece_verdicts(lines, sizes[0], 64).collect()}
    for r in T.priority(triaged(spark, texts)).collect():
        mine = verdicts[r.artifact_id]
        assert (mine.verdict, mine.n_findings, mine.priority_rule, mine.priority_evidence) == (
            r.verdict, r.n_findings, r.priority_rule, r.priority_evidence)
    return want


def test_pieces_equal_whole_texts(spark):
    rng = random.Random(7)
    texts = ["\n".join(rng.choices(POOL, k=rng.randint(1, 60))) for _ in range(150)]
    _same_in_pieces(spark, texts, (3, 8, 40))
    lines = _lines(spark, texts)
    steps = {}
    for r in T.piece_next_steps(T.piece_findings(lines, 40, 40)).orderBy("artifact_id", "step_no").collect():
        steps.setdefault(r.artifact_id, []).append(r.next)
    for r in T.priority(triaged(spark, texts)).collect():
        assert steps.get(r.artifact_id, []) == r.next_steps


def test_pieces_equal_long_texts_with_blank_runs(spark):
    rng = random.Random(11)

    def long_text():
        lines = []
        while len(lines) < 2000:
            lines += rng.choices(POOL, k=rng.randint(1, 12))
            lines += rng.choice([[], ["noise"] * rng.randint(1, 600), [""] * rng.randint(1, 1100)])
        return "\n".join(lines)

    _same_in_pieces(spark, [long_text() for _ in range(12)], (512, 100, 8))


def test_matches_at_the_edge_of_a_piece(spark):
    far = "\n".join(["x"] * 511 + ["Image:", *[""] * 80, "C:\\inetpub\\cmd.exe", "ParentImage: w3wp.exe"])
    cut = "\n".join(["EventID 4698 x", *["n"] * 574, "Task: ", "NightlyJob"])
    gap = "\n".join(["push", *[""] * 30, "mov rbp, rsp VadS PAGE_EXECUTE_READWRITE", *[""] * 900, "push", *[""] * 50, "mov rbp, rsp"])
    want = _same_in_pieces(spark, [far, cut, gap, "\n" * 1500, ""], (512, 7, 2, 1))
    assert any(r[0] == "T03" for r in want[0])
    assert [r[3] for r in want[1] if r[0] == "T20"] == ["NightlyJob"]


def test_pieces_are_bounded(spark):
    lines = spark.range(5000).selectExpr("1L AS artifact_id", "id AS line_no", "concat('l', id) AS line")
    cut = T.pieces(lines, 100, 20)
    sizes = cut.select("piece_no", F.size(F.split("text", "\n")).alias("n"), F.size(F.split("own", "\n")).alias("m")).collect()
    assert len(sizes) == 50 and max(r.n for r in sizes) == 120 and all(r.m == 100 for r in sizes)
    with pytest.raises(ValueError):
        T.pieces(lines, 0, 11)


def test_triage_needs_no_shuffle(spark):
    plan = triaged(spark, ["x"])._jdf.queryExecution().toString()
    assert "Exchange" not in plan[plan.index("== Physical Plan") :]
