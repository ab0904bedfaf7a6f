"""The excerpt against a plain loop, and its bounds."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cinderlog.operators import triage as T
from cinderlog.operators.excerpt import excerpts, piece_excerpts

MEMORY = (
    "Volatility 3 Framework 2.7.0\n"
    "PID\tProcess\tStart VPN\tEnd VPN\tTag\tProtection\n"
    "672\tlsass.exe\t0x1f0a0000\t0x1f0a1fff\tVadS\tPAGE_EXECUTE_READWRITE\n"
)


def texts_of(spark, texts):
    rows = list(enumerate(texts))
    return T.triage_texts(spark.createDataFrame(rows, "artifact_id long, text string"))


def plain(text, findings, block, budget):
    """The same selection as a loop over one text."""
    room = max(0, (budget - 160) // 2)
    if len(block) > room:
        kept, used, every = 0, 0, block.splitlines()
        while kept < len(every) and used + len(every[kept]) + 1 <= room:
            used += len(every[kept]) + 1
            kept += 1
        block = "\n".join(every[:kept]) + (
            f"\n... ({len(every) - kept} more finding lines omitted to fit the model's context)"
        )
    left = max(0, budget - 160 - len(block))
    lines = text.splitlines()
    words = {
        w.lower()
        for f in findings
        for w in re.split(r"[\s,;:()\[\]\"']+", f.evidence)
        if len(w) >= 4
    }
    hit = [any(w in line.lower() for w in words) for line in lines]
    order = sorted(range(len(lines)), key=lambda i: (not hit[i], i))
    chosen = []
    for i in order:
        if len(lines[i]) + 1 <= left:
            chosen.append(i)
            left -= len(lines[i]) + 1
    note = ""
    if len(chosen) < len(lines):
        note = f" ({len(chosen)} of {len(lines)} lines shown; {len(lines) - len(chosen)} omitted to fit the model's context)"
    body = "\n".join(lines[i] for i in sorted(chosen))
    prompt = f"{block}\n\nRAW TOOL OUTPUT{note}:\n{body}\n\nWrite a 2-4 sentence grounded summary."
    return len(lines), len(chosen), prompt[:budget]


@pytest.mark.parametrize("budget", [200, 700, 2500, 6000])
def test_equals_the_plain_loop(spark, budget):
    rng = random.Random(budget)
    pool = [*MEMORY.splitlines(), "C:\\Temp\\a.exe", "C:\\Temp\\bb.dll", "", "é" * 7, "x\x0by", "a\u2028b"]
    texts = ["", "\n", MEMORY, "no newline"]
    for _ in range(40):
        lines = [rng.choice(pool) if rng.random() < 0.3 else "z" * rng.randint(0, 90) for _ in range(rng.randint(1, 80))]
        texts.append("\n".join(lines))
    triaged = texts_of(spark, texts).withColumn("block", T.block_text(F.col("findings")))
    source = {r.artifact_id: r for r in triaged.collect()}
    for r in excerpts(triaged, budget).collect():
        s = source[r.artifact_id]
        assert (r.n_lines, r.n_chosen, r.prompt) == plain(s.text, s.findings, s.block, budget)


def test_bounds(spark):
    filler = "\n".join(f"filler line {i} " + "x" * 60 for i in range(3000))
    many = "\n".join(f"C:\\Users\\u\\AppData\\Local\\Temp\\dropper{i}.exe" for i in range(3000))
    triaged = texts_of(spark, [filler + "\n" + MEMORY, many])
    for budget in (800, 4000, 6000):
        got = {r.artifact_id: r.prompt for r in excerpts(triaged, budget).collect()}
        assert all(len(p) <= budget for p in got.values())
        assert "more finding lines omitted" in got[1] and "omitted to fit" in got[1]
    assert "lsass.exe\t0x1f0a0000" in got[0]
    assert "RWX executable memory inside lsass.exe" in got[0]


@pytest.mark.parametrize("budget", [300, 900, 3000])
def test_large_artifacts_equal_whole_texts(spark, budget):
    rng = random.Random(budget)
    pool = [*MEMORY.splitlines(), "C:\\Temp\\a.exe", "", "quiet", "9.9.9.9 443 ESTABLISHED 7 mshta.exe"]
    texts = ["quiet", MEMORY]
    for n in (30, 200, 900):
        lines = []
        for i in range(n):
            kind = rng.random()
            if kind < 0.3:
                lines.append(rng.choice(pool))
            elif kind < 0.5:
                lines.append(f"C:\\Users\\u\\Downloads\\drop{i}.exe")
            else:
                lines.append("z" * rng.randint(0, 60))
        texts.append("\n".join([*lines, "end"]))
    triaged = texts_of(spark, texts)
    want = {r.artifact_id: tuple(r) for r in excerpts(triaged, budget).collect()}
    rows = [(i, n, line) for i, t in enumerate(texts) for n, line in enumerate(t.splitlines())]
    lines = spark.createDataFrame(rows, "artifact_id long, line_no long, line string").repartition(4)
    found = T.piece_findings(lines, 64, 32)
    got = {r.artifact_id: tuple(r) for r in piece_excerpts(lines, found, budget).collect()}
    assert got == want
