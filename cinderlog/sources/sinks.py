"""Writing results without ever touching the evidence."""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.triage import report_text


def _parts(path: str) -> list[str]:
    parsed = urlparse(path)
    return [p for p in (parsed.netloc + parsed.path).split("/") if p not in ("", ".")]


def guard_output(path: str, inputs: list[str]) -> None:
    """Refuse an output path equal to an input file or to a folder above it."""
    out = _parts(path)
    if ".." in out:
        raise ValueError(f"{path}: give an output path without '..'")
    for source in inputs:
        evidence = _parts(source)
        shared = min(len(out), len(evidence))
        if out[:shared] == evidence[:shared]:
            raise ValueError(f"{path} would write over the evidence in {source}")


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a result; the files a DataFrame reads can never be its target."""
    guard_output(path, df.inputFiles())
    df.write.mode("error").format(fmt).save(path)


def write_reports(triaged: DataFrame, path: str, fmt: str = "json") -> None:
    """One report per artifact."""
    keys = [
        c for c in triaged.columns if c not in ("text", "findings", "verdict")
    ]
    reports = triaged.select(
        *keys, "verdict", report_text(F.col("findings")).alias("report")
    )
    write_table(reports, path, fmt)
