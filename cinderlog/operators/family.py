"""Family detection: one scan answers header, markers, vocabulary and IPv6 for every artifact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions.predicates import contains_all, looks_ipv6, text_column
from ..functions.text import has_any

# Why an artifact or a plan gets no answer.
NO_FAMILY = "no intent catalog for this artifact's layout"
IPV6_REASON = (
    "the artifact carries IPv6 addresses, which the catalog's IPv4 extractors would miss"
)


def has_header(df: DataFrame) -> bool:
    """The required columns are among the log's columns; needs no job."""
    return set(C.REQUIRED_COLUMNS) <= set(df.columns)


def scan(logs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per artifact: family, the filters whose words occur, IPv6, marker and filter counts.

    Where logs have a column ``has_header``, as `read_logs` gives, it tells for each artifact whether
    its header fits; else the columns of the DataFrame tell for all.

    Nine marker tests, seven vocabulary tests and the IPv6 test are conditional counts of one
    aggregation. All buffers are plain numbers, so hash aggregation combines on the map side and
    a log of any size costs one row per task and artifact.
    """
    keys = ["artifact_id"] if keys is None else keys
    vocabulary = [
        F.count_if(contains_all(C.FILTERS[name].contains)).alias(f"n_{name}")
        for name in C.VOCABULARY
    ]
    fits = F.lit(has_header(logs))
    if "has_header" in logs.columns:
        fits = fits & F.col("has_header")
    counted = logs.groupBy(*keys).agg(
        F.count("*").alias("n_lines"),
        F.bool_and(fits).alias("header_fits"),
        F.count_if(has_any(text_column(), C.MARKERS)).alias("n_marked"),
        F.count_if(looks_ipv6()).alias("n_ipv6"),
        *vocabulary,
    )
    any_word = F.greatest(*[F.col(f"n_{name}") for name in C.VOCABULARY]) > 0
    known = F.col("header_fits") & (F.col("n_marked") > 0) & any_word
    family = F.when(known, F.lit(C.FAMILY))
    return counted.select(
        *keys,
        family.alias("family"),
        F.when(family.isNull(), F.lit(NO_FAMILY)).alias("reason"),
        present_filters().alias("present_filters"),
        (F.col("n_ipv6") > 0).alias("has_ipv6"),
        "n_lines",
        "n_marked",
        "n_ipv6",
        *[f"n_{name}" for name in C.VOCABULARY],
    )


def present_filters() -> Column:
    """Filters whose words were counted, and the two that need no words, in catalog order."""
    return F.array_compact(
        F.array(
            *[
                F.when(F.col(f"n_{name}") > 0, F.lit(name))
                if entry.contains
                else F.lit(name)
                for name, entry in C.FILTERS.items()
            ]
        )
    )


def marker_counts(logs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Lines per marker text, one column each."""
    keys = ["artifact_id"] if keys is None else keys
    return logs.groupBy(*keys).agg(
        *[
            F.count_if(text_column().contains(m)).alias(f"marker_{i}")
            for i, m in enumerate(C.MARKERS, 1)
        ]
    )


def restrict_plans(plans: DataFrame, scanned: DataFrame) -> DataFrame:
    """Decline plans an artifact cannot answer: unknown family, absent words, IPv6 addresses.

    ``plans`` has ``artifact_id, event_filter, extract_field``; the scan has one row per
    artifact. The join key is the artifact, so AQE may broadcast the scan or split a hot artifact.
    """
    facts = scanned.select("artifact_id", "family", "present_filters", "has_ipv6")
    joined = plans.join(facts, "artifact_id", "left")
    absent = ~F.array_contains("present_filters", F.col("event_filter"))
    blind = F.col("has_ipv6") & F.col("extract_field").isin("source_ip", "pam_rhost_ip")
    reason = (
        F.when(F.col("family").isNull(), F.lit(NO_FAMILY))
        .when(
            absent,
            F.concat(
                F.lit("the artifact contains no '"),
                F.col("event_filter"),
                F.lit("' lines"),
            ),
        )
        .when(blind, F.lit(IPV6_REASON))
    )
    return joined.select(*plans.columns, reason.alias("artifact_reason"))
