"""URL filters by host-suffix and path-prefix expressions.

Each distinct URL is expanded into the expressions a rule could name: host suffixes of as many
labels, and path prefixes of as many characters, as the rules have. Both sets come from the rules,
so nothing a rule could match is left out. Expressions meet the rules by an equi-join on a 32-bit
prefix of their digest, full digests confirm, and the longest rule wins; of equally long ones block
wins. A URL that no rule fits is allowed.

Defined results: null and URLs without ``://`` have empty host and path and no rule. Repeated URLs
are judged once and share the verdict. No rules at all allow everything; null and repeated rules
don't count. Extra columns pass through; ``host``, ``path``, ``rule`` and ``verdict`` are added
(replaced where they clash).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.llm.shared import aside, held

DEFAULT = "allow"
#: Rules that may be broadcast, of about 200 bytes each; more are joined by a shuffle.
MAX_BROADCAST = 100_000


def host(url: Column) -> Column:
    """What stands after the first ``://`` up to /, ?, # or the end, A-Z in lower case."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(found, upper, upper.lower()), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(suffix: Column, prefix: Column) -> Column:
    # A host holds no slash, so a line feed cannot be taken for part of either.
    return F.sha2(F.concat(suffix, F.lit("\n"), prefix), 256)


def judge(df: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """df with host, path, the rule that decides, and the verdict.

    rules: host, path, verdict (block or allow). A rule fits its host and all subdomains where the
    URL's path starts with the rule's.
    """
    rules = rules.where("host is not null and path is not null").select(
        F.concat("host", "path").alias("u_rule"),
        F.col("verdict").alias("u_verdict"),
        _digest(F.col("host"), F.col("path")).alias("u_full"),
        F.size(F.split("host", r"\.")).alias("u_labels"),
        F.length("path").alias("u_chars"),
    )
    rules = rules.withColumn("u_short", F.substring("u_full", 1, 8)).distinct()
    shapes = rules.select("u_labels", "u_chars").distinct()
    # As many rows as there are shapes of rules: a few numbers, whatever the number of rules.
    shape = shapes.agg(F.collect_set("u_labels"), F.collect_set("u_chars")).first()
    plain, (own,) = aside(df, url)
    u = F.col(own)
    out = plain.withColumns({"host": host(u), "path": path(u)})
    urls = out.select(F.col("host").alias("u_host"), F.col("path").alias("u_path")).distinct()
    urls = held(
        urls,
        u_n=F.size(F.split("u_host", r"\.")),
        u_labels=F.array(*map(F.lit, sorted(shape[0]))).cast("array<int>"),
        u_chars=F.array(*map(F.lit, sorted(shape[1]))).cast("array<int>"),
    )
    labels = F.filter("u_labels", lambda k: k <= F.col("u_n"))
    suffixes = F.transform(
        labels, lambda k: F.call_function("substring_index", "u_host", F.lit("."), -k)
    )
    prefixes = F.transform(
        F.filter("u_chars", lambda k: k <= F.length("u_path")),
        lambda k: F.substring(F.col("u_path"), F.lit(1), k),
    )
    spread = urls.select("u_host", "u_path", F.explode(suffixes).alias("u_suffix"), prefixes.alias("u_p"))
    spread = spread.select("u_host", "u_path", "u_suffix", F.explode("u_p").alias("u_prefix"))
    spread = held(spread, u_digest=_digest(F.col("u_suffix"), F.col("u_prefix")))
    spread = spread.where("u_host <> ''").withColumn("u_short", F.substring("u_digest", 1, 8))
    known = rules.select("u_short", "u_full", "u_rule", "u_verdict")
    known = F.broadcast(known) if rules.count() <= MAX_BROADCAST else known
    hits = spread.join(known, "u_short").where("u_digest = u_full")
    best = hits.groupBy("u_host", "u_path").agg(
        F.max(
            F.struct(F.length("u_rule").alias("n"), F.col("u_verdict"), F.col("u_rule"))
        ).alias("u_best")
    )
    out = out.join(
        best, (F.col("host") == F.col("u_host")) & (F.col("path") == F.col("u_path")), "left"
    )
    made = {
        "host": F.col("host"),
        "path": F.col("path"),
        "rule": F.col("u_best.u_rule"),
        "verdict": F.coalesce("u_best.u_verdict", F.lit(DEFAULT)),
    }
    old = [(n, c) for n, c in zip(plain.columns, df.columns, strict=True) if c not in made]
    return out.select(
        *(F.col(n).alias(c) for n, c in old), *(c.alias(n) for n, c in made.items())
    )
