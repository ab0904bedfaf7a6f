"""Line dedup by a log-template tree.

A line descends the tree by its token count, then by its leading tokens (a token with a digit is a
variable field, written ``<*>``), and ends in a leaf. In a leaf, templates are compared as a whole
and, for longer lines, with one of four stretches of tokens generalised to a variable field. A
template found in `min_docs` different texts recurs, one with at least `STRONG` literal tokens from
`STRONG_DOCS` on: its lines are dropped everywhere but in the text with the smallest doc_id, where
the first of them stays.

Defined results: null and empty texts have no lines to lose. Equal texts count as one document and
are treated alike, so copies of whole documents are still copies afterwards. Lines with fewer than
`MIN_TOKENS` tokens or without a letter outside variable fields are never dropped. Null doc_ids
come last; texts that tie for the smallest doc_id all keep their line. Extra columns pass through;
one that has the name of a result is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.llm.shared import WHITE, aside, held, stored

MIN_DOCS = 6
#: Templates with so many tokens besides variable fields are no chance: two texts are enough.
STRONG = 12
STRONG_DOCS = 2
MIN_TOKENS = 4
#: Leading tokens that lead to a leaf.
DEPTH = 3
#: Lines of at least this many tokens may differ in one of the STRETCHES after the leading ones.
LONG = 12
STRETCHES = 4
LAST = 2**63 - 1


def _marked(digest: Column, strong: Column) -> Column:
    """The digest with its last bit telling whether it is of a strong template."""
    return digest.bitwiseAND(F.lit(-2).cast("long")).bitwiseOR(strong.cast("long"))


def _enough(digest: str, min_docs: int) -> Column:
    """The number of texts from which a template recurs, or a leaf may hold one that does."""
    strong = F.col(digest).bitwiseAND(F.lit(1).cast("long")) == 1
    return F.when(strong, min(min_docs, STRONG_DOCS)).otherwise(min_docs)


def _parse(df: DataFrame, text: str, doc_id: str) -> DataFrame:
    """One narrow row per line that can be dropped: text digest, doc_id, place, leaf and keys."""
    t = F.col(f"`{text}`")
    odd = F.lit(False)
    for mark in ("  ", "\t", "\r", "\x0b", "\x0c"):
        odd = odd | F.contains("l_text", F.lit(mark))
    # Held: beside a generator these would be evaluated for every line.
    texts = held(
        df.select(t.alias("l_text"), F.col(f"`{doc_id}`").cast("long").alias("l_id")),
        l_h=F.xxhash64("l_text"),
        l_size=F.octet_length("l_text"),
        l_doc=F.coalesce("l_id", F.lit(LAST)),
        # Most texts need neither of these: told once for the whole text.
        l_odd=odd,
        l_digits=F.rlike("l_text", F.lit("[0-9]")),
        l_lines=F.split("l_text", "\n"),
    ).drop("l_text", "l_id")
    lines = texts.select(
        "l_h", "l_size", "l_doc", "l_odd", "l_digits", F.posexplode("l_lines").alias("l_no", "l_line")
    )
    line = F.col("l_line")
    even = F.trim(F.when(F.col("l_odd"), F.regexp_replace(line, WHITE, " ")).otherwise(line))
    masked = F.regexp_replace(even, "[^ ]*[0-9][^ ]*", "<*>")
    lines = held(lines, l_line=F.when(F.col("l_digits"), masked).otherwise(even))
    lines = held(
        lines.drop("l_odd", "l_digits"),
        l_n=F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1,
        l_lead=F.substring_index(line, " ", DEPTH),
    )
    lines = lines.where(
        (F.col("l_n") >= MIN_TOKENS) & (F.col("l_lead").rlike(r"\p{L}") | line.rlike(r"\p{L}"))
    )

    def fields(part: Column) -> Column:
        around = F.concat(F.lit(" "), F.replace(part, F.lit(" "), F.lit("  ")), F.lit(" "))
        bare = F.replace(around, F.lit(" <*> "), F.lit(""))
        return F.when(
            F.contains(part, F.lit("<*>")), (F.length(around) - F.length(bare)) / 5
        ).otherwise(0)

    def without(k: int) -> Column:
        """The line without stretch k of its later tokens."""
        start, end = (
            (F.lit(DEPTH) + F.floor((F.col("l_n") - DEPTH) * x / STRETCHES)).cast("int")
            for x in (k, k + 1)
        )
        before = F.call_function("substring_index", "l_line", F.lit(" "), start)
        after = F.call_function("substring_index", "l_line", F.lit(" "), end - F.col("l_n"))
        literal = F.col("l_n") - (end - start) - fields(before) - fields(after)
        return _marked(F.xxhash64(F.lit(k), "l_n", before, after), literal >= STRONG)

    wild = F.when(F.col("l_n") >= LONG, F.array(*(without(k) for k in range(STRETCHES))))
    return lines.select(
        "l_h",
        "l_size",
        "l_doc",
        "l_no",
        _marked(F.xxhash64("l_n", "l_lead"), F.col("l_n") >= STRONG).alias("l_leaf"),
        F.concat(
            F.array(_marked(F.xxhash64("l_line"), F.col("l_n") - fields(line) >= STRONG)),
            F.coalesce(wild, F.array().cast("array<bigint>")),
        ).alias("l_keys"),
    )


def _texts(df: DataFrame, key: str) -> DataFrame:
    """For each key the number of different texts, the smallest doc_id."""
    pairs = df.groupBy(key, "l_h", "l_size").agg(F.min("l_doc").alias("l_doc"))
    return pairs.groupBy(key).agg(F.count("*").alias("l_docs"), F.min("l_doc").alias("l_first"))


def recurring(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = MIN_DOCS
) -> DataFrame:
    """The lines to drop: l_h and l_size of the text, l_drop its line numbers from 0."""
    lines = stored(_parse(df, text, doc_id), "lines")
    # A leaf with fewer lines than that holds no recurring template.
    leaves = lines.groupBy("l_leaf").agg(F.count("*").alias("l_rows"))
    leaves = leaves.where(F.col("l_rows") >= _enough("l_leaf", min_docs)).select("l_leaf")
    keyed = lines.join(leaves, "l_leaf", "left_semi").select(
        "l_h", "l_size", "l_doc", "l_no", F.explode("l_keys").alias("l_key")
    )
    texts = _texts(keyed, "l_key").where(F.col("l_docs") >= _enough("l_key", min_docs))
    known = stored(texts, "templates")
    found = stored(keyed.join(known.select("l_key", "l_first"), "l_key"), "recurring")
    # In the text with the smallest doc_id the first line of the template stays.
    kept = (
        found.where(F.col("l_doc") == F.col("l_first"))
        .groupBy("l_key", "l_h", "l_size")
        .agg(F.min("l_no").alias("l_keep"))
    )
    dropped = found.join(kept, ["l_key", "l_h", "l_size"], "left").where(
        F.col("l_keep").isNull() | (F.col("l_no") != F.col("l_keep"))
    )
    return dropped.groupBy("l_h", "l_size").agg(
        F.sort_array(F.collect_set("l_no")).alias("l_drop")
    )


def drop_lines(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = MIN_DOCS
) -> DataFrame:
    """df with its text rewritten, and l_n_lines and l_drop, the numbers of the lines dropped."""
    plain, (text, doc_id) = aside(df, text, doc_id)
    drops = recurring(plain, text, doc_id, min_docs).withColumnsRenamed(
        {"l_h": "l_h2", "l_size": "l_size2"}
    )
    t = F.col(text)
    out = plain.join(
        drops,
        (F.xxhash64(t) == F.col("l_h2")) & (F.octet_length(t) == F.col("l_size2")),
        "left",
    ).drop("l_h2", "l_size2")
    lines = F.split(t, "\n")
    numbers = F.sequence(F.lit(0), F.size("l_lines") - 1)
    left = F.transform(F.array_except(numbers, "l_drop"), lambda i: F.get("l_lines", i))
    out = held(out, l_lines=F.when(F.col("l_drop").isNotNull(), lines))
    out = out.withColumn(
        "l_n_lines",
        F.when(t.isNull(), 0).otherwise(F.coalesce(F.nullif(F.size("l_lines"), F.lit(-1)), F.size(lines))).cast("long"),
    ).withColumn(text, F.when(F.col("l_drop").isNull(), t).otherwise(F.array_join(left, "\n")))
    made = ["l_n_lines", "l_drop"]
    old = [(n, c) for n, c in zip(plain.columns, df.columns, strict=True) if c not in made]
    return out.select(*(F.col(n).alias(c) for n, c in old), *made)


def clean(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", n_chars: str = "n_chars"
) -> DataFrame:
    """The documents without recurring lines, in the columns of df.

    A document that loses every line with a word goes; one that had none before stays.
    """
    plain, (t, d) = aside(df, text, doc_id)
    out = drop_lines(plain, t, d)
    out = out.where(F.col("l_drop").isNull() | F.col(t).rlike(r"[^ \t-\r]"))
    if n_chars in df.columns:
        count = plain.columns[df.columns.index(n_chars)]
        out = out.withColumn(count, F.length(t).cast(df.schema[n_chars].dataType))
    return out.select(*plain.columns).toDF(*df.columns)
