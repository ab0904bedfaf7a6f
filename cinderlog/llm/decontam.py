"""Benchmark decontamination by template windows.

Numbers, names and units become typed placeholders that keep their value aside. Windows of
`WINDOW` template tokens of the benchmark are hash-joined with those of the documents, at every
place of both, so that what is met doesn't depend on where a passage stands. Where windows hold
placeholders, a value of the item stands for one value of the document, the one at most places of
the alignment; windows that show another don't count. So a question with other numbers and names is
caught, also where two values became the same. A window with fewer than `LITERALS` other tokens
counts where its values agree literally, or widened to either side until it holds so many.

What is met is counted per alignment, the distance of a document's place from the item's. Alignments
up to `GAP` apart, as words put in or left out make them, count together; phrases of an item that
stand scattered in a long document don't.

Defined results: null and empty texts have no windows and stay. A text of fewer than `WINDOW` tokens
is one window of its own tokens as they are, so a short item is met by a document that is nothing
but that item. Documents equal in doc_id and text are reported once and all go. An empty benchmark
takes nothing.
Extra columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.llm.shared import aside, held, stored

WINDOW = 5
#: Tokens of a window that must not be placeholders for its template to count.
LITERALS = 3
#: A window with fewer is widened to so many tokens at most.
WIDEST = 13
#: An item is met if so many tokens of it are, or half of them if that is less.
ENOUGH = 13
#: Words that may be put in or left out between two places of one alignment.
GAP = 4
#: Benchmark windows that may be broadcast, of about 100 bytes each; more are joined by a shuffle.
MAX_BROADCAST = 500_000

MARK = "\x01"
#: Stands for the separator inside a number.
POINT = "\x02"
#: A capitalised word that doesn't start a sentence.
NAME = r"(\p{Lu}(?<=[\p{Ll}\p{N}][,;]?[ \n]\p{Lu})\p{Ll}+)"
NUMBER = r"(\p{N}(?<![\p{L}\p{N}]\p{N})[\p{N}.,:/]*(?<=\p{N}))"
#: A number with what stands between it and its unit, and the unit.
UNIT = (
    "(" + MARK + r"n[\p{N}.,:/]+[ \x{A0}\n-]{1,3})(?:" + MARK + r"p)?(%|°[CF]|[€$£]|(?i:km/h|mph|[kcm]?m|[km]?g|m?l|kW|"
    r"dollars?|euros?|cents?|pounds?|miles?|inch(?:es)?|feet|foot|yards?|"
    r"(?:kilo|centi|milli)?met(?:er|re)s?|(?:milli)?lit(?:er|re)s?|(?:kilo|milli)?grams?|"
    r"seconds?|minutes?|hours?|days?|weeks?|months?|years?|percent)(?!\p{L}))"
)
#: A sign of money before a number.
MONEY = r"([€$£])(?= {0,3}" + MARK + "n)"


def _marked(text: Column) -> Column:
    """The text with MARK, its type and the value in place of each slot, in lower case."""
    text = F.when(text.rlike(f"[{MARK}{POINT}]"), F.translate(text, MARK + POINT, "  ")).otherwise(
        text
    )
    named = F.regexp_replace(text, NAME, f" {MARK}p$1 ")
    numbered = F.regexp_replace(named, NUMBER, f" {MARK}n$1 ")
    numbered = F.regexp_replace(numbered, UNIT, f"$1{MARK}u$2 ")
    numbered = F.regexp_replace(numbered, MONEY, f" {MARK}u$1 ")
    numbered = F.regexp_replace(numbered, r"(?<=\p{N})[.,:/](?=\p{N})", POINT)
    return F.lower(F.when(text.rlike(r"[\p{N}]"), numbered).otherwise(named))


def _tokens(df: DataFrame, text: str) -> DataFrame:
    """df with b_tokens in place of text, and b_has, whether one is a placeholder."""
    df = held(df, b_marked=_marked(F.col(text))).drop(text)
    parts = F.split("b_marked", f"[^\\p{{L}}\\p{{N}}{MARK}{POINT}%°€$£]+")
    return held(
        df,
        b_tokens=F.array_remove(parts, ""),
        b_has=F.contains("b_marked", F.lit(MARK)),
    ).drop("b_marked")


def _windows(df: DataFrame, places: bool = False) -> DataFrame:
    """df with b_tokens replaced by a row for each window: b_i, b_len, b_key and b_slots.

    b_slots has the values, null where there are none or where the key holds them; b_at, if asked
    for, their places.
    """
    raw = F.col("b_tokens")
    # A text without placeholders is its own template.
    df = held(
        df,
        b_plain=F.when(
            F.col("b_has"),
            F.transform(
                raw, lambda x: F.when(x.startswith(MARK), F.substring(x, 1, 2)).otherwise(x)
            ),
        ).otherwise(raw),
        b_marks=F.when(
            F.col("b_has"), F.transform(raw, lambda x: x.startswith(MARK).cast("int"))
        ),
    )
    none = F.lit(None).cast("array<string>")

    def row(i: Column, n: Column, key: Column, slots: Column) -> Column:
        at = F.filter(F.sequence(i, i + n - 1), lambda k: F.get(raw, k).startswith(MARK))
        return F.struct(
            i.cast("int").alias("b_i"),
            n.cast("int").alias("b_len"),
            key.alias("b_key"),
            slots.alias("b_slots"),
            *((F.when(slots.isNotNull(), at).alias("b_at"),) if places else ()),
        )

    def slots(i: Column, n: Column) -> Column:
        return F.filter(F.slice(raw, i + 1, n), lambda x: x.startswith(MARK))

    def wide(i: Column, n: Column) -> Column:
        return row(i, n, F.xxhash64(F.slice("b_plain", i + 1, n)), slots(i, n))

    def literals(i: Column, n: Column) -> Column:
        marks = F.slice("b_marks", i + 1, n)
        return n - F.aggregate(marks, F.lit(0), lambda x, y: x + y)

    def window(i: Column) -> Column:
        key = F.xxhash64(*(F.get("b_plain", i + k) for k in range(WINDOW)))
        n = F.lit(WINDOW)
        usual = F.array(row(i, n, key, F.when(F.col("b_has"), slots(i, n))))
        lengths = F.sequence(F.lit(WINDOW + 1), F.lit(WIDEST))
        after = F.filter(
            lengths, lambda m: (i + m <= F.size(raw)) & (literals(i, m) >= LITERALS)
        )
        before = F.filter(
            lengths, lambda m: (i + WINDOW >= m) & (literals(i + WINDOW - m, m) >= LITERALS)
        )
        # Nothing but the same values, or the nearest literals on either side.
        dense = F.concat(
            F.array(row(i, n, F.xxhash64(F.slice(raw, i + 1, n)), none)),
            F.transform(F.slice(after, 1, 1), lambda m: wide(i, m)),
            F.transform(F.slice(before, 1, 1), lambda m: wide(i + WINDOW - m, m)),
        )
        return F.when(F.col("b_has") & (literals(i, n) < LITERALS), dense).otherwise(usual)

    starts = F.when(F.size(raw) >= WINDOW, F.sequence(F.lit(0), F.size(raw) - WINDOW))
    bare = F.transform(raw, lambda x: F.when(x.startswith(MARK), F.substr(x, F.lit(3))).otherwise(x))
    short = F.array(row(F.lit(0), F.size(raw), F.xxhash64(F.lit(" "), bare), none))
    every = F.when(F.size(raw).between(1, WINDOW - 1), short).otherwise(
        F.flatten(F.transform(starts, window))
    )
    made = ("b_tokens", "b_plain", "b_marks", "b_has")
    kept = [c for c in df.columns if c not in made]
    return df.select(*(f"`{c}`" for c in kept), F.inline(every))


def leaks(
    df: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    item_text: str = "text",
    item_id: str = "item_id",
) -> DataFrame:
    """A row for each document and item it holds: b_doc, b_h, b_item, b_covered, b_n, b_slots_ok.

    b_h is a digest of the document's text, b_covered the number of the item's b_n tokens met.
    """
    it, t = F.col(f"`{item_text}`"), F.col(f"`{text}`")
    items = benchmark.select(
        F.col(f"`{item_id}`").alias("b_item"), F.xxhash64(it).alias("b_ih"), it.alias("b_text")
    ).distinct()
    items = _tokens(items, "b_text")
    items = items.withColumn("b_n", F.size("b_tokens"))
    wanted = stored(
        _windows(items, places=True).drop("b_len").withColumnsRenamed({"b_i": "b_j", "b_slots": "b_values"}),
        "items",
    )
    docs = df.select(F.col(f"`{doc_id}`").alias("b_doc"), F.xxhash64(t).alias("b_h"), t.alias("b_t"))
    seen = _windows(_tokens(docs, "b_t"))
    bounded = wanted.count() <= MAX_BROADCAST
    hits = seen.join(F.broadcast(wanted) if bounded else wanted, "b_key")
    align = ["b_doc", "b_h", "b_item", "b_ih", "b_off"]
    hits = stored(
        hits.select(
            "b_doc", "b_h", "b_item", "b_ih", "b_n", "b_j", "b_len", "b_slots", "b_values", "b_at",
            (F.col("b_i") - F.col("b_j")).alias("b_off"),
        ),
        "hits",
    )
    # What most places of an alignment say of an item's value, where they differ.
    pairs = hits.where(F.size("b_slots") > 0).select(
        *align, F.inline(F.arrays_zip("b_values", "b_slots", "b_at"))
    )
    votes = pairs.groupBy(*align, "b_values", "b_slots").agg(F.count_distinct("b_at").alias("b_times"))
    most = F.struct("b_times", F.col("b_values") == F.col("b_slots"), "b_slots")
    maps = (
        votes.groupBy(*align, "b_values")
        .agg(F.max(most).getField("b_slots").alias("b_slots"), F.count("*").alias("b_kinds"))
        .where("b_kinds > 1")
        .groupBy(*align)
        .agg(F.map_from_entries(F.collect_list(F.struct("b_values", "b_slots"))).alias("b_map"))
    )
    same = F.lit(True)
    maps = maps.withColumnsRenamed({c: f"{c}_" for c in align})
    for c in align:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
    fits = F.forall(
        F.arrays_zip("b_values", "b_slots"),
        lambda x: F.coalesce(F.element_at("b_map", x["b_values"]), x["b_slots"]) == x["b_slots"],
    )
    good = hits.join(maps, same, "left").where(
        F.col("b_map").isNull() | F.col("b_slots").isNull() | fits
    )
    whole = ["b_doc", "b_h", "b_item", "b_ih", "b_n"]
    places = good.select(
        *whole, "b_off", F.explode(F.sequence("b_j", F.col("b_j") + F.col("b_len") - 1)).alias("b_place")
    ).distinct()
    ordered = Window.partitionBy(*whole).orderBy("b_off")
    apart = F.col("b_off") - F.lag("b_off").over(ordered) > GAP
    chains = places.withColumn("b_apart", F.coalesce(apart, F.lit(False)).cast("int")).withColumn(
        "b_chain", F.sum("b_apart").over(ordered)
    )
    met = (
        chains.groupBy(*whole, "b_chain", "b_place")
        .agg(F.count("*").alias("b_times"))
        .groupBy(*whole, "b_chain")
        .agg(F.count("*").alias("b_covered"))
        .groupBy(*whole)
        .agg(F.max("b_covered").alias("b_covered"))
    )
    return met.where(
        (F.col("b_covered") >= ENOUGH) | (F.col("b_covered") * 2 >= F.col("b_n"))
    )


def clean(
    df: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """The documents that hold no item, in the columns of df."""
    plain, (t, d) = aside(df, text, doc_id)
    bad = leaks(plain, benchmark, t, d).select("b_doc", "b_h").distinct()
    same = F.col(d).eqNullSafe(F.col("b_doc")) & (F.xxhash64(F.col(t)) == F.col("b_h"))
    return plain.join(bad, same, "left_anti").toDF(*df.columns)
