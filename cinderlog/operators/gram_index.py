"""Which lines hold which words, by an inverted index of q-grams.

Comparing every line of an artifact with every word asked of it costs lines times words. Instead
each word is kept under one of its q-grams, the one that the fewest lines of the artifact hold; a
line looks up its own q-grams and is compared only with the words found there. A word's q-grams are
all in a line that holds it, so nothing is missed, and the comparison settles the rest.

An artifact with few words keeps them in packs that its lines are compared with directly, which is
cheaper than taking a line to pieces. The result is the same either way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import written

#: Length of a q-gram. Shorter words have none and are packed.
GRAM = 4
#: An artifact with more words than this has them looked up by q-gram.
FEW = 256
#: Words that travel with a line in one row, where they are packed.
PACK = 256
#: Characters of all looked-up words up to which their index, a row of about 100 bytes for each,
#: is broadcast.
BROADCAST_CHARS = 1 << 20


def grams(text: Column, q: int = GRAM) -> Column:
    """The distinct q-grams of a text; none for a shorter one or null.

    Overlapping matches come from a lookahead, so the work is linear in the text's length.
    """
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{q}}}))"), F.lit(1)))


def contained(
    lines: DataFrame,
    words: DataFrame,
    line_key: list[str],
    by: str = "artifact_id",
    line: str = "line",
    word: str = "word",
    few: int = FEW,
    broadcast_chars: int = BROADCAST_CHARS,
) -> DataFrame:
    """The columns of ``lines`` with each word of the same ``by`` that the line contains.

    ``words`` is ``by, word``; repeats count once, nulls never match, an empty word is in every
    line. ``line_key`` with ``by`` tells lines apart. A line without a match gives no row, and no
    pair of line and word is given twice.

    Where the index is too large to broadcast, what is shuffled is keys and q-grams, without the
    lines' texts; texts meet the pairs that are left afterwards.
    """
    words = words.select(by, F.col(word).alias("_word")).where("_word IS NOT NULL").distinct()
    words = written(words.withColumn("_long", F.length("_word") >= GRAM), "words")
    many = words.where("_long").groupBy(by).agg(
        F.count("*").alias("_n"), F.sum(F.length("_word")).alias("_chars")
    )
    many = many.where(F.col("_n") > few).select(by, "_chars")
    size = many.agg(F.sum("_chars")).first()[0]
    listed = lines.columns
    if size is None:
        return _packed(lines, words, by, line).select(*listed, F.col("_word").alias(word))
    long = words.join(many, by, "left_semi").where("_long").select(by, "_word")
    rest = words.join(long, [by, "_word"], "left_anti")
    found = _looked_up(lines, long, line_key, by, line, size <= broadcast_chars)
    return (
        _packed(lines, rest, by, line)
        .unionByName(found)
        .select(*listed, F.col("_word").alias(word))
    )


def _packed(lines: DataFrame, words: DataFrame, by: str, line: str) -> DataFrame:
    """Lines meet the words of their artifact in packs, dealt by a digest."""
    dealt = words.groupBy(by).agg(F.ceil(F.count("*") / PACK).alias("_packs"))
    packs = (
        words.join(dealt, by)
        .groupBy(by, F.pmod(F.xxhash64("_word"), F.col("_packs")).alias("_pack"))
        .agg(F.collect_list("_word").alias("_words"))
        .drop("_pack")
    )
    held = F.filter("_words", lambda w: F.contains(F.col(line), w))
    return lines.join(packs, by).select(*(F.col(c) for c in lines.columns), F.explode(held).alias("_word"))


def _looked_up(
    lines: DataFrame, words: DataFrame, line_key: list[str], by: str, line: str, small: bool
) -> DataFrame:
    def sized(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    of_words = words.select(by, "_word", F.explode(grams(F.col("_word"))).alias("_gram"))
    of_words = written(of_words, "grams")
    # Lines of each q-gram that some word holds; a word with a q-gram in no line is in none.
    asked = of_words.select(by, "_gram").distinct()
    in_lines = lines.select(by, F.explode(grams(F.col(line))).alias("_gram"))
    counts = in_lines.join(sized(asked), [by, "_gram"], "left_semi").groupBy(by, "_gram").agg(
        F.count("*").alias("_n")
    )
    rarest = (
        of_words.join(counts, [by, "_gram"], "left")
        .groupBy(by, "_word")
        .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("_least"))
        .where("_least.n > 0")
        .select(by, "_word", F.col("_least.gram").alias("_gram"))
    )
    index = written(rarest, "index")
    if small:
        each = lines.select("*", F.explode(grams(F.col(line))).alias("_gram"))
        pairs = each.join(F.broadcast(index), [by, "_gram"])
    else:
        each = lines.select(by, *line_key, F.explode(grams(F.col(line))).alias("_gram"))
        narrow = each.join(index, [by, "_gram"]).drop("_gram")
        pairs = lines.join(narrow, [by, *line_key])
    return pairs.where(F.contains(F.col(line), F.col("_word"))).select(*lines.columns, "_word")
