"""Raw tool output: whole texts, or numbered lines for artifacts too large for a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.frames import written
from .logs import empty_files


def read_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``artifact_id, text``, one row per file, line ends normalised."""
    whole = spark.read.text(path, wholetext=True)
    texts = whole.select(
        F.col("_metadata.file_path").alias("artifact_id"),
        F.regexp_replace("value", "\r\n?", "\n").alias("text"),
    )
    return texts.union(empty_files(spark, path).select("artifact_id", F.lit("").alias("text")))


#: File splits whose offsets are broadcast, of about 100 bytes each: at 128 MB to a split 320 TB.
MAX_SPLITS = 2_500_000
#: A file under 128 bits of digest of its name: two numbers, cheap to take for every line.
FILE = ["file_a", "file_b"]
#: Bytes of a file whose splits are summed in one window.
BLOCK_BYTES = 1 << 40


def _offsets(splits: DataFrame, block_bytes: int) -> DataFrame:
    """``FILE, split_start, first_id, n`` -> the lines before each split as ``offset``, for ``n``.

    A prefix sum in two levels: inside a block of a file, and over the totals of its blocks.
    """
    block = F.expr(f"split_start DIV {int(block_bytes)}L")
    placed = splits.withColumn("block", block)
    rows = Window.unboundedPreceding, -1
    inside = Window.partitionBy(*FILE, "block").orderBy("split_start").rowsBetween(*rows)
    over = Window.partitionBy(*FILE).orderBy("block").rowsBetween(*rows)
    none = F.lit(0).cast("long")
    blocks = placed.groupBy(*FILE, "block").agg(F.sum("n").alias("n"))
    before = blocks.select(*FILE, "block", F.coalesce(F.sum("n").over(over), none).alias("before"))
    summed = placed.withColumn("inside", F.coalesce(F.sum("n").over(inside), none))
    return summed.join(before, [*FILE, "block"]).select(
        *FILE, "split_start", "first_id", (F.col("before") + F.col("inside")).alias("offset")
    )


def read_lines(
    spark: SparkSession,
    path: str | list[str],
    max_splits: int = MAX_SPLITS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``artifact_id, line_no, line`` with gap-free line numbers from 0, from splittable files.

    Lines are numbered inside their file split as they are read. How many lines precede a split is
    a prefix sum over the table of splits, which is written once and then met by digest of the file
    name and split: broadcast up to ``max_splits`` rows, so that no text is shuffled or sorted, and
    joined by shuffling beyond. An empty file is one empty line.

    Both reads of the files must cut them alike: keep ``spark.sql.files.maxPartitionBytes`` until the
    lines are used. A line whose split isn't in the table raises an error.
    """
    file = F.col("_metadata.file_path")
    read = spark.read.text(path).select(
        file.alias("artifact_id"),
        F.xxhash64(file).alias(FILE[0]),
        F.xxhash64(file, F.lit(1)).alias(FILE[1]),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.col("value").alias("line"),
        F.monotonically_increasing_id().alias("id"),
    )
    splits = read.groupBy(*FILE, "split_start").agg(
        F.min("id").alias("first_id"), F.count("*").alias("n")
    )
    offsets = written(_offsets(written(splits, "splits"), block_bytes), "offsets")
    if offsets.count() <= max_splits:
        offsets = F.broadcast(offsets)
    numbered = read.join(offsets, [*FILE, "split_start"], "left")
    at = F.coalesce("offset", F.raise_error(F.lit("the files were cut differently when counted")).cast("long"))
    lines = numbered.select(
        "artifact_id", (at + F.col("id") - F.col("first_id")).alias("line_no"), "line"
    )
    empty = empty_files(spark, path)
    return lines.union(empty.select("artifact_id", F.lit(0).cast("long"), F.lit("")))
