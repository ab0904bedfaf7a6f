"""CSV logs as DataFrames with an explicit schema."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import meet, written

# The auth-log family's file layout.
AUTH_LOG_SCHEMA = T.StructType(
    [
        T.StructField("LineId", T.LongType()),
        T.StructField("Date", T.StringType()),
        T.StructField("Day", T.LongType()),
        T.StructField("Time", T.StringType()),
        T.StructField("Component", T.StringType()),
        T.StructField("Pid", T.LongType()),
        T.StructField("Content", T.StringType()),
        T.StructField("EventId", T.StringType()),
        T.StructField("EventTemplate", T.StringType()),
    ]
)
MINIMAL_SCHEMA = T.StructType(
    [
        f
        for f in AUTH_LOG_SCHEMA.fields
        if f.name in ("LineId", "Content", "EventId", "EventTemplate")
    ]
)
CSV_OPTIONS = {"header": "true", "escape": '"', "enforceSchema": "false"}


def read_log(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType = AUTH_LOG_SCHEMA,
    multiline: bool = False,
) -> DataFrame:
    """One log or a glob of logs, with the file as ``artifact_id``.

    The schema is given, never inferred: clock times stay text and no extra pass reads the data.
    A path that matches nothing raises Spark's PATH_NOT_FOUND. ``multiline`` is only for files
    whose records hold line breaks, as such a file cannot be split.
    """
    reader = spark.read.schema(schema).options(**CSV_OPTIONS)
    if multiline:
        reader = reader.option("multiLine", "true")
    paths = [path] if isinstance(path, str) else list(path)
    for p in paths:
        refuse_directory(spark, p)
    return reader.csv(paths).select(
        F.col("_metadata.file_path").alias("artifact_id"), "*"
    )


#: Files whose header positions are broadcast, of about 200 bytes each.
MAX_FILES = 1_000_000
#: A field of a CSV header behind its comma.
HEADER_FIELD = r',("(?:[^"]++|"")*+"(?=,|$)|[^,]*+)'


def header_names(header: Column) -> Column:
    """The column names of a CSV header line, in order."""
    fields = F.regexp_extract_all(F.concat(F.lit(","), header), F.lit(HEADER_FIELD), F.lit(1))

    def plain(x: Column) -> Column:
        inner = F.substr(x, F.lit(2), F.length(x) - 2)
        return F.when(x.rlike('^".*"$'), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(x)

    return F.transform(fields, plain)


def _whole(value: Column) -> Column:
    """A whole number; NULL for anything else."""
    return F.when(value.rlike(r"^[+-]?[0-9]+$"), value.try_cast("bigint"))


#: Tasks per core that look up the files of a glob; by default Spark takes one per file, up to 10,000.
LISTERS = 4
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
#: Bytes up to which a file is read whole, by one task. Opening it by lines costs as much as reading these.
SMALL = 1 << 20
#: Names of files that no codec applies to, as whole files are read as they are.
PLAIN_NAME = r"(?i)\.(csv|txt|log)$"
#: Bytes that opening a whole file is reckoned at; Spark's 4 MB would put 32 files to a task.
OPENING = 1 << 18
OPEN_COST = "spark.sql.files.openCostInBytes"
#: Either half of a line's end: empty lines are dropped anyway.
LINE_END = r"[\r\n]"


@contextmanager
def _setting(spark: SparkSession, name: str, value: int) -> Iterator[None]:
    """A setting of the session, put back afterwards."""
    usual = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, usual)


def _listed(spark: SparkSession, source: str, paths: list[str], named: str | None) -> DataFrame:
    """Files as texts or whole, which are looked up here, many to a task."""
    reader = spark.read.format(source)
    if named is not None:
        reader = reader.option("pathGlobFilter", named).option("recursiveFileLookup", "true")
    tasks = min(int(spark.conf.get(LISTING)), LISTERS * spark.sparkContext.defaultParallelism)
    with _setting(spark, LISTING, tasks):
        return reader.load(paths)


def read_logs(
    spark: SparkSession,
    path: str | list[str],
    max_files: int = MAX_FILES,
    small: int = SMALL,
    named: str | None = None,
) -> DataFrame:
    """Logs of any headers: ``artifact_id, has_header`` and the required columns.

    Columns are found by name, so further ones and any order do. A file whose header lacks a required
    column, or names one twice, has ``has_header`` false or null columns, and an empty file is one
    such row, so that all are answered with "no family". Records are lines; a file with line breaks
    inside records needs `read_log` with ``multiline``.

    A record is split into its positions once, by one parser for all files, as wide as the last
    required column of any header. A table of distinct headers tells at which position each
    required column stands. The number of different headers is not limited, and none is fetched to
    the driver.

    Files of up to ``small`` bytes are opened once: a task reads many of them whole, and their records
    are written to the shared folder with their headers. Longer and compressed ones are split, and read
    for their headers and for their rows; a file's row of positions is met by file, broadcast up to
    ``max_files`` files.

    With ``named``, as ``*.csv``, paths are folders, and the files of such names in and below them are
    the logs. Tasks look through folders; the files of a glob are looked for by the driver alone.
    """
    paths = [path] if isinstance(path, str) else list(path)
    for p in paths if named is None else ():
        refuse_directory(spark, p)
    files = _listed(spark, "binaryFile", paths, named)
    # Both conditions are on names and lengths, so Spark drops the other files as it plans.
    short = (F.col("_metadata.file_size") <= small) & F.col("_metadata.file_name").rlike(PLAIN_NAME)
    whole = _whole_files(spark, files.where(short))
    n_files = whole.where("pos = 0").count()
    headers = whole.select("header")
    heads = None
    if not files.where(~short).select("path").isEmpty():
        lines, heads = _split_files(_listed(spark, "text", paths, named).where(~short))
        n_files += heads.count()
        headers = headers.union(heads.select("header"))

    required = MINIMAL_SCHEMA.fieldNames()
    names = F.col("names")
    layouts = headers.distinct().select(
        "header", F.inline(F.array(F.struct(header_names(F.col("header")).alias("names"))))
    )
    at = F.array(*(F.array_position(names, n).cast("int") - 1 for n in required))
    layouts = layouts.select(
        "header", at.alias("at"), (F.size(F.array_distinct(names)) == F.size(names)).alias("single")
    )
    layouts = layouts.withColumn("has_header", F.array_min("at") >= 0)
    layouts = written(layouts.withColumn("readable", F.col("has_header") & F.col("single")), "layouts")
    last = layouts.where("readable").agg(F.max(F.array_max("at"))).first()[0]
    wide = ", ".join(f"c{i} string" for i in range((last or 0) + 1))
    position = F.when(F.col("readable"), F.col("at")).alias("at")

    rows = meet(whole.where("line IS NOT NULL"), layouts, ["header"], max_files)
    rows = rows.select("artifact_id", "has_header", position, "line")
    # Files without a record still are artifacts.
    bare = whole.where("line IS NULL").select("artifact_id")
    if heads is not None:
        known = heads.join(layouts, "header").select(
            "artifact_id", "first_id", "n_records", "has_header", position
        )
        known = written(known, "known")
        split_rows = meet(lines, known, ["artifact_id"], max_files)
        split_rows = split_rows.where((F.col("id") != F.col("first_id")) & (F.col("line") != ""))
        rows = rows.union(split_rows.select(*rows.columns))
        bare = bare.union(known.where("n_records = 0").select("artifact_id"))
    if n_files < len(files._jdf.inputFiles()):
        bare = bare.union(empty_files(spark, paths, named))

    split = F.from_csv("line", wide, {"escape": '"'})
    cells = rows.select("artifact_id", "has_header", "at", F.inline(F.array(split)))
    record = F.array(*(F.col(f"c{i}") for i in range((last or 0) + 1)))
    found = {f.name: F.get(record, F.get("at", F.lit(i))) for i, f in enumerate(MINIMAL_SCHEMA.fields)}
    typed = [
        (_whole(found[f.name]) if f.dataType == T.LongType() else found[f.name]).alias(f.name)
        for f in MINIMAL_SCHEMA.fields
    ]
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in MINIMAL_SCHEMA.fields]
    none = bare.select(
        "artifact_id", F.lit(False).alias("has_header"), *nothing
    )
    return cells.select("artifact_id", "has_header", *typed).unionByName(none)


def _whole_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """``artifact_id, header, pos, line``: a written row per record, or one without a line.

    Spark's text reader copies the whole Hadoop configuration for every file, one task of an executor
    at a time; the reader of whole files doesn't.
    """
    lines = F.split(F.col("content").cast("string"), LINE_END).alias("lines")
    cut = files.select(
        F.col("_metadata.file_path").alias("artifact_id"), F.inline(F.array(F.struct(lines)))
    )
    # The text reader takes off a mark of its own.
    header = F.regexp_replace(F.get("lines", F.lit(0)), "^\ufeff{1,2}", "").alias("header")
    filled = F.array_remove(F.slice("lines", F.lit(2), F.size("lines")), "")
    records = cut.select("artifact_id", header, F.posexplode_outer(filled).alias("pos", "line"))
    records = records.withColumn("pos", F.coalesce("pos", F.lit(0)))
    with _setting(spark, OPEN_COST, OPENING):
        return written(records, "records")


def _split_files(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines of files, and a written row per file: ``artifact_id, first_id, n_records, header``."""
    lines = text.select(
        F.col("_metadata.file_path").alias("artifact_id"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"),
        F.col("value").alias("line"),
    )
    filled = F.col("line") != ""
    # The line with the smallest id; files come one after the other, so the sort finds them in order.
    first = F.min(F.when(F.col("start") == 0, F.struct("id", "line"))).alias("first")
    files = lines.groupBy("artifact_id").agg(first, F.count_if(filled).alias("n_filled"))
    heads = files.where("first IS NOT NULL").select(
        "artifact_id",
        F.col("first.id").alias("first_id"),
        (F.col("n_filled") - F.when(F.col("first.line") != "", 1).otherwise(0)).alias("n_records"),
        F.regexp_replace("first.line", "^\ufeff", "").alias("header"),
    )
    return lines, written(heads, "heads")


#: Folders that the files of `write_logs` are dealt to.
FOLDERS = 256


def write_logs(logs: DataFrame, folder: str, key: str, columns: list[str]) -> int:
    """A CSV file per value of the whole number ``key``, as ``<folder>/<n>/<key>=<value>.csv``.

    Returns the number of files. Spark formats and sorts the lines; tasks write their files one after
    the other, so a log of any size passes through a batch at a time. Spark's own writer makes a folder
    for each file and checks, renames and lists it by itself, which takes longer than small logs do.
    The folder is on a file system that pyarrow knows.
    """
    lines = logs.where(F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("key"), to_csv_line(*columns).alias("line")
    )
    placed = lines.repartition("key").sortWithinPartitions("key")
    made = placed.mapInArrow(_file_writer(folder, key, ",".join(columns)), "files bigint")
    return made.agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


def _file_writer(folder: str, key: str, header: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        known, made, value, out = set(), 0, None, None

        def finish() -> None:
            """A file gets its name when it is whole; a repeated task leaves what is there."""
            out.close()
            if fs.get_file_info(whole).type == pyarrow.fs.FileType.NotFound:
                fs.move(temporary, whole)
            else:
                fs.delete_file(temporary)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, lines = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, z in zip(cuts, cuts[1:]):
                if out is None or keys[a] != value:
                    if out is not None:
                        finish()
                    value, made = keys[a], made + 1
                    within = f"{root}/{value % FOLDERS}"
                    if within not in known:
                        fs.create_dir(within, recursive=True)
                        known.add(within)
                    whole = f"{within}/{key}={value}.csv"
                    temporary = f"{within}/.{value}.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(temporary, compression=None)
                    out.write(f"{header}\n".encode())
                out.write("".join(f"{line}\n" for line in lines[a:z]).encode())
        if out is not None:
            finish()
        yield pa.record_batch({"files": pa.array([made], pa.int64())})

    return run


def empty_files(
    spark: SparkSession, path: str | list[str], named: str | None = None
) -> DataFrame:
    """``artifact_id`` of the files without a byte, which Spark's readers pass over.

    The driver lists the paths, as it does to read them, and keeps the empty ones only. With ``named``
    they are folders, and the files of such names in and below them count.
    """
    found = []
    for p in [path] if isinstance(path, str) else path:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        statuses = fs.globStatus(hadoop) or ()
        for status in statuses if named is None else _below(spark, fs, statuses, named):
            if status.getLen() == 0 and status.isFile():
                found.append((status.getPath().toUri().toString(),))
    return spark.createDataFrame(found, "artifact_id string")


def _below(spark: SparkSession, fs, folders, named: str) -> Iterator:
    """The status of each file of such a name in and below folders."""
    fits = spark.sparkContext._jvm.org.apache.hadoop.fs.GlobFilter(named)
    for folder in folders:
        files = fs.listFiles(folder.getPath(), True)
        while files.hasNext():
            status = files.next()
            if fits.accept(status.getPath()):
                yield status


def refuse_directory(spark: SparkSession, path: str) -> None:
    """A directory is no artifact; give a file or a glob."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(hadoop) and fs.getFileStatus(hadoop).isDirectory():
        raise ValueError(f"{path} is a directory; give a file or a glob")


def log_columns(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Column names and types of a log; whole numbers are BIGINT and clock times stay text.

    One pass over the file finds the types.
    """
    read = spark.read.options(header="true", escape='"', inferSchema="true", prefersDate="false")
    shown = {"int": "bigint", "timestamp": "string", "timestamp_ntz": "string", "date": "string"}
    return [(n, shown.get(t, t)) for n, t in read.csv(path).dtypes]


def parse_csv_lines(line: Column, schema: str) -> Column:
    """CSV lines held in a column, read with the same quoting rules as a file."""
    return F.from_csv(line, schema, {"escape": '"'})


def to_csv_line(*columns: str) -> Column:
    """Columns written as one CSV line."""
    return F.to_csv(F.struct(*columns), {"escape": '"'})
