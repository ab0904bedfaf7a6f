"""The folder that driver and executors share, and tables written to it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters other than these (space, tab to carriage return).
WHITE = "[ \\t-\\r]+"


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Only a local session without that setting, as in tests, gets a temporary one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="corpus-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """A path as a URI of the file system that Spark takes it to be on."""
    jvm = spark.sparkContext._jvm
    whole = jvm.org.apache.hadoop.fs.Path(path)
    fs = whole.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    uri = fs.makeQualified(whole).toUri()
    return f"file://{uri.getPath()}" if uri.getScheme() == "file" else uri.toString()


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, computed once and read back from the shared folder.

    This cuts the lineage: a lost executor costs its running tasks, not the steps before.
    """
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def aside(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """df with its columns under numbers, so that none clashes with a working column.

    Also the new names of the given columns. ``toDF(*df.columns)`` gives the old names back.
    """
    new = [f"in_{i}" for i in range(len(df.columns))]
    return df.toDF(*new), [new[df.columns.index(n)] for n in names]


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that later expressions read, each evaluated once for a row.

    Catalyst would otherwise put the expression wherever the column is named, also into lambdas
    that run for every element of an array.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    made = F.struct(*(c.alias(n) for n, c in columns.items()))
    return df.select(*kept, F.inline(F.array(made)))
