"""DataFrame helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def settle(df: DataFrame, *computed: str) -> DataFrame:
    """Evaluate costly columns here, once per row.

    Catalyst moves a filter below a projection by repeating the projected expression in it. For a
    column built from dozens of patterns that repeats all of them, at every level. A generator
    over one struct is a boundary such a filter stays above. Costs no shuffle.
    """
    kept = [c for c in df.columns if c not in computed]
    settled = df.select(*kept, F.inline(F.array(F.struct(*computed))))
    return settled.select(*df.columns)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session without that setting, as in tests, gets a temporary one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="cinderlog-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, computed once and read back from the shared folder.

    For small tables that are read several times; cuts the lineage, so a lost executor costs its
    running tasks only.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def meet(df: DataFrame, table: DataFrame, on: list[str], most: int) -> DataFrame:
    """An inner join with a written table, which is broadcast if it has at most ``most`` rows.

    Beyond that Spark joins as it sees fit. The caller states what a row takes.
    """
    return df.join(F.broadcast(table) if table.count() <= most else table, on)
