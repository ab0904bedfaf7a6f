"""Column profile: name, type and a few example values of every column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXAMPLES = 4
CUT = 90
#: Bytes of values a task holds before it cuts them down to the smallest ones again.
HELD_BYTES = 16 << 20


def profile(
    df: DataFrame, k: int = EXAMPLES, keys: list[str] | None = None
) -> DataFrame:
    """``column_name, column_type, examples``: up to ``k`` distinct non-null values per column.

    The examples are the ``k`` smallest values by text, so a profile is repeatable. Values longer
    than 90 characters are cut and marked with ``...`` after the choice. With ``keys`` the profile
    is per artifact.

    A task sends on at most ``k`` values per column (and key it holds), whatever the number of rows
    or of distinct values: see `_smallest`. Choosing among those is exact.
    """
    keys = keys or []
    columns = [c for c in df.columns if c not in keys]
    plain = [f"k{i}" for i in range(len(keys))]
    texts = [F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(columns, 1)]
    rows = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keys, plain, strict=True)), *texts)
    form = T.StructType([T.StructField(n, df.schema[c].dataType) for c, n in zip(keys, plain, strict=True)])
    form = form.add("position", T.IntegerType()).add("value", T.StringType())
    values = rows.mapInArrow(_smallest(k, len(keys)), form)
    values = values.withColumnsRenamed(dict(zip(plain, keys, strict=True)))
    distinct = values.dropDuplicates([*keys, "position", "value"])
    order = Window.partitionBy(*keys, "position").orderBy("value")
    smallest = distinct.withColumn("n", F.row_number().over(order)).where(
        F.col("n") <= k
    )
    cut = F.concat(F.substring("value", 1, CUT), F.lit("..."))
    shown = F.when(F.length("value") <= CUT, F.col("value")).otherwise(cut)
    examples = smallest.groupBy(*keys, "position").agg(
        F.array_sort(F.collect_list(F.struct("n", shown.alias("s")))).alias("e")
    )

    # Columns without a value keep a row with no examples.
    types = dict(df.dtypes)
    listed = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("position"),
                    F.lit(c).alias("column_name"),
                    F.lit(types[c]).alias("column_type"),
                )
                for i, c in enumerate(columns, 1)
            ]
        )
    )
    if keys:
        frame = df.select(*keys).distinct().select(*keys, listed)
    else:
        frame = df.sparkSession.range(1).select(listed)
    none = F.array().cast("array<string>")
    theirs = examples.toDF(*(f"_{c}" for c in [*keys, "position"]), "e")
    same = F.lit(True)
    for c in [*keys, "position"]:  # a null key is a key
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"`_{c}`"))
    return frame.join(theirs, same, "left").select(
        *keys, "column_name", "column_type", F.coalesce("e.s", none).alias("examples")
    )


def _smallest(k: int, n_keys: int):
    """Key columns and text columns -> keys, position and value: the ``k`` smallest of a task.

    Spark's aggregates keep no bounded set of texts: a distinct before the shuffle passes on every
    value of a column of unique ones, and a rank limit every row of a column of equal ones. Arrow
    finds the distinct values of a batch and drops those above the k-th smallest found so far.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bounds = None, {}
        for batch in batches:
            found = [entries(batch, p, bounds) for p in range(n_keys, batch.num_columns)]
            held = pa.concat_tables([t for t in (held, *found) if t is not None])
            if held.nbytes > HELD_BYTES or not n_keys:
                held = cut(held)
                if not n_keys:
                    bounds.update(highest(held))
                elif held.nbytes > HELD_BYTES // 2:  # very many keys
                    yield from held.to_batches()
                    held = None
        if held is not None:
            yield from cut(held).to_batches()

    def entries(batch: pa.RecordBatch, at: int, bounds: dict) -> pa.Table:
        position, values = at - n_keys + 1, batch.column(at)
        if not n_keys:
            values = values.unique()
            if position in bounds:
                values = values.filter(pc.less_equal(values, bounds[position]))
        names = [f"k{i}" for i in range(n_keys)]
        columns = [batch.column(i) for i in range(n_keys)]
        where = pa.array(np.full(len(values), position, np.int32))
        table = pa.table([*columns, where, values], names=[*names, "position", "value"])
        table = table.filter(pc.is_valid(table["value"]))
        return table.group_by(table.column_names).aggregate([])

    def cut(table: pa.Table) -> pa.Table:
        """The k smallest distinct values of each position and key."""
        names = table.column_names
        if not len(table):
            return table
        rows = table.group_by(names).aggregate([]).select(names)
        rows = rows.sort_by([(n, "ascending") for n in names]).combine_chunks()
        first = np.zeros(len(rows), bool)
        first[0] = True
        for n in names[:-1]:
            code = rows[n].combine_chunks().dictionary_encode(null_encoding="encode")
            code = code.chunk(0) if isinstance(code, pa.ChunkedArray) else code
            code = code.indices.to_numpy()
            first[1:] |= code[1:] != code[:-1]
        place = np.arange(len(rows))
        rank = place - np.maximum.accumulate(np.where(first, place, 0))
        return rows.filter(pa.array(rank < k))

    def highest(table: pa.Table) -> dict:
        """The k-th smallest value of each position that has as many."""
        found = table.group_by("position").aggregate([("value", "max"), ("value", "count")])
        return {
            p: m
            for p, m, n in zip(*(found[c].to_pylist() for c in ("position", "value_max", "value_count")), strict=True)
            if n >= k
        }

    return run
