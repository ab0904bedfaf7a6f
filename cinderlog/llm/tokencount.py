"""Token counts through a digest cache.

A count depends on a text and on the tokenizer alone, so it is stored under the digests of both.
Texts are digested in the JVM; one document per unknown digest is encoded; the new counts are
appended to the cache and all documents read theirs from it.

Content is normalised only as far as the tokenizer cannot tell: null becomes empty. Defined
results: null and empty texts count 0 bytes and 0 tokens, repeated texts are encoded once, also
where their doc_id is null or shared. Extra columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlog.llm.shared import folder, stored

LIMIT = 4096
#: Bytes encoded at once, unless one text is longer.
SLICE = 1 << 20
SCHEMA = "c_content binary, c_version string, c_tokens long"


@functools.lru_cache(2)
def _model(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


def version(path: str) -> str:
    """The digest that stands for a tokenizer: its library, release and file."""
    with open(path, "rb") as f:
        return hashlib.sha256(sentencepiece.__version__.encode() + b"\0" + f.read()).hexdigest()


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = _model(path), set()
        for batch in batches:
            keys, texts, size = [], [], 0
            for k, t in zip(batch[0].to_pylist(), batch[1], strict=True):
                if k in seen:  # rows that share text and doc_id are in one task
                    continue
                seen.add(k)
                keys.append(k)
                texts.append(t.as_py())
                size += len(texts[-1])
                if size >= SLICE:
                    yield counted(model, keys, texts)
                    keys, texts, size = [], [], 0
            if keys:
                yield counted(model, keys, texts)

    def counted(model, keys: list, texts: list) -> pa.RecordBatch:
        n = [len(ids) for ids in model.encode(texts, num_threads=1)]
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), pa.array(n, pa.int64())], names=["c_content", "c_tokens"]
        )

    return run


def new_cache(spark: SparkSession) -> str:
    """A new, empty cache in the shared folder."""
    path = folder(spark, "token-counts")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return path


def counts(
    df: DataFrame, path: str, cache: str, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row; adds unknown counts to the cache."""
    spark = df.sparkSession
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    docs = df.select(
        F.col(f"`{doc_id}`").alias("doc_id"), t.alias("c_text"), F.unhex(F.sha2(t, 256)).alias("c_content")
    )
    rows = stored(
        docs.select("doc_id", "c_content", F.octet_length("c_text").cast("long").alias("n_bytes")),
        "digests",
    )
    own = version(path)

    def known() -> DataFrame:
        found = spark.read.schema(SCHEMA).parquet(cache).where(F.col("c_version") == own)
        return found.select("c_content", "c_tokens").dropDuplicates(["c_content"])

    misses = rows.join(known(), "c_content", "left_anti")
    # One document for each digest: the text goes through the shuffle once, and only there.
    lead = misses.groupBy(F.col("c_content").alias("c_key")).agg(F.min("doc_id").alias("c_lead"))
    todo = docs.join(
        lead.hint("shuffle_hash"),
        (F.col("c_content") == F.col("c_key")) & F.col("doc_id").eqNullSafe(F.col("c_lead")),
        "left_semi",
    )
    fresh = todo.select("c_content", "c_text").mapInArrow(
        _encoder(path), "c_content binary, c_tokens long"
    )
    fresh.select("c_content", F.lit(own).alias("c_version"), "c_tokens").write.mode("append").parquet(cache)
    out = rows.join(known(), "c_content")
    return out.select(
        "doc_id",
        "n_bytes",
        F.col("c_tokens").alias("n_tokens"),
        (F.col("c_tokens") > LIMIT).alias("over_limit"),
    )
