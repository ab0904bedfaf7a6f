"""A deterministic sharded WARC writer, and a reader.

Writing
1. Shards are ranges of page_id. Their bounds are quantiles of a bounded, digest-chosen sample of
   the distinct ids, so they depend on the data alone, not on tasks or partitions.
2. Rows of one shard are sorted by id and payload digest and written in order. A file is closed
   once it holds `roll` compressed bytes. Each record is a gzip member of its own; its headers,
   record id and digests are made anew from the row, the date is fixed, so equal rows give equal
   bytes.
3. A file is written under a temporary name of its attempt and renamed to its final name when it is
   complete. The manifest, a table of the final names with sizes and digests, is written last; what
   it doesn't name doesn't count. A task that runs twice writes the same bytes under the same name.

Of records with equal payloads of at least `REVISIT_BYTES`, that with the largest page_id is the
response and the others are revisits that refer to it. Only digests are compared and shuffled for
that; what a shard has to know travels to it as a narrow row in front of the page. Payloads pass one
shuffle.

Files are opened through the file system that the folder's URI names.

Defined results: null html is an empty payload, null urls have no target. Rows with a null page_id
come first, in a shard of their own, and are neither revisits nor referred to. Of repeated rows
with the largest page_id the first is the response. Empty tables give an empty manifest. Extra
columns are not written.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.llm.shared import stored

REVISIT_BYTES = 1000
#: Compressed bytes at which a file is closed.
ROLL = 64 << 20
#: Bytes of payload that a shard should have.
SHARD = 64 << 20
#: Ids that may be gathered to place the shards' bounds (8 bytes each). Beyond MAX_SHARDS of
#: SHARD bytes shards grow, as there are ten sampled ids to each.
SAMPLE = 200_000
MAX_SHARDS = SAMPLE // 10
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "name string, shard long, records long, bytes long, sha256 string"
_FILES = pa.schema(
    [("name", pa.string()), ("shard", pa.int64()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]
)
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _record_id(page_id: int | None, digest: str, copy: int) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{copy}').urn}>"


def _record(page_id, url, payload: bytes, digest: str, refers: int | None, copy: int) -> bytes:
    """One record, compressed. refers: the page_id of the response, for a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if refers is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id, digest, copy)}",
        f"WARC-Date: {DATE}",
    ]
    if url:
        # A header is one line; other bytes than visible ASCII are escaped.
        safe = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
        lines.append(f"WARC-Target-URI: {safe}")
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    lines += [
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers is not None:
        lines += [
            f"WARC-Refers-To: {_record_id(refers, digest, 0)}",
            f"Refers-To-Page-ID: {refers}",
            f"WARC-Profile: {PROFILE}",
        ]
    head = "\r\n".join(lines).encode() + b"\r\n\r\n"
    return gzip.compress(head + block + b"\r\n\r\n", 6, mtime=0)


class _Roll:
    """The files of one shard, written one after the other."""

    def __init__(self, root: str, shard: int, roll: int):
        self.fs, self.root = pyarrow.fs.FileSystem.from_uri(root)
        self.shard, self.roll, self.part, self.out = shard, roll, 0, None

    def add(self, record: bytes) -> Iterator[dict]:
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.part:05d}.warc.gz"
            self.temporary = f"{self.root}/.{self.name}.{uuid.uuid4().hex}"
            self.out = self.fs.open_output_stream(self.temporary, compression=None)
            self.size, self.records, self.sha = 0, 0, hashlib.sha256()
        self.out.write(record)
        self.sha.update(record)
        self.size += len(record)
        self.records += 1
        if self.size >= self.roll:
            yield from self.close()

    def close(self) -> Iterator[dict]:
        if self.out is not None:
            self.out.close()
            whole = f"{self.root}/{self.name}"
            if self.fs.get_file_info(whole).type == pyarrow.fs.FileType.NotFound:
                self.fs.move(self.temporary, whole)
            else:  # another attempt was first, with the same bytes
                self.fs.delete_file(self.temporary)
            yield {
                "name": self.name, "shard": self.shard, "records": self.records,
                "bytes": self.size, "sha256": self.sha.hexdigest(),
            }
            self.out, self.part = None, self.part + 1


def _writer(root: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, refers, key, copy = None, None, None, 0
        for whole in batches:
            for at in range(0, whole.num_rows, 32):
                for r in whole.slice(at, 32).to_pylist():
                    if files is None or r["w_shard"] != files.shard:
                        if files and (done := list(files.close())):
                            yield pa.RecordBatch.from_pylist(done, _FILES)
                        files, key = _Roll(root, r["w_shard"], roll), None
                    if key != (r["w_page"], r["w_digest"]):
                        key, refers, copy = (r["w_page"], r["w_digest"]), None, 0
                    if r["w_page_row"] is False:  # what the next rows refer to
                        refers = r["w_refers"]
                        continue
                    own = refers if refers != r["w_page"] or copy else None
                    record = _record(
                        r["w_page"], r["w_url"], r["w_html"].encode(), r["w_digest"], own, copy
                    )
                    copy += 1
                    if done := list(files.add(record)):
                        yield pa.RecordBatch.from_pylist(done, _FILES)
        if files and (done := list(files.close())):
            yield pa.RecordBatch.from_pylist(done, _FILES)

    return run


def _bounds(ids: DataFrame, shards: int) -> list[int]:
    """Up to shards - 1 ids at which a new shard begins.

    The sample holds every id whose digest falls under a bound chosen for SAMPLE ids at most.
    """
    ids = ids.where("w_page is not null").select("w_page").distinct()
    n = ids.count()
    if shards < 2 or not n:
        return []
    every = -(-n * 2 // SAMPLE)
    found = ids.where(F.pmod(F.xxhash64("w_page"), F.lit(every)) == 0).agg(
        F.sort_array(F.collect_list("w_page"))
    )
    sample = found.first()[0]
    return sorted({sample[len(sample) * k // shards] for k in range(1, shards)} if sample else ())


def _shard(page: Column, bounds: list[int]) -> Column:
    """How many bounds an id has reached; -1 for none."""
    known = np.array(bounds, np.int64)

    @F.pandas_udf("long")
    def reached(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(known, ids.to_numpy(np.int64), side="right"))

    return F.when(page.isNull(), F.lit(-1).cast("long")).otherwise(
        reached(F.coalesce(page, F.lit(0).cast("long")))
    )


def write(
    df: DataFrame,
    root: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    roll: int = ROLL,
    shard_bytes: int = SHARD,
) -> DataFrame:
    """Write the rows as archives below root, an empty folder's URI; returns the manifest."""
    payload = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    pages = df.select(
        F.col(f"`{page_id}`").cast("long").alias("w_page"),
        F.sha1(payload).alias("w_digest"),
        F.lit(True).alias("w_page_row"),
        F.col(f"`{url}`").alias("w_url"),
        payload.alias("w_html"),
    )
    narrow = stored(
        pages.select("w_page", "w_digest", F.octet_length("w_html").alias("w_bytes")), "digests"
    )
    total = narrow.agg(F.coalesce(F.sum("w_bytes"), F.lit(0))).first()[0]
    shards = max(1, min(MAX_SHARDS, -(-total // shard_bytes)))
    shard = _shard(F.col("w_page"), _bounds(narrow, shards))
    large = narrow.where((F.col("w_bytes") >= REVISIT_BYTES) & F.col("w_page").isNotNull())
    groups = (
        large.groupBy("w_digest")
        .agg(F.max("w_page").alias("w_refers"), F.count("*").alias("w_n"))
        .where("w_n > 1")
        .drop("w_n")
    )
    marks = large.join(groups, "w_digest").distinct()
    marks = marks.select(
        "w_page", "w_digest", F.lit(False).alias("w_page_row"),
        F.lit(None).cast("string").alias("w_url"), F.lit(None).cast("string").alias("w_html"),
        "w_refers",
    )
    rows = pages.withColumn("w_refers", F.lit(None).cast("long")).union(marks)
    # A shard is a partition; rows without an id have the number -1 and the first one.
    rows = rows.withColumn("w_shard", shard.cast("long"))
    rows = rows.repartitionById(int(shards) + 1, (F.col("w_shard") + 1).cast("int"))
    rows = rows.sortWithinPartitions("w_shard", "w_page", "w_digest", "w_page_row", "w_url")
    manifest = rows.mapInArrow(_writer(root, roll), MANIFEST)
    fs, folder = pyarrow.fs.FileSystem.from_uri(root)
    fs.create_dir(folder, recursive=True)
    manifest.write.mode("overwrite").parquet(f"{root}/_manifest")
    return df.sparkSession.read.schema(MANIFEST).parquet(f"{root}/_manifest")


def _records(stream) -> Iterator[dict]:
    """The records of one open archive, read as a stream."""
    with gzip.GzipFile(fileobj=stream) as data:
        reader = io.BufferedReader(data, 1 << 20)
        while line := reader.readline():
            if not line.strip():
                continue
            if line.strip() != b"WARC/1.1":
                raise ValueError(f"no record starts with {line[:40]!r}")
            head = _headers(reader)
            block = reader.read(int(head["content-length"]))
            if "sha1:" + hashlib.sha1(block).hexdigest() != head["warc-block-digest"]:
                raise ValueError(f"damaged record {head['warc-record-id']}")
            body = io.BytesIO(block)
            body.readline()
            http = _headers(body)
            payload = body.read()
            digest = head["warc-payload-digest"].removeprefix("sha1:")
            kind = head["warc-type"]
            if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError(f"damaged payload of {head['warc-record-id']}")
            page, refers = head.get("page-id"), head.get("refers-to-page-id")
            yield {
                "page_id": int(page) if page else None,
                "url": head.get("warc-target-uri"),
                "record_type": kind,
                "payload_bytes": int(http["content-length"]),
                "payload_digest": digest,
                "refers_to": int(refers) if refers else None,
                "payload": payload if kind == "response" else None,
            }


def _headers(stream) -> dict[str, str]:
    found = {}
    while (line := stream.readline()).strip():
        name, _, value = line.decode().partition(":")
        found[name.strip().lower()] = value.strip()
    return found


_FIELDS = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
     ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
)


def read(manifest: DataFrame, root: str, payloads: bool = True) -> DataFrame:
    """The records of the archives that the manifest names; each file is one task's stream."""
    names = _FIELDS if payloads else _FIELDS.remove(6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pyarrow.fs.FileSystem.from_uri(root)
        for batch in batches:
            for name in batch[0].to_pylist():
                with fs.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    some, size = [], 0
                    for record in _records(stream):
                        some.append(record)
                        size += len(record["payload"] or b"") if payloads else 100
                        if size > 1 << 20:
                            yield pa.RecordBatch.from_pylist(some, names)
                            some, size = [], 0
                    if some:
                        yield pa.RecordBatch.from_pylist(some, names)

    fields = RECORD if payloads else RECORD.removesuffix(", payload binary")
    return manifest.select("name").repartition("name").mapInArrow(run, fields)
