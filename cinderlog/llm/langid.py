"""Language of whole texts by a string kernel.

A text is the set of its character n-grams of one to three letters, a blank standing for each run of
other characters: a blended spectrum, by presence. The kernel of two texts is the size of the
intersection of their sets over the geometric mean of the sets' sizes. N-grams stand for their slot
of a fixed table of digests, so a set is a bitmap of bounded size, however long the text.

Learning takes a sample of labelled texts, at most ``SAMPLE`` in all and ``PER_LANG`` of one
language, chosen by a digest of doc_id. Some of them are landmarks; the kernels with them, made
orthonormal by the inverse root of the landmarks' own kernels (Nystroem), are the features of a ridge
regression of +1 against -1 for every language. The driver sees bitmaps of the sample alone.

Scoring is one matrix product of the bitmaps of many texts with those of the landmarks, exact in
floating point as its results are counts, and one with the coefficients. The language with the
largest value wins; the score is that value moved from -1..1 to 0..1 and cut there.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is every text
if nothing can be learned. A text that shares no n-gram with a landmark gets the first language in
order with score 0.5. Rows with a null doc_id are predicted but neither held out nor learned from;
repeated rows count once for learning. Extra columns are not read. At most ``SAMPLE`` languages can
be told apart, as each needs one sample.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderlog.llm.shared import stored

ORDERS = 3
#: The number of slots n-grams fall into, as a power of two.
BITS = 16
SLOTS = 1 << BITS
SAMPLE = 1024
PER_LANG = 256
LANDMARKS = 256
#: Added to the diagonal of the normal equations for each sample.
RIDGE = 1e-3
UNKNOWN = "und"
#: Characters of a text that are turned into n-grams at once.
PIECE = 1 << 20
#: Texts of one matrix product.
BATCH = 256
MIX = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(1)
def _lower() -> np.ndarray:
    """Lower-case form of each code point that is a letter, 0 for others."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _mark(flags: np.ndarray, letters: np.ndarray) -> None:
    """Sets the flags of the n-grams of a run of code points."""
    h = np.zeros(len(letters), np.uint64)
    for order in range(1, ORDERS + 1):
        if len(letters) < order:
            return
        h = h[: len(letters) - order + 1] * np.uint64(0x110000) + letters[order - 1 :]
        flags[(((h + np.uint64(order)) * MIX) >> np.uint64(64 - BITS)).astype(np.intp)] = True


def presence(text: str) -> np.ndarray | None:
    """Flags of the slots of a text's n-grams; None without a letter."""
    table = _lower()
    flags = np.zeros(SLOTS, bool)
    found, last = False, np.full(1, 32, np.uint64)
    for at in range(0, len(text), PIECE):
        raw = text[at : at + PIECE].encode("utf-32-le", "surrogatepass")
        code = table[np.frombuffer(raw, np.uint32)].astype(np.uint64)
        letter = code > 0
        found = found or bool(letter.any())
        code[~letter] = 32
        before = np.concatenate([last[-1:], code[:-1]])
        # One blank for a run of others, and the end of the piece before once more.
        run = np.concatenate([last, code[(code != 32) | (before != 32)]])
        _mark(flags, run)
        last = run[-ORDERS:]
    if not found:
        return None
    if last[-1] != 32:
        _mark(flags, np.append(last, np.uint64(32)))
    return flags


@dataclass(frozen=True)
class Model:
    """Languages, bitmaps of the landmarks and coefficients, landmark by language."""

    langs: tuple[str, ...]
    bits: bytes
    coefficients: np.ndarray

    def landmarks(self) -> np.ndarray:
        return _unpacked(self.bits)


def _unpacked(bits: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8).reshape(-1, SLOTS // 8), axis=1)


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Kernels of the rows of two flag matrices."""
    norms = np.sqrt(np.outer(a.sum(axis=1, dtype=np.float64), b.sum(axis=1, dtype=np.float64)))
    return (a.astype(np.float32) @ b.astype(np.float32).T) / norms


def fit(langs: list[str], bits: list[bytes], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """The model of a sample, whose first rows are the landmarks."""
    names = tuple(sorted(set(langs)))
    flags = _unpacked(b"".join(bits))
    marks = flags[:landmarks]
    # Only slots of landmarks matter for a kernel with one; the norms need all.
    size = flags.sum(axis=1, dtype=np.float64)
    used = marks.any(axis=0)
    shared = flags[:, used].astype(np.float32)
    k = (shared @ shared[: len(marks)].T) / np.sqrt(np.outer(size, size[: len(marks)]))
    values, vectors = np.linalg.eigh(k[: len(marks)])
    solid = values > 1e-6 * values.max()
    root = vectors[:, solid] / np.sqrt(values[solid])
    features = k @ root
    target = np.where(np.array(langs)[:, None] == np.array(names)[None], 1.0, -1.0)
    # A language counts the same whatever its share of the sample.
    share = {n: langs.count(n) for n in names}
    weight = np.array([len(langs) / (len(names) * share[n]) for n in langs])[:, None]
    gram = features.T @ (weight * features) + ridge * len(langs) * np.eye(features.shape[1])
    return Model(names, b"".join(bits[:landmarks]), root @ np.linalg.solve(gram, features.T @ (weight * target)))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model | None:
    """The model of the rows given; None without a labelled text that holds a letter."""
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")
    ).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # The ids alone are ranked: a task keeps its first few of each language before the shuffle.
    ranked = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("k_place")).selectExpr(
        "*", "row_number() OVER (PARTITION BY lang ORDER BY k_place, doc_id) AS k_rank"
    )
    chosen = ranked.where(F.col("k_rank") <= PER_LANG).orderBy("k_rank", "lang", "doc_id").limit(SAMPLE)
    chosen = stored(chosen.groupBy("doc_id", "lang").agg(F.min("k_rank").alias("k_rank")), "sample")
    texts = rows.join(F.broadcast(chosen), ["doc_id", "lang"])  # at most SAMPLE ids
    once = texts.groupBy("k_rank", "lang", "doc_id").agg(F.min("text").alias("text"))
    bits = once.select("lang", "text", "k_rank", "doc_id").mapInArrow(_keyed, "lang string, k_bits binary, k_rank int")
    found = bits.collect()
    if not found:
        return None
    # Round robin over the languages, so that landmarks are of all of them.
    found.sort(key=lambda r: (r.k_rank, r.lang, r.k_bits))
    return fit([r.lang for r in found], [bytes(r.k_bits) for r in found])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = [np.packbits(presence(t.as_py())).tobytes() for t in batch["text"]]
        columns = [batch["lang"], pa.array(bits, pa.binary()), batch["k_rank"]]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "k_bits", "k_rank"])


def _scorer(model: Model | None, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = model.landmarks() if model else np.zeros((0, SLOTS), np.uint8)
        used = np.flatnonzero(marks.any(axis=0))
        norms = np.sqrt(marks.sum(axis=1, dtype=np.float64))
        right = np.ascontiguousarray(marks[:, used].T, np.float32)
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                yield scored(batch.slice(at, BATCH), used, norms, right)

    def scored(batch: pa.RecordBatch, used, norms, right) -> pa.RecordBatch:
        langs, scores = [UNKNOWN] * len(batch), np.zeros(len(batch))
        rows, left, sizes = [], np.zeros((len(batch), len(used)), np.float32), []
        for i, text in enumerate(batch["text"]):
            flags = presence(text.as_py()) if model and text.is_valid else None
            if flags is not None:
                left[len(rows)] = flags[used]
                rows.append(i)
                sizes.append(flags.sum())
        if rows:
            k = (left[: len(rows)] @ right) / np.sqrt(np.array(sizes, np.float64))[:, None] / norms
            values = np.round(k @ model.coefficients, 6)
            best = values.argmax(axis=1)
            for i, b in zip(rows, best, strict=True):
                langs[i] = model.langs[b]
            scores[rows] = np.clip((values.max(axis=1) + 1) / 2, 0, 1)
        columns = [batch.column(j) for j in range(batch.num_columns - 1)]
        columns += [pa.array(langs, pa.string()), pa.array(scores)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def predict(docs: DataFrame, model: Model | None, keys: list[str], text: str = "text") -> DataFrame:
    """The key columns of every row with lang_pred and score."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = docs.select(*(F.col(f"`{k}`") for k in keys), F.col(f"`{text}`").alias("text"))
    out = T.StructType([docs.schema[k] for k in keys])
    out = out.add("lang_pred", T.StringType()).add("score", T.DoubleType())
    return rows.mapInArrow(_scorer(model, to_arrow_schema(out)), out)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning."""
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score; learns from the rows that are not held out."""
    model = learn(docs.where(~held_out()))
    return predict(docs, model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
