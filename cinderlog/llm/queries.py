"""The registered queries of this subpackage and their oracle SQL.

Each query applies its operator with production parameters to the whole table and derives the
columns of its contract from the operator's results.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlog.llm import (
    bpe,
    chat,
    codes,
    decontam,
    interaction,
    langid,
    linededup,
    neardup,
    pii,
    quality,
    shared,
    tokencount,
    urlfilter,
    warc,
)

WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"
#: The secret of a deployment comes from its own key store; this one only makes results repeatable.
PII_KEY = b"a key for tests"
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    # Workers of a local session find the package wherever the session was started.
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (root, path)))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.classes(_read(spark, sf_dir, "documents"), percent=85)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op2_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("b_doc").alias("doc_id"),
        F.col("b_item").alias("item_id"),
        F.col("b_covered").alias("covered_tokens"),
        F.col("b_n").cast("long").alias("item_tokens"),
    )


def op3_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.drop_lines(_read(spark, sf_dir, "documents"))
    dropped = F.coalesce("l_drop", F.array().cast("array<int>"))
    return out.select(
        "doc_id",
        F.col("l_n_lines").alias("n_lines"),
        F.size(dropped).cast("long").alias("n_dropped"),
        dropped.alias("dropped_lines"),
        "text",
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    results = ("t_n_tokens", "t_ids_sha256", "t_decoded_sha256")
    out = bpe.encode(docs, public_tokenizers.path(WORD_BPE), keep_text=False, results=results)
    return out.withColumnsRenamed({r: r.removeprefix("t_") for r in results})


def op5_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, rules).drop("url")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    columns = (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", "lost_chars",
    )
    return out.select("doc_id", *(F.col(f"q_{c}").alias(c) for c in columns))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame(
        [(-1, 0, "user", hard), (-1, 1, "assistant", hard)], turns.schema
    )
    return chat.digests(chat.segments(turns.union(more)))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = shared.qualified(spark, shared.folder(spark, "warc"))
    manifest = warc.write(_read(spark, sf_dir, "pages"), root)
    return warc.read(manifest, root, payloads=False).drop("url")


def op9_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts with an empty cache, so that every distinct text is encoded here."""
    docs = _read(spark, sf_dir, "documents")
    return tokencount.counts(
        docs, public_tokenizers.path(PIECE_BPE), tokencount.new_cache(spark)
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.replace(docs, PII_KEY)
    return out.withColumnsRenamed({"p_entities": "n_entities", "p_kinds": "kinds"})


def op11_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(_read(spark, sf_dir, "embeddings"))
    out = codes.label_errors(coded).drop("label")
    return out.withColumn("codebooks_sha256", F.lit(codes.digest(books)))


def op13_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_neardup, op2_decontam, op3_linededup, op4_bpe, op5_urlfilter, op6_quality, op7_chat,
        op8_warc, op9_tokencount, op10_pii, op11_interaction, op12_codes, op13_langid, pipeline,
    )
}

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)

_URL = f"""
WITH rules(rh, rp, rv) AS (VALUES {_RULES}),
u AS (SELECT page_id, url, instr(coalesce(url, ''), '://') AS k FROM pages),
h AS (SELECT page_id, CASE WHEN k > 0 THEN substr(url, k + 3) ELSE '' END AS rest FROM u),
p AS (SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host,
             regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM h)
SELECT page_id, host, path,
       (SELECT rh || rp FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
        ORDER BY length(rh || rp) DESC LIMIT 1) AS rule,
       coalesce((SELECT rv FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
        ORDER BY length(rh || rp) DESC LIMIT 1), 'allow') AS verdict
FROM p
"""

_CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
x AS (
  SELECT *, CASE WHEN contains(text, '<|im_start|>') OR contains(text, '<|im_end|>') OR regexp_matches(text, '<\\+\|')
                 THEN len(regexp_extract_all(text, '<\\*\|')) ELSE 0 END AS more FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(role) + length(text) + more + 24) AS BIGINT) AS formatted_chars
FROM x GROUP BY conv_id
"""

_WARC = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
         sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS top FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top <> page_id THEN top END AS refers_to
FROM m
"""

_KNOWN = " OR ".join(f"contains(low, '{p}')" for p in quality.BOILERPLATE)


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, [x FOR x IN regexp_split_to_array(text, '[ \\t-\\r]+') IF x <> ''] AS w,
             string_split(text, chr(10)) AS lines FROM d),
z AS (SELECT doc_id, unnest(w[1:len(w) - 2]) AS a, unnest(w[2:len(w) - 1]) AS b, unnest(w[3:len(w)]) AS c,
             unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3),
k AS (SELECT doc_id, list(i) AS places FROM z GROUP BY doc_id, a, b, c HAVING count(*) > 1),
p AS (SELECT doc_id, unnest(places) AS i FROM k),
r AS (SELECT doc_id, count(DISTINCT place) AS n_repeat_words
      FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM p) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(lines) AS line FROM w),
f AS (SELECT doc_id, line, lower(line) AS low FROM l WHERE regexp_matches(line, '[^ \\t-\\r]')),
b AS (SELECT doc_id, line, NOT regexp_matches(line, {_quoted(quality.SENTENCE)})
             OR regexp_matches(line, {_quoted(quality.DENSE)})
             OR regexp_matches(low, {_quoted(quality.NAVIGATION)}) OR {_KNOWN} AS bad FROM f),
s AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines,
             sum(CASE WHEN bad THEN length(regexp_replace(line, '[ \\t-\\r]+', '', 'g')) ELSE 0 END) AS lost
      FROM b GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w.w) AS n_words, length(array_to_string(w.w, '')) AS word_chars,
             length(regexp_replace(w.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(s.n_dup_lines, 0) AS n_dup_lines, coalesce(r.n_repeat_words, 0) AS n_repeat_words,
             coalesce(s.lost, 0) AS lost_chars
      FROM w LEFT JOIN s USING (doc_id) LEFT JOIN r USING (doc_id)),
v AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT} * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND 100 * lost_chars <= {quality.MAX_LOST} * word_chars AS kept,
       CAST(lost_chars AS BIGINT) AS lost_chars
FROM v
"""

# Every order is run here, row by row, where the operator works on 32 numbers of each part.
_INTERACTION = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
                  [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+') IF x <> ''] AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT doc_id, part, length(text) AS n, len(w) AS n_words, len(list_distinct(w)) AS n_distinct,
             length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, regexp_matches(text, '[#$%&*|]') AS symbol,
             coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS copy FROM d),
f AS (SELECT c.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             CASE WHEN n_words < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * n_distinct < 50 * n_words THEN 'B' ELSE '' END
             || CASE WHEN 100 * n_upper > 2 * n THEN 'C' ELSE '' END || CASE WHEN symbol THEN 'D' ELSE '' END
             || CASE WHEN copy THEN 'E' ELSE '' END AS fails FROM c LEFT JOIN l ON c.doc_id = l.doc_id),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, CAST(step AS INTEGER), 1) AS own FROM o, range(1, 6) r(step)),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
      FROM f GROUP BY part, fails),
t AS (SELECT part, filter_order, step, own, n, good, toxic, fails, contains(fails, own) AS hit,
             coalesce(list_min([instr(filter_order, y) FOR y IN string_split(fails, '') IF y <> '']), 6) AS gone
      FROM g, s),
r AS (SELECT part, filter_order, step, own,
             coalesce(sum(n) FILTER (gone > step), 0) AS kept,
             coalesce(sum(n) FILTER (gone = step), 0) AS removed,
             coalesce(sum(n) FILTER (hit AND gone < step), 0) AS redundant,
             coalesce(sum(n) FILTER (fails = own), 0) AS unique_fails,
             coalesce(sum(good) FILTER (gone = step), 0) AS good_lost,
             coalesce(sum(toxic) FILTER (gone = step), 0) AS toxic_lost
      FROM t GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""

def _assigned(books: str) -> str:
    """Entry and distance of each part by comparing it with all entries of its position."""
    return f"""
SELECT vec_id, p, v, e, dist FROM (
  SELECT q.vec_id, q.p, q.v, b.e, d.dist,
         row_number() OVER (PARTITION BY q.vec_id, q.p ORDER BY d.dist, b.e) AS best
  FROM parts q JOIN {books} b ON b.p = q.p,
       LATERAL (SELECT CAST(list_sum([(q.v[i] - b.v[i]) * (q.v[i] - b.v[i]) FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS dist) d)
WHERE best = 1"""


def _replaced(books: str, assigned: str) -> str:
    """Each entry replaced by the floored means of its parts; unused entries stay."""
    return f"""
SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM {books} b LEFT JOIN (
  SELECT p, e, list(mean ORDER BY i) AS v FROM (
    SELECT p, e, i, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS mean
    FROM (SELECT p, e, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM {assigned}) GROUP BY p, e, i)
  GROUP BY p, e) m ON m.p = b.p AND m.e = b.e"""


_CODES = f"""
WITH whole AS (
  SELECT vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS n FROM embeddings
  WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, p, n[p * len(n) // {codes.PARTS} + 1:(p + 1) * len(n) // {codes.PARTS}] AS v
  FROM whole, range({codes.PARTS}) r(p)),
b0 AS MATERIALIZED (
  SELECT p, e, v FROM parts JOIN (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM whole ORDER BY vec_id LIMIT {codes.ENTRIES}) USING (vec_id)),
a0 AS MATERIALIZED ({_assigned("b0")}),
b1 AS MATERIALIZED ({_replaced("b0", "a0")}),
a1 AS MATERIALIZED ({_assigned("b1")}),
b2 AS MATERIALIZED ({_replaced("b1", "a1")}),
a2 AS MATERIALIZED ({_assigned("b2")}),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2),
coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(dist) AS BIGINT) AS error
          FROM a2 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN whole USING (vec_id), digest
"""

ORACLE = {
    "op5_urlfilter": _URL,
    "op6_quality": _QUALITY,
    "op7_chat": _CHAT,
    "op8_warc": _WARC,
    "op11_interaction": _INTERACTION,
    "op12_codes": _CODES,
}
