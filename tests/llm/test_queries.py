"""The registered queries and the pipeline on the smallest tables."""

import duckdb
import public_tokenizers
import pytest
import tokenizers
from brute import cleaned, components, leaks, line_keys, words
from test_lines import expected, needed

import __spark_entry__ as entry
import corpus_pipeline
from cinderlog.llm import queries

TABLES = "documents embeddings labels pages benchmark conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    yield con
    con.close()


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} | {"pipeline"} == {q.split("_")[0] for q in queries.QUERIES}
    assert queries.QUERIES.items() <= entry.queries().items()
    assert queries.ORACLE.items() <= entry.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracles(spark, duck, sf, name):
    got = queries.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    result = duck.execute(queries.ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = [tuple(row[names.index(c)] for c in columns) for row in result.fetchall()]
    have = [tuple(r[c] for c in columns) for r in got.collect()]
    assert sorted(have, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE) - {"pipeline"}))
def test_other_queries_run(spark, sf, name):
    rows = queries.QUERIES[name](spark, sf).count()
    assert rows == (3 if name == "op2_decontam" else 200)


def texts_of(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_pipeline_stage_by_stage(spark, sf):
    """Each stage against a plain version of it, on its own input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    first, lines, near, contaminated, last = (f for _, f in corpus_pipeline.STAGES)
    a = first(spark, docs, sf).cache()
    left = {d: cleaned(t) for d, t in texts_of(docs).items()}
    assert texts_of(a) == {d: t for d, t in left.items() if t is not None}
    b = lines(spark, a, sf).cache()
    drop = expected(texts_of(a), line_keys, needed)
    left = {
        d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop[d]) for d, t in texts_of(a).items()
    }
    assert b.columns == docs.columns
    assert texts_of(b) == {d: t for d, t in left.items() if not drop[d] or words(t)}
    c = near(spark, b, sf).cache()
    want, _ = components(texts_of(b), 80)
    assert {r.doc_id for r in c.collect()} == {d for d, k in want.items() if d == k}
    d = contaminated(spark, c, sf).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {i for i, _ in leaks(list(texts_of(c).items()), items)}
    assert {r.doc_id for r in d.collect()} == {r.doc_id for r in c.collect()} - bad
    e = last(spark, d, sf).collect()
    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    for r in e:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        assert (list(r.ids), r.n_tokens) == (ids, len(ids))
    assert {r.doc_id for r in e} == {r.doc_id for r in d.collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == {r.doc_id for r in e}
