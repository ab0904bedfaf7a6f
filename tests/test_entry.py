"""The registered queries against their oracle SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from cinderlog.functions import catalog as C
from cinderlog.functions import rules as R
from cinderlog.plans import oracle, registry

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
QUERIES, ORACLE = registry.QUERIES, oracle.ORACLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    yield con
    con.close()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert {f"rule_{r}" for r in R.REPORTS} <= set(QUERIES)
    assert {f"flt_{f}" for f in C.FILTERS} <= set(QUERIES)


def test_everything_is_registered():
    assert QUERIES.items() <= entry.queries().items()
    assert ORACLE.items() <= entry.oracle_sql().items()


def test_entry(spark):
    assert entry.entry(spark).count() == 250


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    result = duck.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = [tuple(row[names.index(c)] for c in columns) for row in result.fetchall()]
    have = [tuple(r[c] for c in columns) for r in got.collect()]
    assert sorted(have, key=repr) == sorted(want, key=repr)
