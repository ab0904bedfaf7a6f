"""Votes and cross-checks."""

from pyspark.sql import functions as F

from cinderlog.operators import votes as V

SCHEMA = "question_id long, pos long, sql string, result_json string, err string"


def test_majority(spark):
    rows = [
        (1, 0, "a", "1", None),
        (1, 1, "b", "2", None),
        (1, 2, "c", "2", None),
        (1, 3, "d", None, "boom"),
        (2, 0, "a", "5", None),  # a tie goes to the first seen
        (2, 1, "b", "7", None),
        (3, 0, "a", "null", None),
        (3, 1, "b", "[[]]", None),
        (4, 1, "b", None, "second"),
        (4, 0, "a", None, None),
        (4, 2, "c", None, "third"),
        (5, 0, "a", "0", None),  # zero, empty text and empty list are answers
        (6, 0, "a", '""', None),
        (7, 0, "a", "[]", None),
        (8, 0, "a", '[["x", 1]]', None),
        (8, 1, "b", '[["x",1]]', None),
        (8, 2, "c", "1.0", None),
    ]
    got = {r.question_id: r for r in V.majority(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[1].result, got[1].sql, got[1].votes, got[1].ok) == ("2", "b", "2/4", True)
    assert (got[2].result, got[2].sql, got[2].votes) == ("5", "a", "1/2")
    assert (got[3].ok, got[3].error, got[3].votes) == (False, V.NOTHING_RAN, "0/2")
    assert (got[4].ok, got[4].error) == (False, "second")
    assert [got[i].result for i in (5, 6, 7)] == ["0", '""', "[]"]
    assert (got[8].result, got[8].sql, got[8].votes) == ('[["x",1]]', "a", "2/3")
    assert all(r.error is None for r in got.values() if r.ok)


def test_keys(spark):
    df = spark.createDataFrame(
        [('{"b": 1, "a": [1, 2]}',), ('{"a":[1,2],"b":1}',), ("1",), ("1.0",), ("[oops",)], "s string"
    )
    keys = [r.k for r in df.select(V.result_key(F.col("s")).alias("k")).collect()]
    assert keys[0] == keys[1] and keys[2:] == ["1", "1.0", "[oops"]
    table = spark.createDataFrame([(None, 3), ("x", 4)], "v string, c long")
    assert [r.k for r in table.select(V.row_key("v", "c").alias("k")).collect()] == [
        '{"v":null,"c":3}',
        '{"v":"x","c":4}',
    ]


def test_unanimous(spark):
    rows = [
        (1, 0, "p", None), (1, 1, "p", None),
        (2, 0, "p", None), (2, 1, "q", None),
        (3, 0, "p", None),
        (4, 0, "p", None), (4, 1, None, "second bad"), (4, 2, None, "third bad"),
    ]
    df = spark.createDataFrame(rows, "question_id long, pos long, plan string, reason string")
    got = {r.question_id: (r.plan, r.reason) for r in V.unanimous(df).collect()}
    assert got == {
        1: ("p", None),
        2: (None, "router votes disagreed"),
        3: (None, "fewer than 2 votes"),
        4: (None, "invalid plan: second bad"),
    }


def test_cross_check(spark):
    schema = "question_id long, result string, ok boolean"
    mine = spark.createDataFrame([(i, "13", True) for i in range(4)], schema)
    other = spark.createDataFrame([(0, "13", True), (1, "99", True), (2, None, False)], schema)
    got = {r.question_id: (r.outcome, r.agree, r.executed) for r in V.cross_check(mine, other).collect()}
    assert got == {
        0: ("AGREE", True, True),
        1: ("DISAGREE", False, True),
        2: ("NOT CHECKED", None, False),
        3: ("NOT CHECKED", None, False),
    }


def test_repeated_positions_nulls_and_large_positions(spark):
    rows = [
        (1, 10**12, "b", "2", None), (1, 10**12, "a", "2", None), (1, 5, "z", "1", "failed"),
        (1, 6, "y", "1", None), (1, 7, "x", "3", None), (1, 7, "w", None, "bad"),
        (None, 0, "a", "1", None), (None, None, "b", "1", None),
        (2, None, "a", "9", None), (2, None, "b", None, "boom"),
        (3, None, "a", None, "first"), (3, None, "b", None, "also"),
    ]
    got = {r.question_id: r for r in V.majority(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 4
    assert (got[1].result, got[1].sql, got[1].votes) == ("2", "a", "2/6")
    assert (got[None].result, got[None].sql, got[None].votes) == ("1", "a", "2/2")
    assert (got[2].result, got[2].sql, got[2].votes) == ("9", "a", "1/2")
    assert (got[3].ok, got[3].error) == (False, "first")


def test_raw_rows_are_never_sorted_to_be_counted(spark):
    """Votes are counted by hash aggregates with numbers in their buffers."""
    rows = [(i % 5, i, f"s{i}", str(i % 3), None) for i in range(100)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "result_json AS plan", "err AS reason")
    for found in (V.majority(df), V.unanimous(df)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        counting = [x.strip(" :+-*") for x in plan.split("\n") if "partial_count(1)" in x]
        assert counting and all(x.startswith("HashAggregate") for x in counting)
