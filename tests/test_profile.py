"""Profiles against plain Python, and what they shuffle."""

import random

import pytest
from pyspark.sql import functions as F

from cinderlog.operators import profile as P

SCHEMA = "a int, key string, s string, n long, d double, t timestamp"


def rows_of(rng, n):
    return [
        (
            rng.choice([1, 1, 2, None]),
            rng.choice(["x", "y", None]),
            rng.choice([None, "", "Z", "é", "z" * 100, "same", f"v{rng.randrange(10**6)}"]),
            rng.choice([None, rng.randrange(-50, 10**9)]),
            rng.choice([0.5, -1e30, 7.0]),
            None,
        )
        for _ in range(n)
    ]


def plain(df, k, keys):
    texts = [c for c in df.columns if c not in keys]
    listed = df.select(*keys, *(F.col(c).cast("string").alias(c) for c in texts)).collect()
    out = {}
    for r in listed:
        for c in texts:
            own = out.setdefault((*(r[x] for x in keys), c), set())
            if r[c] is not None:
                own.add(r[c])
    cut = {key: sorted(v, key=str.encode)[:k] for key, v in out.items()}
    return {key: [x if len(x) <= P.CUT else x[: P.CUT] + "..." for x in v] for key, v in cut.items()}


@pytest.mark.parametrize("keys", [[], ["key"], ["a", "key"]])
@pytest.mark.parametrize("held", [P.HELD_BYTES, 1000])
def test_equals_plain(spark, monkeypatch, keys, held):
    monkeypatch.setattr(P, "HELD_BYTES", held)
    df = spark.createDataFrame(rows_of(random.Random(len(keys)), 700), SCHEMA).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = P.profile(df, 3, keys).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = plain(df, 3, keys)
    have = {(*(r[x] for x in keys), r.column_name): r.examples for r in got}
    assert have == want
    assert len(have) == len(got)


def test_a_task_sends_few_values(spark):
    """Unique values, equal values and values in falling order."""
    df = spark.range(200_000, numPartitions=8).selectExpr("uuid() AS u", "'same' AS e", "1e9 - id AS f", "id % 7 AS key")
    plans = []
    for keys, most in (([], 8 * 3 * 4), (["key"], 8 * 3 * 4 * 7)):
        got = P.profile(df if keys else df.drop("key"), 4, keys)
        assert got.count() == 3 * (7 if keys else 1)
        plans.append((got._jdf.queryExecution().executedPlan(), most))

    def written(plan):
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            return written(plan.executedPlan())
        if "QueryStage" in name:
            return written(plan.plan())
        own = [plan.metrics().apply("shuffleRecordsWritten").value()] if name == "Exchange" else []
        children = plan.children().iterator()
        while children.hasNext():
            own += written(children.next())
        return own

    for plan, most in plans:
        assert written(plan) and max(written(plan)) <= most


def test_empty(spark):
    got = P.profile(spark.createDataFrame([], SCHEMA)).collect()
    assert sorted((r.column_name, r.examples) for r in got) == sorted((c, []) for c in "a key s n d t".split())
