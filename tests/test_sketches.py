"""Answers from sketches against exact ones, merged and in one pass."""

import pytest

from cinderlog.operators import answers as A
from cinderlog.operators import sketches as K
from cinderlog.plans import views as V


def rows(df):
    return {(r.artifact_id, r.plan_id): (r.v, r.c) for r in df.collect()}


@pytest.fixture(scope="module")
def log(spark):
    return V.auth_logs(spark, "/root/testdata/sf0.001")


def test_merged_equals_one_pass_and_small_ones_are_exact(spark, log, tmp_path):
    plans = A.catalog_plans()
    whole = K.sketch(log, plans)
    parts = [log.where(f"LineId % 3 = {i}") for i in range(3)]
    for i, part in enumerate(parts):  # one table per load, as stored
        K.sketch(part, plans).write.parquet(str(tmp_path / str(i)))
    stored = [spark.read.parquet(str(tmp_path / str(i))) for i in (2, 0, 1)]
    one, merged = rows(K.estimates(whole)), rows(K.estimates(K.merge(stored)))
    assert one == merged
    assert rows(K.estimates(K.merge([K.merge(stored[:2]), stored[2]]))) == one
    exact = {k: v for k, v in rows(A.answer_all(log, plans)).items() if k in one}
    # Artifacts of this size hold few values: sketches lose nothing.
    assert exact.keys() == one.keys() and len(one) > 100
    tops = {k for k in one if k[1].split("/")[2] == A.C.AGGREGATES[2]}
    assert all(one[k][1] == exact[k][1] for k in one if k in tops or k[1].split("/")[2] == A.C.AGGREGATES[0])
    # A tie of more than sixteen values may name another of them.
    assert sum(one[k] != exact[k] for k in tops) <= len(tops) // 20
    assert all(abs(one[k][1] - exact[k][1]) <= max(1, 0.03 * exact[k][1]) for k in one)


def test_error_of_many_values(spark):
    n = 60_000
    log = spark.range(n).selectExpr(
        "1 AS artifact_id", "id AS LineId", "'E1' AS EventId", "'t' AS EventTemplate",
        "concat('Invalid user ', IF(id % 10 = 0, 'root', concat('u', id)), ' from 1.2.3.4') AS Content",
    )
    plans = [A.Plan("invalid_user", "invalid_username", a) for a in A.C.AGGREGATES[1:]] + [A.Plan("invalid_user")]
    got = rows(K.estimates(K.merge([K.sketch(log.where("LineId % 2 = 0"), plans), K.sketch(log.where("LineId % 2 = 1"), plans)])))
    by = {k[1].split("/")[2]: v for k, v in got.items()}
    distinct = n - n // 10 + 1
    assert abs(by["count_distinct_values"][1] - distinct) <= 3 * 0.0082 * distinct
    value, count = by["most_frequent_value_and_count"]
    assert value == "root" and abs(count - n // 10) <= 3.5 / K.TRACKED * n
    assert by["count_rows"] == (None, n)


def test_nulls_and_no_lines(spark):
    schema = "artifact_id long, LineId long, Content string, EventId string, EventTemplate string"
    log = spark.createDataFrame([(1, 1, "x", None, "t"), (None, 2, None, "E1", "t")], schema)
    plans = [A.Plan("all_events", "event_id", a) for a in A.C.AGGREGATES[1:]]
    got = rows(K.estimates(K.sketch(log, plans)))
    assert got == rows(A.answer_all(log, plans))
    assert got[1, plans[0].plan_id] == (None, 0) and got[1, plans[1].plan_id] == (None, 1)
    assert got[None, plans[1].plan_id] == ("E1", 1)
    assert K.estimates(K.sketch(log.limit(0), plans)).count() == 0
    with pytest.raises(ValueError):
        K.sketch(log, [])
