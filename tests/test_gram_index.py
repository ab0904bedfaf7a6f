"""The q-gram index against comparing every line with every word."""

import random

import pytest
from pyspark.sql import functions as F

from cinderlog.operators import gram_index as G


def by_comparing(lines, words):
    return sorted(
        (a, n, w)
        for a, n, t in lines
        for b, w in {w for w in words if w[1] is not None}
        if a == b and None not in (a, t) and w in t
    )


def found(spark, lines, words, **options):
    ls = spark.createDataFrame(lines, "artifact_id int, line_no long, line string").repartition(4)
    ws = spark.createDataFrame(words, "artifact_id int, word string")
    got = G.contained(ls, ws, ["line_no"], **options)
    assert got.columns == ["artifact_id", "line_no", "line", "word"]
    return sorted((r.artifact_id, r.line_no, r.word) for r in got.collect())


def table(rng, n_lines, n_words, letters="abAé😀 .\\"):
    def text(n):
        return "".join(rng.choice(letters) for _ in range(n))

    lines = [(rng.choice([1, 1, 1, 2, 3]), i, text(rng.randint(0, 40))) for i in range(n_lines)]
    lines += [(1, n_lines, None), (1, n_lines + 1, ""), (None, 0, "abcd")]
    words = [(rng.choice([1, 1, 2, 4]), text(rng.choice([1, 2, 3, 4, 5, 6, 9]))) for _ in range(n_words)]
    cut = [t for _, _, t in lines if t and len(t) > 12]
    words += [(1, t[3:11]) for t in rng.sample(cut, 20)]
    words += [(1, None), (2, ""), words[0], (1, "x(?=y)"), (None, "abcd")]
    return lines, words


@pytest.mark.parametrize("few,broadcast_chars", [(10**6, 0), (0, 1 << 20), (0, 0), (30, 0)])
def test_equals_comparing_all(spark, few, broadcast_chars):
    lines, words = table(random.Random(few + broadcast_chars), 300, 120)
    options = {"few": few, "broadcast_chars": broadcast_chars}
    assert found(spark, lines, words, **options) == by_comparing(lines, words)


def test_no_words_no_lines(spark):
    assert found(spark, [(1, 1, "some line")], []) == []
    assert found(spark, [], [(1, "some")], few=0) == []
    assert found(spark, [(1, 1, "some line")], [(1, "other words")], few=0) == []


def test_grams_are_those_of_a_window(spark):
    texts = ["", "abc", "abcd", "aaaaaa", "x\ny\nz😀w", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", G.grams(F.col("t")).alias("g")).collect():
        want = {r.t[i : i + 4] for i in range(len(r.t) - 3)} if r.t else set()
        assert want <= set(r.g or []) and len(set(r.g or [])) == len(r.g or [])


def rows_of_joins(plan):
    """Rows that the joins of an executed plan made."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return rows_of_joins(plan.executedPlan())
    if "QueryStage" in name:
        return rows_of_joins(plan.plan())
    own = [plan.metrics().apply("numOutputRows").value()] if "Join" in name else []
    children = plan.children().iterator()
    while children.hasNext():
        own += rows_of_joins(children.next())
    return own


def test_pairs_grow_with_matches_only(spark):
    """Lines times words would be 40 million pairs."""
    lines = spark.range(20_000).selectExpr(
        "id DIV 20000 AS artifact_id", "id AS line_no", "concat('host', id % 997, ' wrote file-', id, '-end') AS line"
    )
    words = spark.range(2_000).selectExpr("id DIV 20000 AS artifact_id", "concat('file-', id * 7, '-') AS word")
    got = G.contained(lines, words, ["line_no"])
    assert len(got.collect()) == 2_000
    plan = got._jdf.queryExecution().executedPlan()
    assert 2_000 <= max(rows_of_joins(plan)) < 100_000
    assert "CartesianProduct" not in plan.toString() and "BroadcastNestedLoopJoin" not in plan.toString()


def test_texts_are_not_in_an_exchange(spark):
    lines, words = table(random.Random(5), 200, 50)
    ls = spark.createDataFrame(lines, "artifact_id int, line_no long, line string")
    ws = spark.createDataFrame(words, "artifact_id int, word string")
    got = G.contained(ls, ws, ["line_no"], few=0)
    got.count()
    for row in got._jdf.queryExecution().executedPlan().toString().split("\n"):
        assert "Exchange" not in row or "Broadcast" in row or "line#" not in row
