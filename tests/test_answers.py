"""Filters, extractions and aggregates, one plan at a time and in batches."""

import pytest
from pyspark.sql import functions as F

from cinderlog.functions import catalog as C
from cinderlog.functions.predicates import like
from cinderlog.operators import answers as A
from cinderlog.operators.answers import Plan

DISTINCT, TOP = C.AGGREGATES[1], C.AGGREGATES[2]

SAMPLE = [
    *[f"Failed password for root from 10.0.0.{i % 3} port 22 ssh2" for i in range(9)],
    *[f"Failed password for invalid user u{i} from 10.0.1.1 port 22" for i in range(4)],
    "message repeated 5 times: [ Failed password for root from 10.0.9.9 port 22 ssh2]",
    "Invalid user  0101 from 10.0.1.1",
    "Invalid user admin from 10.0.1.1",
    "Invalid user admin from 10.0.1.2",
    "input_userauth_request: invalid user admin [preauth]",
    "pam_unix(sshd:auth): check pass; user unknown",
    "pam_unix(sshd:auth): authentication failure; rhost=10.0.0.7",
    "pam_unix(sshd:auth): authentication failure; rhost=host.example.net",
    "Accepted password for u1 from 10.0.0.8 port 22 ssh2",
    "reverse mapping checking getaddrinfo failed - POSSIBLE BREAK-IN ATTEMPT!",
    None,
]


def one(df):
    return [tuple(r) for r in df.collect()]


def test_wrappers_are_left_out_of_counts(log_of):
    log = log_of(SAMPLE)
    assert one(A.answer(log, Plan("failed_password"))) == [(None, 13)]
    assert one(A.answer(log, Plan("all_events"))) == [(None, len(SAMPLE))]
    phrase = Plan("quoted_phrase", phrases=("message repeated",))
    assert one(A.answer(log, phrase)) == [(None, 1)]


def test_wrappers_stay_in_distinct_counts(log_of):
    plan = Plan("failed_password", "source_ip", DISTINCT)
    assert one(A.answer(log_of(SAMPLE), plan)) == [(None, 5)]
    approximate = A.answer(log_of(SAMPLE), plan, exact=False).first()["c"]
    assert approximate == 5


def test_extracts_and_empty_guard(log_of):
    log = log_of(SAMPLE)
    rhost = Plan("pam_auth_failure", "pam_rhost_ip", DISTINCT)
    assert one(A.answer(log, rhost)) == [(None, 1)]
    name = Plan("invalid_user", "invalid_username", TOP)
    assert one(A.answer(log, name)) == [("admin", 2)]
    names = Plan("invalid_user", "invalid_username", DISTINCT)
    assert one(A.answer(log, names)) == [(None, 2)]


def test_ties_go_to_the_smallest_value_and_null_can_win(log_of):
    plan = Plan("all_events", "event_id", TOP)
    assert one(A.answer(log_of(["a"] * 4, ["E2", "E1", "E1", "E2"]), plan)) == [("E1", 2)]
    assert one(A.answer(log_of(["a"] * 3, [None, None, "E1"]), plan)) == [(None, 2)]
    assert one(A.answer(log_of(["a"] * 4, [None, None, "E1", "E1"]), plan)) == [("E1", 2)]


def test_root_is_a_whole_word(log_of):
    log = log_of(
        [
            "session opened for user root by (uid=0)",
            "session opened for user rootkit by (uid=0)",
            "session opened for user roots by (uid=0)",
            "session opened for user root",
        ]
    )
    assert one(A.answer(log, Plan("session_opened", root=True))) == [(None, 2)]
    assert one(A.answer(log, Plan("session_opened"))) == [(None, 4)]


@pytest.mark.parametrize(
    "phrase,n",
    [
        ("100% done", 1),
        ("a_b", 1),
        ("back\\slash", 1),
        ("it's odd", 1),
        ("x; DROP TABLE t; --", 1),
        ("plain", 1),
        ("100", 2),
        ("done", 2),
        ("nomatch", 0),
    ],
)
def test_phrases_are_literal(log_of, phrase, n):
    rows = [
        "100% done",
        "100 done",
        "a_b",
        "axb",
        "back\\slash",
        "it's odd",
        "x; DROP TABLE t; --",
        "plain",
    ]
    plan = Plan("quoted_phrase", phrases=(phrase,))
    assert one(A.answer(log_of(rows), plan)) == [(None, n)]


def test_phrase_refines_the_filter(log_of):
    log = log_of(["user unknown", "check pass; user unknown"])
    plan = Plan("pam_user_unknown", phrases=("check pass; user unknown",))
    assert one(A.answer(log, plan)) == [(None, 1)]
    implied = Plan("pam_user_unknown", phrases=("User",))
    assert one(A.answer(log, implied)) == [(None, 2)]


def test_plans_outside_the_catalog_are_refused():
    for bad in (
        {"event_filter": "nope"},
        {"event_filter": "quoted_phrase"},
        {"event_filter": "failed_password", "root": True},
        {"aggregate": DISTINCT},
        {"event_filter": "accepted_login", "extract_field": "invalid_username", "aggregate": DISTINCT},
    ):
        with pytest.raises(ValueError):
            Plan(**bad)


def test_batch_equals_single_plans(spark, log_of):
    contents = SAMPLE[:-1]
    first = log_of(contents).withColumn("artifact_id", F.lit("a"))
    second = log_of(contents[::3]).withColumn("artifact_id", F.lit("b"))
    phrases = [
        Plan("quoted_phrase", phrases=("port 22",)),
        Plan("quoted_phrase", "source_ip", TOP, phrases=("port 22",)),
    ]
    plans = [*A.catalog_plans(), *phrases]
    got = {
        (r.artifact_id, r.plan_id): (r.v, r.c)
        for r in A.answer_all(first.unionByName(second), plans).collect()
    }
    checked = [p for p in plans if p.event_filter in ("invalid_user", "failed_password", "all_events", "quoted_phrase", "session_opened")]
    for name, log in (("a", first.cache()), ("b", second.cache())):
        for plan in checked:
            want = one(A.answer(log, plan))
            have = got.get((name, plan.plan_id))
            assert ([have] if have else []) == want, (name, plan.plan_id)


def test_batch_opens_more_groups_than_slots(log_of):
    words = [f"w{i} " for i in range(70)]
    log = log_of([w * (i % 3 + 1) for i, w in enumerate(words)])
    log = log.withColumn("artifact_id", F.lit(1))
    plans = [Plan("quoted_phrase", phrases=(w.strip() + " ",)) for w in words]
    plans += [Plan("quoted_phrase", "event_id", DISTINCT, phrases=(w,)) for w in words]
    got = A.answer_all(log, plans).collect()
    assert len(got) == 140 and all(r.c == 1 for r in got)


def test_questions_are_answered_together(spark, log_of):
    log = log_of(SAMPLE).withColumn("artifact_id", F.lit(1).cast("long"))
    failed, count = ["Failed password"], "count_rows"
    rows = [
        (1, 1, failed, True, "any_user", "none", count),
        (1, 2, failed, True, "any_user", "none", count),
        (1, 3, [*failed, "invalid user"], True, "any_user", "none", count),
        (1, 4, [], False, "any_user", "none", count),
        (1, 5, ["nothing"], True, "any_user", "none", count),
        (2, 6, failed, True, "any_user", "none", count),
        (1, 7, failed, False, "any_user", "source_ip", DISTINCT),
        (1, 8, ["Invalid user "], True, "any_user", "invalid_username", TOP),
        (1, 9, ["nothing"], True, "any_user", "event_id", TOP),
        (1, 10, ["nothing"], False, "any_user", "event_id", DISTINCT),
        (1, 11, ["session opened for user root"], True, "root", "none", count),
    ]
    # More distinct lists than fit one pack.
    rows += [(1, 100 + i, [f"u{i} "], True, "any_user", "none", count) for i in range(150)]
    wanted = spark.createDataFrame(
        rows,
        "artifact_id long, question_id long, words array<string>, skip_wrappers boolean, "
        "account_scope string, extract_field string, aggregate string",
    )
    log = log.unionByName(
        log_of(["session opened for user rootkit", "session opened for user root"]).withColumn(
            "artifact_id", F.lit(1).cast("long")
        )
    )
    got = {r.question_id: (r.v, r.c) for r in A.answer_questions(log, wanted.withColumn("reason", F.lit(None).cast("string"))).collect()}
    assert len(got) == len(rows)
    assert {i: got[i] for i in range(1, 12)} == {
        1: (None, 13),
        2: (None, 13),
        3: (None, 4),
        4: (None, len(SAMPLE) + 2),
        5: (None, 0),
        6: (None, 0),
        7: (None, 5),
        8: ("admin", 2),
        9: (None, None),
        10: (None, 0),
        11: (None, 1),
    }
    assert got[100] == (None, 1) and got[149] == (None, 0)


def test_plans_are_checked_once(spark, log_of):
    """What is wanted may be costly to find; both its uses read what was found."""
    found = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def skips(question):
        found.add(1)
        return question % 2 == 0

    log = log_of(["Failed password", "message repeated 2 times: [ Failed password]"])
    log = log.withColumn("artifact_id", F.lit(1).cast("long"))
    wanted = spark.range(40, numPartitions=2).select(
        F.lit(1).cast("long").alias("artifact_id"),
        F.col("id").alias("question_id"),
        F.array(F.lit("Failed password")).alias("words"),
        skips("id").alias("skip_wrappers"),
        F.lit("any_user").alias("account_scope"),
        F.lit("none").alias("extract_field"),
        F.lit("count_rows").alias("aggregate"),
        F.lit(None).cast("string").alias("reason"),
    )
    got = {r.question_id: r.c for r in A.answer_questions(log, wanted).collect()}
    assert got == {i: 2 - (i % 2 == 0) for i in range(40)} and found.value == 40


def test_like_has_no_escape_character(spark):
    df = spark.createDataFrame([("a\\b",), ("a_b",), ("axb",)], "s string")
    assert df.where(like(F.col("s"), "a\\b")).count() == 1
    assert df.where(like(F.col("s"), "a_b")).count() == 3


def test_filters_reach_the_scan(spark, tmp_path, log_of):
    log_of(SAMPLE).write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    plan = A.answer(log, Plan("session_opened", root=True))._jdf.queryExecution().toString()
    assert "StringContains(Content,session opened for user root)" in plan
    assert "EventTemplate" not in plan[plan.index("ReadSchema") :]
