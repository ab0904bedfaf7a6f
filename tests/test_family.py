"""Family detection, vocabulary, IPv6 and profile."""

from pyspark.sql import functions as F

from cinderlog.functions import catalog as C
from cinderlog.operators import family
from cinderlog.operators.profile import profile

LOGS = {
    "auth": ["Failed password for root from 10.0.0.1 port 22 ssh2", "noise"],
    "blocks": ["Receiving block blk_1 src: /10.0.0.1:5000"],
    "collision": [
        "Accepted block blk_1 from 10.0.0.1",
        "authentication failure talking to namenode",
    ],
    "pam": ["pam_unix(login:auth): authentication failure; rhost=1.2.3.4"],
    "pam2": [
        "pam_unix(sshd:auth): authentication failure; rhost=1.2.3.4",
        "session opened for user root by (uid=0)",
    ],
    "v6": ["Failed password for root from 2001:db8::1 port 22 ssh2"],
    "v6long": ["Failed password for root from 2001:db8:0:0:0:0:0:1 port 22"],
    "v6hidden": ["06:55:46 Failed password from 2001:db8:0:0:0:0:0:1"],
    "v4": [
        "Dec 10 06:55:46 Failed password for root from 10.0.0.1 port 22 ssh2",
        "session opened for user root by (uid=0) at 12:00:01",
    ],
    "nulls": [None],
}


def _logs(log_of):
    parts = [
        log_of(lines).withColumn("artifact_id", F.lit(name)) for name, lines in LOGS.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def test_scan(log_of):
    got = {r.artifact_id: r for r in family.scan(_logs(log_of)).collect()}
    known = {k for k, r in got.items() if r.family == C.FAMILY}
    assert known == {"auth", "pam", "pam2", "v6", "v6long", "v6hidden", "v4"}
    assert {k for k, r in got.items() if r.has_ipv6} == {"v6", "v6long"}
    assert set(got["pam2"].present_filters) == {
        "all_events",
        "quoted_phrase",
        "pam_auth_failure",
        "session_opened",
    }
    assert got["blocks"].reason == family.NO_FAMILY and got["auth"].reason is None
    assert got["nulls"].n_lines == 1 and got["nulls"].present_filters == ["all_events", "quoted_phrase"]


def test_other_header_is_no_family(spark):
    df = spark.createDataFrame([("t", "a.exe", "sshd")], "TimeCreated string, Image string, Content string")
    assert not family.has_header(df)
    got = family.scan(df.withColumn("artifact_id", F.lit(1))).first()
    assert got.family is None and got.reason == family.NO_FAMILY


def test_plans_an_artifact_cannot_answer(spark, log_of):
    scanned = family.scan(_logs(log_of))
    plans = spark.createDataFrame(
        [
            ("auth", "failed_password", "none"),
            ("auth", "session_opened", "none"),
            ("v6", "all_events", "source_ip"),
            ("v6", "all_events", "event_id"),
            ("blocks", "all_events", "none"),
            ("missing", "all_events", "none"),
        ],
        "artifact_id string, event_filter string, extract_field string",
    )
    got = [r.artifact_reason for r in family.restrict_plans(plans, scanned).orderBy("artifact_id", "event_filter", "extract_field").collect()]
    assert got == [
        None,
        "the artifact contains no 'session_opened' lines",
        family.NO_FAMILY,
        family.NO_FAMILY,
        None,
        family.IPV6_REASON,
    ]


def test_profile(spark):
    rows = [(i, f"name{i % 3}", "x" * 95 if i else None, None) for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, name string, long string, empty string")
    got = {r.column_name: r for r in profile(df).collect()}
    assert got["id"].examples == ["0", "1", "10", "100"] and got["id"].column_type == "bigint"
    assert got["name"].examples == ["name0", "name1", "name2"]
    assert got["long"].examples == ["x" * 90 + "..."]
    assert got["empty"].examples == []


def test_profile_bound_from_the_head_drops_nothing_needed(spark):
    # The head holds only large values; the smallest come last.
    rows = [(f"z{i:05d}",) for i in range(9000)] + [("a",), ("b",)]
    df = spark.createDataFrame(rows, "v string").coalesce(1)
    assert profile(df).first().examples == ["a", "b", "z00000", "z00001"]
    keyed = profile(df.withColumn("k", F.lit(1)), keys=["k"])
    assert keyed.first().examples == ["a", "b", "z00000", "z00001"]
