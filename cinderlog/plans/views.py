"""Log and tool-output views over the driver's ``events`` table.

The texts are fixed so that every filter, extraction and rule meets matching and non-matching
lines; volume, users and event kinds come from the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# The auth-log view. The same text runs on Spark and on the oracle.
AUTH_LOG_SQL = """
SELECT event_id AS LineId, user_id AS Pid, 'LabSZ' AS Component,
 CASE event_type
  WHEN 'error' THEN CASE WHEN event_id % 7 = 0
     THEN concat('message repeated 3 times: [ Failed password for root from ', concat('10.0.', user_id % 4, '.', event_id % 16), ' port 22 ssh2]')
     ELSE concat('Failed password for root from ', concat('10.0.', user_id % 4, '.', event_id % 16), ' port 22 ssh2') END
  WHEN 'signup' THEN concat('Invalid user  u', user_id % 20, ' from ', concat('10.0.', user_id % 4, '.', event_id % 16))
  WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN concat('Accepted password for u', user_id % 20, ' from ', concat('10.0.', user_id % 4, '.', event_id % 16), ' port 22 ssh2')
     WHEN event_id % 3 = 0 THEN 'pam_unix(sshd:session): session opened for user root by (uid=0)'
     WHEN event_id % 3 = 1 THEN 'pam_unix(sshd:session): session opened for user rootkit by (uid=0)'
     ELSE 'pam_unix(sshd:session): session opened for user alice by (uid=0)' END
  WHEN 'view' THEN CASE WHEN event_id % 3 = 0 THEN 'pam_unix(sshd:auth): check pass; user unknown'
     ELSE concat('pam_unix(sshd:auth): authentication failure; logname= uid=0 rhost=', concat('10.0.', user_id % 4, '.', event_id % 16), ' user=root') END
  ELSE concat('reverse mapping checking getaddrinfo for h', user_id % 9, ' [', concat('10.0.', user_id % 4, '.', event_id % 16), '] failed - POSSIBLE BREAK-IN ATTEMPT!') END AS Content,
 CASE WHEN event_id % 11 = 0 THEN NULL ELSE concat('E', event_id % 27) END AS EventId,
 event_type AS EventTemplate FROM events
"""

# The lines tool output is made of, and how many line numbers exist.
TOOL_LINES = (
    r"INFO service heartbeat ok",
    r"svchost.exe started normally",
    r"lsass.exe 0x1f0a0000 0x1f0a1fff VadS PAGE_EXECUTE_READWRITE",
    r"powershell.exe 0x2a0000 0x2a1fff VadS PAGE_EXECUTE_READWRITE clrjit.dll",
    r"Image: C:\Windows\System32\wscript.exe",
    r"ParentImage: C:\Program Files\Microsoft Office\WINWORD.EXE",
    r"powershell -nop -w hidden -enc SQBFAFgAIAAoAE4AZQB3AC0A",
    r"203.0.113.7 443 ESTABLISHED 42 certutil.exe",
    r"20.190.1.2 443 ESTABLISHED 77 svchost.exe",
    r"EventID 4625 Type 3 0xC000006D",
    r"EventID 4625 Type 2 0xC000006A",
    r"EventID 4624 Logon Type 2",
    r"EventID 4624 Logon Type 3 NTLM",
    r"EventID 4648 explicit credentials",
    r"EventID 7045 service installed",
    r"EventID 4698 TaskName: \Updater2",
    r"EventID 4698 TaskName: \GoogleUpdateTask C:\Program Files\Google SYSTEM",
    r"shell.aspx .\inetpub\wwwroot\aspnet_client",
    r"EventID 1102 audit log cleared",
    r"EventID 4720 account created",
    r"EventID 4732 Domain Admins",
    r"EventID 4104 IEX (New-Object Net.WebClient)",
    r"EventID 4769 0x17",
    r"HKCU\Software\Microsoft\Windows\CurrentVersion\Run = powershell -x",
    r"ImagePath C:\Temp\svc.exe",
    r"C:\Users\u\AppData\Local\Temp\drop1.exe and C:\Users\u\Downloads\b.dll",
    r"windows.psxview pslist False",
    r"capa: inject process; keylogger",
    r"MZ header at 0x0",
    r"e9 01 02 03 04 90 90",
    r"pipe MSSE-1234-server",
    r"PPID pstree services.exe 600 powershell.exe",
    r"Image: C:\Windows\System32\cmd.exe",
    r"ParentImage: C:\inetpub\w3wp.exe",
    r"cscript.exe //b lure.vbs",
    r"EventID 4625 Type 10 0xC000006D",
    r"push rbp mov rbp, rsp",
    r"EventID 4625 Type 3 user a",
    r"EventID 4625 Type 3 user b",
    r"EventID 4625 Type 10 user c",
)
TOOL_CYCLE = 47
ARTIFACT_LINES = 4
BIG_ARTIFACT_LINES = 2500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as artifacts."""
    documents = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("artifact_id"), "text"
    )
    return documents


def auth_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``LineId, Pid, Component, Content, EventId, EventTemplate``."""
    return spark.sql(
        AUTH_LOG_SQL.replace("FROM events", "FROM {events}"),
        events=table(spark, sf_dir, "events"),
    )


def auth_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The auth log as many artifacts: one log per process id."""
    return auth_log(spark, sf_dir).withColumn("artifact_id", F.col("Pid"))


def tool_line() -> "F.Column":
    """The line of an event, a template or a numbered noise line."""
    number = (F.col("event_id") * 7 + F.col("user_id")) % TOOL_CYCLE
    known = F.array(*[F.lit(t) for t in TOOL_LINES])
    return F.coalesce(
        F.try_element_at(known, (number + 1).cast("int")),
        F.concat(F.lit("noise line "), F.col("event_id").cast("string")),
    )


def tool_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``artifact_id, text``: four lines per artifact."""
    events = table(spark, sf_dir, "events")
    lines = events.select(
        (F.col("event_id") - F.col("event_id") % ARTIFACT_LINES).alias("artifact_id"),
        "event_id",
        tool_line().alias("line"),
    )
    joined = F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY event_id)")
    return lines.groupBy("artifact_id").agg(joined.alias("text"))


def big_tool_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``artifact_id, line_no, line``: long artifacts, given as numbered lines."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.expr(f"event_id DIV {BIG_ARTIFACT_LINES}").alias("artifact_id"),
        (F.col("event_id") % BIG_ARTIFACT_LINES).alias("line_no"),
        tool_line().alias("line"),
    )


def _oracle_line() -> str:
    cases = " ".join(
        f"WHEN {i} THEN '{t}'" for i, t in enumerate(TOOL_LINES)
    )
    return (
        f"CASE (event_id * 7 + user_id) % {TOOL_CYCLE} {cases} "
        "ELSE concat('noise line ', event_id) END"
    )


TOOL_OUTPUT_SQL = (
    f"SELECT event_id - event_id % {ARTIFACT_LINES} AS artifact_id, "
    f"string_agg({_oracle_line()}, chr(10) ORDER BY event_id) AS text "
    "FROM events GROUP BY 1"
)
BIG_TOOL_SQL = (
    f"SELECT event_id // {BIG_ARTIFACT_LINES} AS artifact_id, "
    f"string_agg({_oracle_line()}, chr(10) ORDER BY event_id) AS text "
    "FROM events GROUP BY 1"
)

# Logs of several kinds, one kind per artifact. The same text runs on both engines.
MIXED_LOGS_SQL = f"""
SELECT a.Pid AS artifact_id, a.LineId,
 CASE a.Pid % 4
  WHEN 1 THEN CASE a.LineId % 3
     WHEN 0 THEN concat('Receiving block blk_', a.LineId, ' src: /10.0.0.1:5000')
     WHEN 1 THEN concat('Accepted block blk_', a.LineId, ' from 10.0.0.1')
     ELSE 'authentication failure talking to namenode' END
  WHEN 2 THEN CASE a.LineId % 2
     WHEN 0 THEN 'pam_unix(login:auth): authentication failure; rhost=1.2.3.4'
     ELSE concat('session opened for user root by (uid=0) at 12:00:0', a.LineId % 10) END
  WHEN 3 THEN CASE a.LineId % 5
     WHEN 0 THEN 'Dec 10 06:55:46 Failed password for root from 2001:db8:0:0:0:0:0:1 port 22 ssh2'
     WHEN 1 THEN CASE WHEN a.Pid % 8 = 3 THEN 'Failed password for root from 2001:db8::1 port 22 ssh2'
        ELSE 'Failed password for root from 10.0.0.1 port 22 ssh2' END
     WHEN 2 THEN 'link 00:1b:44:11:3a:b7 up'
     ELSE concat('connection at 06:55:4', a.LineId % 10) END
  ELSE a.Content END AS Content,
 a.EventId, a.EventTemplate FROM ({AUTH_LOG_SQL}) a
"""


def mixed_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of several kinds, ``artifact_id`` being one of them."""
    mixed = spark.sql(
        MIXED_LOGS_SQL.replace("FROM events", "FROM {events}"),
        events=table(spark, sf_dir, "events"),
    )
    return mixed


# Questions of an analyst, and the plan that goes with each (filter, field, aggregate).
QUESTIONS = (
    ("What number of failed password lines were written?", "failed_password", "none", "count_rows"),
    ("What number of failed password lines were written?", "invalid_user", "none", "count_rows"),
    ("What number of failed password lines were written?", "nope", "none", "count_rows"),
    ("What is the number of different source addresses?", "all_events", "source_ip", "count_distinct_values"),
    ("Which source address turns up most?", "all_events", "source_ip", "most_frequent_value_and_count"),
    ("Which source address turns up most?", "all_events", "event_id", "most_frequent_value_and_count"),
    ("Which source address turns up most?", "all_events", "pam_rhost_ip", "most_frequent_value_and_count"),
    ("Number of accepted logins, please", "accepted_login", "none", "count_rows"),
    ("What is the total of log events?", "all_events", "event_id", "count_rows"),
    ("How many unique rhost values do the lines carry?", "all_events", "pam_rhost_ip", "count_distinct_values"),
    ("How many unique rhost values do the lines carry?", "all_events", "source_ip", "count_distinct_values"),
    ("How many unique event templates are in use?", "all_events", "event_id", "count_distinct_values"),
    ("How many login attempts hit a non-existent user?", "invalid_user", "none", "count_rows"),
    ("Which one source host sent the most lines, and what is its tally?", "all_events", "source_ip", "most_frequent_value_and_count"),
    ("How many lines carry 'POSSIBLE BREAK-IN' in them?", "possible_break_in", "none", "count_rows"),
    ("How many root 'session opened' lines are there?", "session_opened", "none", "count_rows"),
    ("What does 'check pass; user unknown' add up to?", "pam_user_unknown", "none", "count_rows"),
    ("lines that hold ‘10.0.2.7’ somewhere", "quoted_phrase", "none", "count_rows"),
    ("sessions opened as root", "session_opened", "none", "count_rows"),
    ("Which invalid username is tried most, and what is its tally?", "invalid_user", "invalid_username", "most_frequent_value_and_count"),
    ("Which remote host turns up most, and what is its tally?", "all_events", "pam_rhost_ip", "most_frequent_value_and_count"),
    ("What is the tally of \"message repeated\" lines?", "quoted_phrase", "none", "count_rows"),
    ("How many lines say 'Failed password'?", "invalid_user", "none", "count_rows"),
    ("How many lines say 'Failed password'?", "quoted_phrase", "none", "count_rows"),
    ("accepted lines that hold 'port 22'", "accepted_login", "none", "count_rows"),
    ("tally the events apart from the failed password ones", "all_events", "none", "count_rows"),
    ("never count the \"Failed password\" lines", "all_events", "none", "count_rows"),
    ("tally of sessions opened for carla", "session_opened", "none", "count_rows"),
    ("events of the account bmoreno", "all_events", "none", "count_rows"),
    ("failed password lines from 198.51.100.7", "failed_password", "none", "count_rows"),
    ("events that mention host.example.net", "all_events", "none", "count_rows"),
    ("failed password lines within 12 hours", "failed_password", "none", "count_rows"),
    ("events until the final logon", "all_events", "none", "count_rows"),
    ("failed password lines grouped by source", "failed_password", "none", "count_rows"),
    ("accepted logins that weren't made at the desk", "accepted_login", "none", "count_rows"),
    ("events that name D:\\logs\\bmoreno.txt", "all_events", "none", "count_rows"),
    ("events that name /srv/data/audit", "all_events", "none", "count_rows"),
    ("accepted logins on a weekend", "accepted_login", "none", "count_rows"),
    ("sessions opened at midnight", "session_opened", "none", "count_rows"),
    ("failed password and accepted lines taken as one", "failed_password", "none", "count_rows"),
    ("failed password lines versus the rest", "failed_password", "none", "count_rows"),
    ("Which source address turns up least?", "all_events", "source_ip", "most_frequent_value_and_count"),
    ("what share of the logins was accepted?", "accepted_login", "none", "count_rows"),
    ("How many different addresses are in it?", "all_events", "source_ip", "count_distinct_values"),
    ("How many different usernames do accepted lines hold?", "accepted_login", "invalid_username", "count_distinct_values"),
    ("failed password lines from carla", "failed_password", "none", "count_rows"),
    ("sessions that timed out", "session_opened", "none", "count_rows"),
    ("password guessing attempts", "failed_password", "none", "count_rows"),
    ("Which source hosts sent failed password lines?", "failed_password", "source_ip", "count_distinct_values"),
    ("Which source hosts sent failed password lines?", "failed_password", "source_ip", "most_frequent_value_and_count"),
    ("source addresses with logins", "all_events", "none", "count_rows"),
    ("sessions opened under carla's login", "session_opened", "none", "count_rows"),
    ("accepted logins that used a certificate", "accepted_login", "none", "count_rows"),
    ("failed password lines of the corporate range", "failed_password", "none", "count_rows"),
    ("Which source hosts sent the most failed password lines?", "failed_password", "source_ip", "most_frequent_value_and_count"),
    ("What is the number of different values?", "all_events", "none", "count_rows"),
    ("What is the number of different values?", "all_events", "source_ip", "count_distinct_values"),
    ("Which value is commonest?", "all_events", "event_id", "most_frequent_value_and_count"),
    ("show the different source addresses", "all_events", "source_ip", "count_distinct_values"),
    ("events, i.e. lines of any kind, etc.", "all_events", "none", "count_rows"),
    ("lines that hold 'alpha' and 'omega'", "quoted_phrase", "none", "count_rows"),
    ("failed password lines of root", "failed_password", "none", "count_rows"),
    ("How many source addresses are there?", "all_events", "source_ip", "most_frequent_value_and_count"),
    ("unquoted words only", "quoted_phrase", "none", "count_rows"),
    ("number of different source addresses", "all_events", "none", "count_distinct_values"),
    ("Which source address turns up most?", "all_events", "none", "count_rows"),
    ("Which source address turns up most?", "all_events", "source_ip", "count_distinct_values"),
)
# Plans that are not of the right shape, for 4 of 77 questions.
BAD_PLANS = (
    "not a plan",
    '{"event_filter": "all_events"}',
    '{"event_filter": ["all_events"], "extract_field": "none", "aggregate": "count_rows"}',
    '{"event_filter": "all_events", "extract_field": "none", "aggregate": "count_rows", "extra": "x"}',
)


def _question_sql() -> str:
    def literal(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    asked = " ".join(f"WHEN {i} THEN {literal(q[0])}" for i, q in enumerate(QUESTIONS))
    plans = " ".join(
        "WHEN {} THEN {}".format(
            i,
            literal(
                f'{{"event_filter": "{q[1]}", "extract_field": "{q[2]}", "aggregate": "{q[3]}"}}'
            ),
        )
        for i, q in enumerate(QUESTIONS)
    )
    bad = " ".join(f"WHEN {i} THEN {literal(b)}" for i, b in enumerate(BAD_PLANS))
    n = f"(event_id * 5 + user_id) % {len(QUESTIONS)}"
    return (
        f"SELECT event_id AS question_id, user_id AS artifact_id, CASE {n} {asked} END AS question, "
        f"CASE WHEN event_id % 77 < 4 THEN CASE event_id % 77 {bad} END ELSE CASE {n} {plans} END END AS plan "
        "FROM events"
    )


QUESTIONS_SQL = _question_sql()


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``question_id, artifact_id, question, plan``: one question per event."""
    n = (F.col("event_id") * 5 + F.col("user_id")) % len(QUESTIONS)
    rows = F.array(
        *[
            F.struct(
                F.lit(q[0]).alias("question"),
                F.lit(
                    f'{{"event_filter": "{q[1]}", "extract_field": "{q[2]}", "aggregate": "{q[3]}"}}'
                ).alias("plan"),
            )
            for q in QUESTIONS
        ]
    )
    bad = F.array(*[F.lit(b) for b in BAD_PLANS])
    picked = F.get(rows, n.cast("int"))
    spoilt = F.get(bad, (F.col("event_id") % 77).cast("int"))
    return (
        table(spark, sf_dir, "events")
        .select("event_id", "user_id", picked.alias("q"), spoilt.alias("bad"))
        .select(
            F.col("event_id").alias("question_id"),
            F.col("user_id").alias("artifact_id"),
            "q.question",
            F.coalesce("bad", "q.plan").alias("plan"),
        )
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``question_id, pos, sql, result_json, err``; question 0 holds a third of the rows."""
    return table(spark, sf_dir, "events").selectExpr(
        "CASE WHEN event_id % 3 = 0 THEN 0L ELSE 1L + event_id DIV 8 END AS question_id",
        "event_id AS pos",
        "concat('SELECT ', user_id % 9) AS sql",
        "CASE user_id % 9 WHEN 0 THEN '0' WHEN 1 THEN '[]' WHEN 2 THEN 'null' WHEN 3 THEN '[[]]' "
        "WHEN 4 THEN '[\"10.0.0.1\",3]' WHEN 5 THEN '[\"10.0.0.1\", 3]' WHEN 6 THEN '\"\"' "
        "ELSE cast(user_id % 5 AS string) END AS result_json",
        "CASE WHEN event_type IN ('error', 'signup') THEN concat('Binder Error: ', event_type) END AS err",
    )


# The same candidates on the oracle.
CANDIDATES_ORACLE = """
SELECT CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 + event_id // 8 END AS question_id,
 event_id AS pos, concat('SELECT ', user_id % 9) AS sql,
 CASE user_id % 9 WHEN 0 THEN '0' WHEN 1 THEN '[]' WHEN 2 THEN 'null' WHEN 3 THEN '[[]]'
  WHEN 4 THEN '["10.0.0.1",3]' WHEN 5 THEN '["10.0.0.1", 3]' WHEN 6 THEN '""'
  ELSE CAST(user_id % 5 AS VARCHAR) END AS result_json,
 CASE WHEN event_type IN ('error', 'signup') THEN concat('Binder Error: ', event_type) END AS err
FROM events
"""
