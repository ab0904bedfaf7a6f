"""Readers, sinks and the stream."""

import gzip

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from cinderlog.operators import family
from cinderlog.operators import triage as T
from cinderlog.operators.answers import Plan, answer
from cinderlog.sources import logs, sinks, tool_text
from cinderlog.streaming.triage import stream_texts, stream_verdicts

HEADER = "LineId,Date,Day,Time,Component,Pid,Content,EventId,EventTemplate\n"
ROW = '{i},Dec,10,06:55:46,LabSZ,242,"{text}",E{i},t\n'


def write_log(path, texts):
    rows = "".join(ROW.format(i=i, text=t.replace('"', '""')) for i, t in enumerate(texts, 1))
    path.write_text(HEADER + rows)


def test_log_keeps_its_types_and_quotes(spark, tmp_path):
    write_log(tmp_path / "a.csv", ['say "hi", now', "Failed password"])
    log = logs.read_log(spark, str(tmp_path / "a.csv"))
    row = log.orderBy("LineId").first()
    assert (row.Content, row.Time, row.LineId) == ('say "hi", now', "06:55:46", 1)
    assert row.artifact_id.endswith("/a.csv")
    types = dict(logs.log_columns(spark, str(tmp_path / "a.csv")))
    assert (types["Time"], types["LineId"], types["Pid"], types["Content"]) == ("string", "bigint", "bigint", "string")


def test_glob_and_refusals(spark, tmp_path):
    write_log(tmp_path / "a.csv", ["Failed password"])
    write_log(tmp_path / "b.csv", ["Failed password", "x"])
    log = logs.read_log(spark, str(tmp_path / "*.csv"))
    assert log.groupBy("artifact_id").count().count() == 2
    assert answer(log, Plan("failed_password")).first().c == 2
    with pytest.raises(ValueError):
        logs.read_log(spark, str(tmp_path))
    with pytest.raises(AnalysisException):
        logs.read_log(spark, str(tmp_path / "*.nothing"))


def test_headers_of_all_kinds_in_one_glob(spark, tmp_path):
    row = '7,"Failed password for ""x"", from 1.2.3.4",E1,t'
    (tmp_path / "minimal.csv").write_text("LineId,Content,EventId,EventTemplate\n" + row + "\n")
    (tmp_path / "extra.csv").write_text(
        'Host,EventId,Content,LineId,EventTemplate\nh,E1,"sshd Failed password, twice",8,t\n'
    )
    write_log(tmp_path / "full.csv", ["sshd: Failed password", "x"])
    (tmp_path / "other.csv").write_text("a,b\n1,sshd Failed password\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "bare.csv").write_text("LineId,Content,EventId,EventTemplate\n")
    read = logs.read_logs(spark, str(tmp_path / "*.csv"))
    got = {r.artifact_id.rsplit("/", 1)[1]: r for r in family.scan(read).collect()}
    assert {n: r.family is not None for n, r in got.items()} == {
        "minimal.csv": True, "extra.csv": True, "full.csv": True, "other.csv": False, "empty.csv": False, "bare.csv": False,
    }
    assert {n: r.n_failed_password for n, r in got.items() if r.family} == {"minimal.csv": 1, "extra.csv": 1, "full.csv": 1}
    by_id = {r.LineId: r for r in read.collect()}
    assert by_id[7].Content == 'Failed password for "x", from 1.2.3.4' and by_id[8].EventId == "E1"


def test_empty_texts_stay_artifacts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("psscan pslist False")
    (tmp_path / "b.txt").write_text("")
    path = str(tmp_path / "*.txt")
    whole = T.priority(T.triage_texts(tool_text.read_texts(spark, path)))
    cut = T.piece_verdicts(tool_text.read_lines(spark, path))
    for verdicts in (whole, cut):
        got = {r.artifact_id[-5:]: r.verdict for r in verdicts.collect()}
        assert got == {"a.txt": "malicious", "b.txt": "undetermined"}


def test_any_number_of_headers(spark, tmp_path):
    """Every file has a header of its own."""
    folder = tmp_path / "many"
    folder.mkdir()
    want, no_family = {}, set()
    for i in range(5000):
        names = [f"x{i}", "Content", 'odd "name", ' + str(i), "LineId", "EventId", "EventTemplate"]
        names = names[i % 6 :] + names[: i % 6]
        if i % 100 == 7:
            names.remove("EventId")
            no_family.add(f"{i}.csv")
        if i % 100 == 8:
            names.append("Content")
        cells = [f'"{n}, ""{i}"""' if n == "Content" else str(i) for n in names]
        quoted = ['"' + n.replace('"', '""') + '"' if '"' in n else n for n in names]
        bom = "\ufeff" if i % 50 == 0 else ""
        (folder / f"{i}.csv").write_text(bom + ",".join(quoted) + "\n" + ",".join(cells) + "\n")
        want[i] = f'Content, "{i}"'
    rows = logs.read_logs(spark, str(folder / "*.csv")).collect()
    assert len(rows) == 5000
    read = {r.LineId: r for r in rows if r.LineId is not None}
    assert len(read) == 4900 and all(r.Content == want[i] and r.EventId == str(i) for i, r in read.items())
    assert {r.artifact_id.rsplit("/", 1)[1] for r in rows if not r.has_header} == no_family


def test_a_file_per_artifact(spark, tmp_path):
    rows = [(i % 700, i, f'say "{i}", now' if i % 3 else None) for i in range(3500)] + [(None, -1, "none"), (-4, -2, "two\nlines")]
    df = spark.createDataFrame(rows, "artifact long, LineId long, Content string")
    df = df.withColumns({"EventId": F.lit("E1"), "EventTemplate": F.lit("t")})
    names = ["Content", "EventId", "LineId", "EventTemplate"]
    for _ in range(2):  # a repeated task changes nothing
        assert logs.write_logs(df, str(tmp_path / "out"), "artifact", names) == 701
    assert len(list((tmp_path / "out").glob("*/*"))) == 701 and not list((tmp_path / "out").glob("*/.*"))
    (own,) = (tmp_path / "out").glob("*/artifact=-4.csv")
    assert own.read_text() == 'Content,EventId,LineId,EventTemplate\n"two\nlines",E1,-2,t\n'
    group = "files of logs"
    spark.sparkContext.setJobGroup(group, group)
    read = logs.read_logs(spark, str(tmp_path / "out" / "*" / "artifact=[0-9]*.csv"))
    # The 700 files are looked up by few tasks; scans take 32 of them to a task.
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    assert 0 < max(s.numTasks for s in stages if s) < 100
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    got = {(int(r.artifact_id.rsplit("=", 1)[1][:-4]), r.LineId, r.Content) for r in read.collect()}
    assert got == set(rows[:3500]) and spark.conf.get(logs.LISTING) == "10000"


def test_files_met_by_shuffling_give_the_same(spark, tmp_path):
    row = '7,"Failed password for ""x"", from 1.2.3.4",E1,t'
    (tmp_path / "a.csv").write_text("LineId,Content,EventId,EventTemplate\n" + row + "\n+8,,\"\",t,more\nx,y\n")
    (tmp_path / "b.csv").write_text('EventId,Content,LineId,"EventTemplate"\n\nE1,"open quote,7\n')
    (tmp_path / "c.csv").write_text("")
    path = str(tmp_path / "*.csv")
    few = sorted(logs.read_logs(spark, path, max_files=0).collect(), key=repr)
    assert few == sorted(logs.read_logs(spark, path).collect(), key=repr)
    a = [tuple(r)[2:] for r in few if r.artifact_id.endswith("a.csv")]
    assert sorted(a, key=repr) == sorted(
        [(7, 'Failed password for "x", from 1.2.3.4', "E1", "t"), (8, None, None, "t"), (None, "y", None, None)], key=repr
    )
    assert {r.has_header for r in few if r.artifact_id.endswith("c.csv")} == {False}


def _odd_logs(folder):
    head = "LineId,Content,EventId,EventTemplate"
    texts = {
        "a/plain.csv": f"{head}\n7,x,E1,t\n\n8,y,E2,t",
        "a/ends.txt": f"{head}\r\n1,x,E1,t\r2,y,,t\r\n\r\n3,z,E3,t\n",
        "a/mark.CSV": f"\ufeff{head}\n4,\ufeffx,E1,t\n",
        "a/marks.csv": f"\ufeff\ufeff{head}\n5,x,E1,t\n",
        "a/late.log": f"\n{head}\n6,x,E1,t\n",
        "b/bare.csv": f"{head}\n\n",
        "b/blank.csv": "\n",
        "b/none.csv": "",
        "b/other.csv": "a,b\n1,x\n",
        "b/name": "EventId,Content,LineId,EventTemplate\nE9,x,9,t\n",
        "b/_hidden.csv": f"{head}\n1,x,E1,t\n",
    }
    for name, text in texts.items():
        (folder / name).parent.mkdir(exist_ok=True)
        (folder / name).write_bytes(text.encode())
    (folder / "b/bytes.csv").write_bytes(head.encode() + b"\n10,\xff\xe2\x82\n11,\xe2\x82,E1,t\n")
    (folder / "b/packed.csv.gz").write_bytes(gzip.compress(f"{head}\n12,x,E1,t\n13,y,E1,t\n".encode()))


def test_whole_and_split_files_give_the_same(spark, tmp_path):
    _odd_logs(tmp_path)
    path = str(tmp_path / "*" / "*")
    split = sorted(logs.read_logs(spark, path, small=0).collect(), key=repr)
    assert len({r.artifact_id for r in split}) == 12
    assert {r.LineId for r in split} >= {*range(1, 6), *range(7, 14)}
    for options in ({}, {"small": 60}, {"max_files": 0}):
        assert sorted(logs.read_logs(spark, path, **options).collect(), key=repr) == split
    folders = logs.read_logs(spark, [str(tmp_path / "a"), str(tmp_path / "b")], named="*.csv").collect()

    def of_csv(rows):  # an empty file's name in a glob has other slashes
        return sorted(repr((r.artifact_id.rsplit("/", 2)[1:], *r[1:])) for r in rows if r.artifact_id.endswith(".csv"))

    assert of_csv(folders) == of_csv(split) and len(folders) == 9


def test_small_files_are_opened_once(spark, tmp_path):
    """What a file held is written when it is first read, and not asked for again."""
    _odd_logs(tmp_path)
    path = str(tmp_path / "*" / "*.csv")
    usual = spark.conf.get(logs.OPEN_COST)
    want = sorted(logs.read_logs(spark, path).collect(), key=repr)
    read = logs.read_logs(spark, path)
    for file in tmp_path.glob("*/*.csv"):
        file.unlink()
    assert sorted(read.collect(), key=repr) == want and len(want) == 9
    assert spark.conf.get(logs.OPEN_COST) == usual


def test_header_names(spark):
    headers = ["a,b", ",a,,", '"a,""b""",c', '"x"y,z', "", 'a,"']
    df = spark.createDataFrame([(h,) for h in headers], "h string")
    got = [r.n for r in df.select(logs.header_names(F.col("h")).alias("n")).collect()]
    assert got == [["a", "b"], ["", "a", "", ""], ['a,"b"', "c"], ['"x"y', "z"], [""], ["a", '"']]


def test_numbering_shuffles_no_text(spark, tmp_path):
    with open(tmp_path / "big.txt", "w") as f:
        for i in range(400_000):
            f.write(f"line {i} " + "x" * 120 + "\n")
    read = tool_text.read_lines(spark, str(tmp_path / "big.txt"))
    read.count()
    plan = read._jdf.queryExecution().executedPlan().toString()
    for line in plan.split("\n"):
        if "Exchange" in line and "Broadcast" not in line:
            assert "line" not in line
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert read.selectExpr("max(line_no) - min(line_no)", "count(distinct line_no)").first() == (399_999, 400_000)


def test_records_over_several_lines(spark, tmp_path):
    (tmp_path / "m.csv").write_text('LineId,Content,EventId,EventTemplate\n1,"two\nlines",E1,t\n2,x,,t\n')
    log = logs.read_log(spark, str(tmp_path / "m.csv"), logs.MINIMAL_SCHEMA, multiline=True)
    rows = log.orderBy("LineId").collect()
    assert [r.Content for r in rows] == ["two\nlines", "x"] and rows[1].EventId is None


def test_csv_in_a_column(spark):
    df = spark.createDataFrame([(1, 'a "b", c')], "i long, s string")
    line = df.select(logs.to_csv_line("i", "s").alias("line"))
    back = line.select(logs.parse_csv_lines(F.col("line"), "i bigint, s string").alias("r")).first().r
    assert (back.i, back.s) == (1, 'a "b", c')


def test_whole_texts(spark, tmp_path):
    (tmp_path / "t.txt").write_bytes(b"a\r\nb\rc\n")
    row = tool_text.read_texts(spark, str(tmp_path / "t.txt")).first()
    assert row.text == "a\nb\nc\n" and row.artifact_id.endswith("/t.txt")


def test_lines_are_numbered_across_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 50) for i in range(4000)]
    (tmp_path / "big.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "small.txt").write_text("one\n\nthree")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        assert spark.read.text(str(tmp_path / "big.txt")).rdd.getNumPartitions() > 4
        ways = [{}, {"block_bytes": 1 << 14}, {"block_bytes": 50_000}, {"max_splits": 0, "block_bytes": 1}]
        reads = [tool_text.read_lines(spark, str(tmp_path / "*.txt"), **w) for w in ways]
        rows, *others = [r.collect() for r in reads]
        assert all(sorted(o) == sorted(rows) for o in others)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with pytest.raises(Exception, match="cut differently"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        try:
            reads[0].collect()
            tool_text.read_lines(spark, str(tmp_path / "*.txt")).count()
            late = tool_text.read_lines(spark, str(tmp_path / "*.txt"))
            spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
            late.selectExpr("max(line_no)").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    big = sorted((r.line_no, r.line) for r in rows if r.artifact_id.endswith("big.txt"))
    assert big == list(enumerate(lines))
    small = sorted((r.line_no, r.line) for r in rows if r.artifact_id.endswith("small.txt"))
    assert small == [(0, "one"), (1, ""), (2, "three")]


def test_evidence_is_never_written_over(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "t.txt").write_text("7045\n")
    triaged = T.triage_texts(tool_text.read_texts(spark, str(tmp_path / "in" / "t.txt")))
    for bad in (tmp_path / "in", tmp_path, tmp_path / "in" / "t.txt", tmp_path / "out" / ".." / "in"):
        with pytest.raises(ValueError):
            sinks.write_reports(triaged, str(bad))
    sinks.write_reports(triaged, str(tmp_path / "out"))
    row = spark.read.json(str(tmp_path / "out")).first()
    assert row.verdict == "suspicious" and row.report.startswith("VERDICT: SUSPICIOUS")
    with pytest.raises(AnalysisException):
        sinks.write_reports(triaged, str(tmp_path / "out"))
    assert (tmp_path / "in" / "t.txt").read_text() == "7045\n"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("psscan pslist False\r\n7045")
    (tmp_path / "in" / "b.txt").write_text("quiet")
    verdicts = stream_verdicts(stream_texts(spark, str(tmp_path / "in")))
    query = verdicts.writeStream.format("memory").queryName("verdicts").outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = {r.artifact_id[-5:]: r.verdict for r in spark.table("verdicts").collect()}
    assert got == {"a.txt": "malicious", "b.txt": "undetermined"}
