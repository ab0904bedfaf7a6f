"""Verdicts of artifacts that arrive in pieces."""

import random

from cinderlog.operators import triage as T
from cinderlog.streaming import triage as ST
from test_triage import POOL

SCHEMA = "artifact_id long, piece_no long, text string, own string"
COLUMNS = ["artifact_id", "verdict", "priority_rule", "priority_indicator", "priority_evidence"]


def pieces_of(spark, texts, size):
    rows = [(i, n, line) for i, t in enumerate(texts) for n, line in enumerate(t.split("\n"))]
    lines = spark.createDataFrame(rows, "artifact_id long, line_no long, line string")
    return [tuple(r) for r in T.pieces(lines, size, 64).select(*SCHEMA.replace(" long", "").replace(" string", "").split(", ")).collect()]


def batch_verdicts(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "artifact_id long, text string")
    return sorted(tuple(r) for r in T.priority(T.triage_texts(df)).select(*COLUMNS).collect())


def some_texts(seed, n):
    rng = random.Random(seed)
    return ["\n".join([*rng.choices(POOL, k=rng.randint(1, 50)), "end"]) for _ in range(n)]


def test_on_a_table_equals_whole_texts(spark):
    texts = some_texts(3, 120)
    cut = spark.createDataFrame(pieces_of(spark, texts, 5), SCHEMA)
    got = sorted((tuple(r) for r in ST.verdict_updates(cut).select(*COLUMNS).collect()), key=repr)
    assert got == sorted(batch_verdicts(spark, texts), key=repr)


def test_any_order_over_batches_and_a_restart(spark, tmp_path):
    """Pieces come shuffled, in several files; the query is stopped half way and started again."""
    texts = some_texts(9, 30)
    rows = pieces_of(spark, texts, 4)
    random.Random(1).shuffle(rows)
    arriving, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    (tmp_path / "in").mkdir()
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(arriving + "/*")
        query = ST.write_verdicts(stream, out, checkpoint, availableNow=True)
        query.awaitTermination()
        return {r.artifact_id: r for r in ST.current_verdicts(spark, out).collect()}

    try:
        third = len(rows) // 3
        for k in range(2):
            part = rows[k * third : (k + 1) * third]
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{arriving}/{k}")
        half = run()
        assert set(half) == {r[0] for r in rows[: 2 * third]}
        spark.createDataFrame(rows[2 * third :], SCHEMA).coalesce(1).write.parquet(f"{arriving}/2")
        whole = run()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = {r[0]: r for r in batch_verdicts(spark, texts)}
    assert {i: tuple(r[c] for c in COLUMNS) for i, r in whole.items()} == want
    assert len({r.batch for r in spark.read.parquet(out).collect()}) >= 3
    # A verdict once given changes where later pieces say more, and only there.
    assert any(half[i].verdict != whole[i].verdict or half[i].priority_rule != whole[i].priority_rule for i in half)
    counts = {r.verdict: r.n_artifacts for r in T.verdict_counts(ST.current_verdicts(spark, out)).collect()}
    assert sum(counts.values()) == len(texts)
