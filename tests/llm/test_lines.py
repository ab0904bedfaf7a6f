"""Line dedup with the thresholds of the query, against plain Python."""

import pytest
from brute import line_keys

from cinderlog.llm import linededup


def literal(key):
    """The tokens of a template besides variable fields."""
    tokens = key[1:] if key[0] == "whole" else key[2:]
    return sum(t != "<*>" for t in tokens) - (key[0] != "whole")


def expected(texts, keys, needed):
    """doc_id to the numbers of its lines that recur, each template in `needed(key)` texts."""
    seen = {}
    for d, t in texts.items():
        for no, line in enumerate((t or "").split("\n")):
            for k in keys(line):
                seen.setdefault(k, {}).setdefault(t, {}).setdefault(d, []).append(no)
    out = {d: set() for d in texts}
    for k, places in seen.items():
        if len(places) < needed(k):
            continue
        first = min(min(docs) for docs in places.values())
        for docs in places.values():
            for d, numbers in docs.items():
                out[d] |= set(numbers) - ({min(numbers)} if first in docs else set())
    return {d: sorted(n) for d, n in out.items()}


def needed(key):
    return 2 if literal(key) >= 12 else 6


def dropped(df):
    return {r.doc_id: list(r.l_drop or []) for r in linededup.drop_lines(df).collect()}


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_tables_with_the_thresholds_of_the_query(spark, size):
    df = spark.read.parquet(f"/root/testdata/sf{size}/documents.parquet")
    want = expected({r.doc_id: r.text for r in df.collect()}, line_keys, needed)
    assert dropped(df) == want and any(want.values())


def test_long_lines_recur_from_two_texts_on(docs):
    long = " ".join(f"{w}word" for w in "abcdefghijklmnopqrstuvwxyz")
    short = "A short line of seven words here"
    fields = "On 1 2 3 4 5 6 7 8 9 there are few words"
    texts = [f"Own {w} text\n{long}\n{short}\n{fields}" for w in ("red", "blue", "green")]
    texts.append("Other\n" + long.replace("lword", "other"))
    assert dropped(docs(texts)) == {0: [], 1: [1], 2: [1], 3: [1]}


def test_work_is_linear_in_a_texts_lines(docs):
    """Twice the lines take about twice as long, also if most of them go."""
    import time

    def run(n):
        shared = "\n".join(f"this line number {'x' * (i % 50)}{'y' * (i // 50 % 50)}{'z' * (i // 2500)} stands in both texts" for i in range(n))
        df = docs([f"{shared}\nfirst", f"{shared}\nsecond"])
        start = time.perf_counter()
        rows = {r.doc_id: r for r in linededup.drop_lines(df, min_docs=2).collect()}
        took = time.perf_counter() - start
        assert rows[0].l_n_lines == rows[1].l_n_lines == n + 1
        assert len(rows[1].l_drop) == n and rows[1].text == "second" and rows[0].text.count("\n") == n
        return took

    run(1000)
    small, large = run(16_000), run(64_000)
    assert large < 4 * 2 * small + 2
