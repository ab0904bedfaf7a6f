"""Quality rules, line dedup and decontamination: results, and plans without Python."""

import re

import pytest
from brute import dropped_lines, words

from cinderlog.llm import decontam, linededup, quality

PROSE = "This is a sentence of some words. It goes on for a while, and then it ends there."


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("make", [quality.clean, linededup.clean])
def test_no_python_in_the_plan(docs, make):
    assert not re.search("Python|Arrow|Pandas|ExistingRDD.*Py", plan(make(docs([PROSE, PROSE]))))


# ---------------------------------------------------------------- quality
def judged(df):
    return {r.doc_id: r for r in quality.judge(df).collect()}


def repeats(text):
    w = words(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    return len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)})


def test_measures(docs):
    texts = [
        PROSE,
        "a b c a b c a b",
        "x x x x",
        "a b a b a",
        "one\n\n one\none\n \n",
        "# $ % &|<> é日本 *",
        None,
        "",
        " \t ",
        "a b",
    ]
    got = judged(docs(texts))
    for i, t in enumerate(texts):
        r, full = got[i], [x for x in (t or "").split("\n") if words(x)]
        assert r.q_n_words == len(words(t))
        assert r.q_word_chars == sum(map(len, words(t)))
        assert r.q_n_symbols == len(re.findall("[#*$%&|<>]", t or ""))
        assert r.q_n_dup_lines == len(full) - len(set(full))
        assert r.q_n_repeat_words == repeats(t)
        assert r.q_base_failed


def test_verdicts(docs):
    good = "\n".join(" ".join(f"w{i}x{k}" for k in range(14)) + "." for i in range(9))
    menu = "Home\nLogin\nAbout | Contact | Help | Terms | Press\n"
    texts = [good, menu + good, good + "\nAll rights reserved.", (menu * 30) + good, good.upper() + " !! A!! B!! C!! D!! E!!"]
    got = judged(docs(texts))
    assert [got[i].q_kept for i in range(4)] == [True, True, True, False]
    assert got[1].q_text.strip() == good and got[2].q_text == good
    kept = quality.clean(docs(texts))
    assert kept.columns == docs([]).columns
    row = kept.where("doc_id = 1").first()
    assert row.n_chars == len(row.text)


def test_quality_edges(docs):
    df = docs([None, "", "a b c"]).selectExpr("*", "1 AS q_words", "2 AS kept")
    assert quality.clean(df).count() == 0 and quality.clean(df).columns == df.columns
    assert quality.judge(docs([])).count() == 0
    long = " ".join(f"word{i} and." for i in range(100_000))
    assert judged(docs([long, long]))[1].q_n_words == 200_000


# ---------------------------------------------------------------- line dedup
def dropped(df, min_docs=6):
    out = linededup.drop_lines(df, min_docs=min_docs)
    return {r.doc_id: list(r.l_drop or []) for r in out.collect()}


def test_lines_against_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    want = dropped_lines(texts, 2)
    assert dropped(df, 2) == want and any(want.values())


def test_variable_fields(docs):
    line = "Posted on {} by the user {} at our site, please see the rules of the forum."
    texts = [f"Own text number {i} x.\n{line.format(f'{i}.1.2020', f'name{i}x')}" for i in range(8)]
    words_only = ["Photo taken by {} for the regional paper and used here by kind permission today".format(n)
                  for n in "anna bert carl dora emil fred".split()]
    texts += [f"Something else {chr(97 + i)} here now.\n{w}" for i, w in enumerate(words_only)]
    assert dropped(docs(texts)) == dropped_lines(dict(enumerate(texts)))
    got = dropped(docs(texts))
    assert got[0] == [] and got[7] == [0, 1] and got[8] == [] and got[13] == [1]


def test_line_edges(spark, docs):
    line = "This same line is in all of them."
    texts = [None, "", "\n\n", line, f"{line}\n{line}\nown words in here"]
    texts += [f"{line}\nand now comes number {c} {c}{c}" for c in "abcdefg"]
    df = docs(texts)
    assert dropped(df) == dropped_lines(dict(enumerate(texts)))
    # Copies of whole documents are treated alike.
    copies = docs([f"{line}\nmore"] * 20)
    assert not any(dropped(copies).values())
    out = linededup.clean(df.selectExpr("*", "1 AS l_drop2", "2 AS `l_line`"))
    assert out.columns == [*df.columns, "l_drop2", "l_line"]
    assert out.where("text is null").count() == 1 and out.where("text = ''").count() == 1
    assert linededup.clean(docs([])).count() == 0
    unnamed = spark.createDataFrame([(None, t, "en", "s", 1) for t in texts], df.schema)
    assert linededup.clean(unnamed).count() >= 3
    assert linededup.clean(df.union(df)).count() == 2 * linededup.clean(df).count()


def test_a_document_of_nothing_but_recurring_lines_goes(docs):
    line = "Nothing but this line in all of them."
    kept = linededup.clean(docs([line + " \n" * i for i in range(8)]))
    assert [r.doc_id for r in kept.collect()] == [0]


# ---------------------------------------------------------------- decontamination
QUESTION = (
    "A train leaves Leeds at 9 and drives 120 km to York in 2 hours. How fast does the train "
    "of Leeds drive, and how far from York is it after 1 hour of the way?"
)


@pytest.fixture
def bench(spark):
    other = "Which of these rivers of the north flows into the cold sea behind the long hills?"
    return spark.createDataFrame([(1, QUESTION), (2, other), (3, "Too short"), (4, None)], "item_id long, text string")


def flagged(df, bench):
    return {(r.b_doc, r.b_item) for r in decontam.leaks(df, bench).collect()}


def test_leaks(docs, bench):
    around = "Some words stand before. {} And some words stand after it, as they do."
    new = QUESTION.replace("Leeds", "Derby").replace("York", "Hull").replace("120", "300").replace("9", "7")
    mixed = QUESTION.replace("to York", "to Hull").replace("of Leeds", "of Derby").replace("2 hours", "4 hours")
    texts = [
        QUESTION,
        around.format(QUESTION),
        around.format(QUESTION.upper()),
        around.format(new),
        PROSE * 5,
        None,
        "",
        "Too short",
        around.format(" ".join(QUESTION.split()[:4])),
    ]
    got = flagged(docs(texts), bench)
    assert {(0, 1), (1, 1), (2, 1), (3, 1)} <= got
    assert not {d for d, _ in got} & {4, 5, 6, 8}
    assert {i for d, i in got if d == 7} == {3}  # nothing but a short item
    slots = decontam.leaks(docs([mixed, new]), bench).collect()
    by = {r.b_doc: r.b_covered for r in slots}
    # Values that don't map one to one leave only windows without placeholders.
    assert by.get(0, 0) < by[1]


def test_leaks_against_brute_force(spark, sf):
    df, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    items = bench.collect()
    want = {(r.doc_id, b.item_id) for r in df.collect() for b in items if b.text.lower() in r.text.lower()}
    assert flagged(df, bench) == want and want


def test_leak_edges(spark, docs, bench):
    df = docs([QUESTION, PROSE, None])
    assert decontam.clean(df, bench).select("doc_id").collect() == [(1,), (2,)]
    wide = df.selectExpr("*", "1 AS b_doc", "2 AS b_h", "3 AS b_item")
    assert decontam.clean(wide, bench).columns == wide.columns
    assert decontam.clean(df.union(df), bench).count() == 4
    assert decontam.clean(df, bench.limit(0)).count() == 3
    assert decontam.clean(docs([]), bench).count() == 0
    unnamed = spark.createDataFrame([(None, QUESTION, "", "", 1), (None, PROSE, "", "", 1)], df.schema)
    assert decontam.clean(unnamed, bench).count() == 1
    assert decontam.clean(df, bench.union(bench)).count() == 2
    assert not re.search("Python|Arrow|Pandas", plan(decontam.clean(df, bench)))
