"""The filter interaction audit against running every order row by row."""

import random
from fractions import Fraction
from itertools import combinations, permutations
from math import comb

from brute import words

from cinderlog.llm import interaction

LABELS = "doc_id long, quality int, toxic int"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def fails(doc_id, text, smaller):
    t, w = text or "", words(text)
    upper = sum("A" <= c <= "Z" for c in t)
    return "".join(
        x
        for x, bad in (
            ("A", len(w) < 200),
            ("B", 100 * len(set(w)) < 50 * len(w)),
            ("C", 100 * upper > 2 * len(t)),
            ("D", any(c in "#$%&*|" for c in t)),
            ("E", doc_id is not None and any(d < doc_id for d in smaller.get(t, ()))),
        )
        if bad
    )


def by_running(docs, labels):
    """All rows of the audit, by filtering the documents of each part in each order."""
    same = {}
    for d, t, *_ in docs:
        same.setdefault(t or "", []).extend([d] * (d is not None))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    parts = {}
    for d, t, _, s, _ in docs:
        parts.setdefault(s or "", []).append((d, fails(d, t, same)))
    out, shapley = {}, {}
    for part, rows in parts.items():
        for order in permutations("ABCDE"):
            left, gone = rows, []
            for step, f in enumerate(order, 1):
                now = [r for r in left if f in r[1]]
                rest = [r for r in left if f not in r[1]]
                out[part, "".join(order), step] = (
                    len(rest), len(now), sum(f in r[1] for r in gone), sum(r[1] == f for r in rows),
                    sum(r[0] in good for r in now), sum(r[0] in toxic for r in now),
                )
                shapley[part, f] = shapley.get((part, f), 0) + len(now)
                left, gone = rest, gone + now
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, docs, labels):
    found = interaction.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    return {tuple(r)[:3]: tuple(r)[3:] for r in found.collect()}


def shapley_by_coalitions(values, players):
    out = []
    for i in range(players):
        others, total = [p for p in range(players) if p != i], Fraction(0)
        for k in range(players):
            for members in combinations(others, k):
                s = sum(1 << p for p in members)
                total += Fraction(values[s | 1 << i] - values[s], comb(players - 1, k))
        out.append(total / players)
    return out


def test_least_squares_gives_shapley_shares():
    rng = random.Random(7)
    for players in (1, 2, 3, 5):
        values = [0] + [rng.randrange(10**12) for _ in range((1 << players) - 1)]
        got = [sum(a * b for a, b in zip(r, values)) for r in interaction.shares(players)]
        assert got == shapley_by_coalitions(values, players)
        assert sum(got) == values[-1]


def test_against_running_every_order(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t", "one", "A" * 50, "a#b", "é" * 49 + "É", "A" + "a" * 49, "a\x0bb\x1cc"]
    for n in (199, 200, 201, 400):
        for kinds in (1, 99, 100, 101, n):
            t = " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))
            texts += [t, t + " $", t.upper(), t + " "]
    rows = [(i, t, "en", rng.choice(["x", "y", None, ""]), 1) for i, t in enumerate(texts * 2)]
    rng.shuffle(rows)
    rows += [(3, "one", None, "x", None), (3, "one", None, "x", None), (None, "one", "", "y", 0)]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d, *_ in rows]
    labels += [(0, 1, 1), (0, 0, 0), (None, 1, 1), (10**6, 1, 1)]
    assert audited(spark, rows, labels) == by_running(rows, labels)


def test_a_text_of_most_rows_and_long_texts(spark):
    long = "word " * 200_000
    rows = [(i, "same text" if i % 3 else long, "en", f"s{i % 2}", 1) for i in range(60)]
    got = audited(spark, rows, [])
    assert got == by_running(rows, [])
    assert got["s0", "EABCD", 1][1] + got["s1", "EABCD", 1][1] == 58


def test_empty_tables_and_clashing_columns(spark):
    assert audited(spark, [], [(1, 1, 1)]) == {}
    rows = [(1, "x", "en", "s", 1), (2, "x", "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    for name in ("x_words", "x_mask", "part", "step", "kept"):
        docs = docs.withColumnRenamed("lang", name).selectExpr("*", "'e' AS lang")
    labels = spark.createDataFrame([(1, 1, 0, "z")], LABELS + ", source string")
    found = {tuple(r)[:3]: tuple(r)[3:] for r in interaction.audit(docs, labels).collect()}
    assert found == by_running(rows, [(1, 1, 0)])
