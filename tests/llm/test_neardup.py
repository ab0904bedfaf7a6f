import random

import numpy as np
from brute import components, shingles, words

from cinderlog.llm import neardup, sketch


def result(df, percent=85):
    return {r.doc_id: r for r in neardup.classes(df, percent=percent).collect()}


def prose(seed, n):
    draw = random.Random(seed)
    return [f"w{draw.randrange(5000)}" for _ in range(n)]


def changed(tokens, seed, share):
    draw, out = random.Random(seed), list(tokens)
    for i in draw.sample(range(len(out)), max(1, int(len(out) * share))):
        out[i] = f"x{draw.randrange(10**6)}"
    return out


def test_sets_are_those_of_the_contract():
    texts = ["A b C d E f", "a B c D e F", "one two", "", " \t\n\r", "x" * 10, "é É é a b c"]
    made = sketch.shingle_sets([t.encode() for t in texts])
    assert [len(s) for s in made] == [len(shingles(t)) for t in texts]
    assert (made[0] == made[1]).all()
    # Only A to Z are lower-cased.
    assert len(made[6]) == len(shingles(texts[6])) == 2


def test_word_digests_over_pieces(monkeypatch):
    text = " ".join(prose(1, 2000)).encode()
    whole, _ = sketch.word_digests([text])
    monkeypatch.setattr(sketch, "PIECE", 64)
    cut, at = sketch.word_digests([text])
    assert (whole == cut).all() and at.tolist() == [0, 2000]


def test_short_texts_differ_from_windows():
    a, b = sketch.shingle_sets([b"a b c d", b"z a b c d"])
    assert not np.intersect1d(a, b).size


def test_bands_of_few_shingles_are_full():
    for n in (1, 2, 7):
        keys = sketch.bands(np.unique(sketch.mix(np.arange(1, n + 1, dtype=np.uint64))))
        assert len(keys) == sketch.BANDS


def test_against_all_pairs(spark, docs, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    want, sizes = components(texts, 85)
    got = result(df)
    assert {d: r.component_id for d, r in got.items()} == want
    assert {d: r.n_shingles for d, r in got.items()} == sizes


def test_copies_of_an_original_that_are_not_like_each_other(docs):
    """The centre of a family may come late, and stars around its copies must not lose it."""
    base = prose(7, 400)
    texts = [" ".join(changed(base, s, 0.012)) for s in range(12)]
    texts += [" ".join(base)] + [" ".join(prose(100 + s, 300)) for s in range(6)]
    want, _ = components(dict(enumerate(texts)), 85)
    got = result(docs(texts))
    assert {d: r.component_id for d, r in got.items()} == want
    assert len(set(want.values())) < len(texts)


def test_chains(docs):
    chain, texts = prose(3, 500), []
    for s in range(25):
        texts.append(" ".join(chain))
        chain = changed(chain, 1000 + s, 0.01)
    want, _ = components(dict(enumerate(texts)), 85)
    assert {d: r.component_id for d, r in result(docs(texts)).items()} == want


def test_edges(spark, docs):
    same = " ".join(prose(5, 60))
    long = " ".join(prose(6, 60_000))
    df = docs([None, "", " \n ", same, same.upper().replace("W", "w"), long, long + " end", "a b"])
    df = df.union(df.where("doc_id = 3"))
    df = df.union(spark.createDataFrame([(None, same, "en", "s", 1)], df.schema))
    rows = neardup.classes(df, percent=85).collect()
    got = {r.doc_id: r.component_id for r in rows}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7}
    assert len(rows) == 9
    kept = neardup.keep(df).select("doc_id").collect()
    assert sorted(str(r.doc_id) for r in kept) == ["0", "1", "2", "3", "3", "5", "7", "None"]
    assert neardup.keep(df).columns == df.columns


def test_empty_table_and_clashing_columns(spark, docs):
    empty = docs([]).selectExpr("*", "1 AS m_doc", "2 AS m_set")
    assert neardup.classes(empty).count() == 0
    assert neardup.keep(empty).columns == empty.columns
    some = docs(["a b c d e f"] * 3).selectExpr("*", "1 AS m_doc", "2 AS m_gone", "3 AS m_node")
    assert [r.doc_id for r in neardup.keep(some).collect()] == [0]


def test_a_hot_group(docs):
    base = prose(9, 200)
    texts = [" ".join(changed(base, s, 0.005)) for s in range(150)] + [" ".join(base)] * 60
    assert {r.component_id for r in result(docs(texts), 80).values()} == {0}


def test_strays_among_copies_cost_no_square(spark):
    """Leaves of one label and a few others that share elements: pairs of different labels, once."""
    rows = [(0, e, n, 500, 1, e, 60) for n in range(1000) for e in range(20)]
    rows += [(0, e, n, 500, n, e, 60) for n in (2000, 2001, 2002) for e in range(15)]
    rows += [(0, 99, n, 500, 1, 9, 60) for n in range(1000)]
    own = ["m_node", "m_n", "m_label", "m_r", "m_d"]
    first = spark.createDataFrame(rows, "m_centre long, m_e long, " + ", ".join(f"{c} long" for c in own))
    met = neardup._met(first, own)
    want = {(a, b, e) for e in range(15) for b in (2000, 2001, 2002) for a in [*range(1000), *range(2000, b)]}
    got = [(min(r.m_node, r.m_nodey), max(r.m_node, r.m_nodey), r.m_e) for r in met.collect()]
    assert len(got) == len(set(got)) == len(want) and set(got) == want


def test_strays_find_their_leaf(docs):
    """Near copies, and texts outside their label that share bands with them."""
    base = prose(11, 300)
    texts = [" ".join(changed(base, s, 0.004)) for s in range(60)] + [" ".join(base)]
    texts += [" ".join(changed(base, 500 + s, 0.035)) for s in range(8)]
    want, _ = components(dict(enumerate(texts)), 85)
    assert {d: r.component_id for d, r in result(docs(texts), 85).items()} == want


def test_words_of_the_contract():
    assert words("a\x0bb\x0cc\u00a0d\x1ce") == ["a", "b", "c\u00a0d\x1ce"]
