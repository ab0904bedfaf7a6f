"""Language identification against plain sets, and its accuracy on held-out documents."""

import random
import zlib

import numpy as np

from cinderlog.llm import langid

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
MASK = (1 << 64) - 1


def grams(text):
    """The n-grams of a text, as strings."""
    low = [c.lower() if len(c.lower()) == 1 else c for c in text]
    runs = "".join(x if c.isalpha() else " " for c, x in zip(text, low))
    plain = " " + " ".join(runs.split()) + " "
    return {plain[i : i + n] for n in (1, 2, 3) for i in range(len(plain) - n + 1)} if runs.split() else set()


def slots(text):
    out = set()
    for g in grams(text):
        h = 0
        for c in g:
            h = (h * 0x110000 + ord(c)) & MASK
        out.add((((h + len(g)) * int(langid.MIX)) & MASK) >> (64 - langid.BITS))
    return out


def plain_scores(sample, texts, landmarks, ridge):
    """Values of each text for each language, with kernels from sets and a plain inverse root."""

    def k(a, b):
        return len(a & b) / (len(a) * len(b)) ** 0.5

    langs = sorted({n for n, _ in sample})
    sets = [slots(t) for _, t in sample]
    marks = sets[:landmarks]
    values, vectors = np.linalg.eigh(np.array([[k(a, b) for b in marks] for a in marks]))
    solid = values > 1e-6 * values.max()
    root = vectors[:, solid] / np.sqrt(values[solid])
    x = np.array([[k(a, b) for b in marks] for a in sets]) @ root
    y = np.array([[1.0 if n == m else -1.0 for m in langs] for n, _ in sample])
    share = [len(sample) / len(langs) / sum(n == m for m, _ in sample) for n, _ in sample]
    w = np.diag(share)
    c = np.linalg.solve(x.T @ w @ x + ridge * len(sample) * np.eye(x.shape[1]), x.T @ w @ y)
    return langs, np.array([[k(slots(t), m) for m in marks] for t in texts]) @ root @ c


def test_presence_equals_plain_sets(monkeypatch):
    rng = random.Random(5)
    texts = ["a", "Ab", "  x  y", "ÄÖ über", "Straße\n\n1a2b", "日本語", "x" * 9, "İI", "a\U0001d4d0b\ud800c"]
    texts += ["".join(rng.choice("abÀé ,.\n1") for _ in range(n)) + "z" for n in (5, 50, 500)]
    for piece in (1, 2, 7, langid.PIECE):
        monkeypatch.setattr(langid, "PIECE", piece)
        for t in texts:
            assert set(np.flatnonzero(langid.presence(t)).tolist()) == slots(t), (piece, t)
        for t in ("", " \n", "12 !?"):
            assert langid.presence(t) is None


def test_predictions_equal_a_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect()
    sample, texts = [(r.lang, r.text) for r in docs[:40]], [r.text for r in docs[40:]]
    bits = [np.packbits(langid.presence(t)).tobytes() for _, t in sample]
    model = langid.fit([n for n, _ in sample], bits, landmarks=15, ridge=0.01)
    langs, want = plain_scores(sample, texts, 15, 0.01)
    assert list(model.langs) == langs
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r for r in langid.predict(df, model, ["i"]).collect()}
    for i, row in enumerate(want):
        assert got[i].lang_pred == langs[int(row.argmax())]
        assert abs(got[i].score - min(1, max(0, (row.max() + 1) / 2))) < 1e-5


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r.doc_id: r for r in langid.identify(docs).collect()}
    hit = []
    for r in docs.collect():
        held = zlib.crc32(str(r.doc_id).encode()) % 4 == 2
        assert found[r.doc_id].held_out == held
        if held:
            hit.append(found[r.doc_id].lang_pred == r.lang)
    assert len(found) == 1000 and len(hit) > 200 and sum(hit) / len(hit) >= 0.99


def test_labels_of_held_out_rows_are_not_used(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    same = langid.identify(docs.withColumn("source", docs.lang))
    wrong = docs.selectExpr(
        "doc_id", "text", "CASE WHEN crc32(cast(doc_id AS string)) % 4 = 2 THEN 'xx' ELSE lang END AS lang",
        "source", "n_chars",
    )
    assert sorted(langid.identify(wrong).collect()) == sorted(same.collect())


def test_nulls_empty_long_and_repeated(spark):
    en, fr = "the house of the lord is there", "la maison est là où elle était"
    rows = [(i, [en, fr][i % 2] + f" {i}", ["en", "fr"][i % 2], "s", 1) for i in range(40)]
    rows += [(100, None, "en", "s", 1), (101, "", "fr", None, 1), (102, "12 !", "en", "s", None)]
    rows += [(None, en, "xx", "s", 1), (103, en, None, None, 1), (104, f"{fr} " * 100_000, None, "s", 1)]
    rows += [(0, en, "en", "s", 1)] * 30 + [(105, "語", None, "s", 1)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' AS lang_pred", "1 AS k_rank", "2 AS score")
    got = [(r.doc_id, r.lang_pred, r.held_out, r.score) for r in langid.identify(df).collect()]
    assert len(got) == len(rows)
    by = {g[0]: g for g in got}
    assert all(by[i][1] == "und" and by[i][3] == 0 for i in (100, 101, 102))
    assert by[None][1:3] == ("en", False)
    assert by[103][1] == "en" and by[104][1] == "fr" and by[105][1] in ("en", "fr")
    assert all(by[i][1] == ["en", "fr"][i % 2] for i in range(40))
    assert sum(g[0] == 0 for g in got) == 31 and all(0 <= g[3] <= 1 for g in got)


def test_nothing_to_learn_from(spark):
    assert langid.identify(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, "words here", None, "s", 1), (2, None, "en", "s", 1)]
    got = langid.identify(spark.createDataFrame(rows, DOCS)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * 2
