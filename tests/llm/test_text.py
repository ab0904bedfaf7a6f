"""BPE, token counts and personal data against libraries and plain versions."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cinderlog.llm import bpe, pii, queries, tokencount

WORD = public_tokenizers.path(queries.WORD_BPE)
PIECE = public_tokenizers.path(queries.PIECE_BPE)

HARD = [
    "", "a", "Hello <|endoftext|> World<|startoftext|>x", "<|ENDOFTEXT|> <|endoftext", "ΑΣ ΣΑΣ Σ",
    "İstanbul ǅ ﬁ é ①②½", "日本語 テスト 한국어", "aaaaaaaaaaaaaaaa hahahahahaha!!!!!!????....",
    "it's we'll I'M DON'T'S", "\x00\x01 \u200b\u3000\x1c\x1d\x85 a", "😀😀👍🏽", "123456 ²³ x_y __",
    "\x0b\x0c\r\n", "ẞ ſ K Å e\u0301 \u0301", "word " * 2000, "x" * 5000,
]


def samples():
    draw = random.Random(4)
    made = ["".join(draw.choice("abcdeinrstthaou'  !?.") for _ in range(30)) for _ in range(300)]
    made += ["".join(chr(draw.randint(32, 0x24F)) for _ in range(20)) for _ in range(200)]
    made += ["".join(chr(draw.choice([*range(0x300, 0xD7FF), *range(0x10000, 0x1FFFF)])) for _ in range(12)) for _ in range(200)]
    return HARD + made


def test_codec_equals_the_library():
    library, own = Tokenizer.from_file(WORD), bpe.Codec(WORD)
    for text in samples():
        want = library.encode(text, add_special_tokens=False).ids
        got = own.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == want, text
        assert own.decode(got) == library.decode(want, skip_special_tokens=False), text


def test_full_tables_start_anew(monkeypatch):
    for name in ("CHUNKS", "WORDS", "ARCS"):
        monkeypatch.setattr(bpe, name, 3)
    library, own = Tokenizer.from_file(WORD), bpe.Codec(WORD)
    text = " ".join(samples()[16:80])
    assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_gadgets_of_small_grammars():
    """All words of small alphabets against merging pair by pair."""

    def merged(word, merges):
        parts = [*word[:-1], word[-1] + "$"]
        while True:
            ranks = [(merges.index(p), i) for i, p in enumerate(zip(parts, parts[1:])) if p in merges]
            if not ranks:
                return parts
            i = min(ranks)[1]
            parts[i : i + 2] = ["".join(parts[i : i + 2])]

    for seed in range(12):
        draw = random.Random(seed)
        symbols, merges = ["a", "b", "a$", "b$"], []
        for _ in range(9):
            left = draw.choice([s for s in symbols if not s.endswith("$")])
            pair = (left, draw.choice(symbols))
            if "".join(pair) not in symbols:
                merges.append(pair)
                symbols.append("".join(pair))
        automaton = bpe.Automaton({s: i for i, s in enumerate(symbols)}, merges, "$")
        for n in range(1, 9):
            for number in range(2**n):
                word = f"{number:0{n}b}".replace("0", "a").replace("1", "b")
                got = [symbols[i] for i in automaton.encode(word)]
                assert got == merged(word, merges), (merges, word)


def test_encode_frames(spark, docs):
    df = docs([None, *HARD]).selectExpr("*", "1 AS `t ids`")
    out = bpe.encode(df, WORD).collect()
    library = Tokenizer.from_file(WORD)
    for r in out:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.t_ids == ids and r.t_n_tokens == len(ids)
        assert r.t_ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.t_decoded_sha256 == hashlib.sha256(r.t_decoded.encode()).hexdigest()
    assert bpe.encode(docs([]), WORD).count() == 0


# ---------------------------------------------------------------- token counts
def test_counts(spark, docs):
    texts = [None, "", *HARD, "<s> </s> <unk> ▁", "word " * 3, "word " * 3]
    df = docs(texts).selectExpr("*", "1 AS c_content")
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    cache = tokencount.new_cache(spark)
    for _ in range(2):  # from an empty cache, and from a full one
        rows = tokencount.counts(df, PIECE, cache).collect()
        assert len(rows) == len(texts)
        for r in rows:
            t = texts[r.doc_id] or ""
            assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(model.encode(t)))
            assert r.over_limit == (r.n_tokens > 4096)
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("c_content").distinct().count() == len({t or "" for t in texts})


def test_known_counts_are_not_encoded_again(spark, docs, monkeypatch):
    cache = tokencount.new_cache(spark)
    tokencount.counts(docs(["a b", "c d"]), PIECE, cache).collect()
    spark.read.parquet(cache).selectExpr("c_content", "'other' AS c_version", "9L AS c_tokens").write.mode("append").parquet(cache)
    rows = tokencount.counts(docs(["a b", "e f g"]), PIECE, cache).collect()
    assert max(r.n_tokens for r in rows) < 9
    own = spark.read.parquet(cache).where("c_version <> 'other'")
    assert own.count() == 3


def test_count_edges(spark, docs):
    cache = tokencount.new_cache(spark)
    assert tokencount.counts(docs([]), PIECE, cache).count() == 0
    df = docs(["x y z"] * 4)
    unnamed = spark.createDataFrame([(None, "x y z", "", "", 1), (None, None, "", "", 1)], df.schema)
    assert tokencount.counts(df.union(df).union(unnamed), PIECE, cache).count() == 10


# ---------------------------------------------------------------- personal data
KEY = b"secret"
PLANTED = (
    "Write to anna.berg@mail3.example.com or ANNA.BERG@mail3.example.com, call +1 (743) 555-3824 or "
    "+1 743 555 3824. Card 4111-1111-1111-1111, IP 70.23.22.57, IBAN GB82 WEST 1234 5698 7654 32, "
    'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff". Mrs Vera Holm and Mr. Paul Holm came; Vera left.'
)


def rewritten(df):
    return {r.doc_id: r for r in pii.replace(df, KEY).collect()}


def test_surrogates(docs):
    got = rewritten(docs([PLANTED, "Nothing here.", None, "", PLANTED + " again"]))
    text = got[0].text
    for secret in (
        "anna.berg", "ANNA.BERG", "743", "4111-1111", "70.23.22.57", "GB82", "24be6443", "Vera", "Paul", "Holm",
    ):
        assert secret not in text
    assert got[1].text == "Nothing here." and got[1].p_entities == 0
    assert got[2].text is None and got[3].text == ""
    assert got[4].text == text + " again"
    mails = re.findall(r"[\w.]+@[\w.]+", text)
    assert mails[0].lower().rstrip(".") == mails[1].lower().rstrip(".") and mails[1].rstrip(",").isupper()
    phones = re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}|\+1 \d{3} \d{3} \d{4}", text)
    assert len(phones) == 2 and len({re.sub(r"\D", "", p) for p in phones}) == 1
    card = re.sub(r"\D", "", re.search(r"\d{4}-\d{4}-\d{4}-\d{4}", text)[0])
    assert pii._luhn(card[:-1]) == int(card[-1])
    iban = re.search(r"GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d", text)[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert re.search(r'token = "[0-9a-f]{40}"', text)
    names = re.search(r"Mrs (\w+) (\w+) and Mr\. (\w+) (\w+) came; (\w+) left", text)
    assert names[1] == names[5] and names[2] == names[4] and names[1][-1] == "a"


def test_another_key_gives_other_surrogates():
    assert pii.surrogate(b"a", "ip", "1.2.3.4", 0) != pii.surrogate(b"b", "ip", "1.2.3.4", 0)
    assert re.match("[А-Я]", pii.written("surname", "Иванов", pii.surrogate(KEY, "surname", "иванов", 0)))


def test_collisions_keep_entities_apart(spark):
    """A format with few values: many numbers of four digits, some of them occurring as originals."""
    rows = [("ssn", f"{i:03d}") for i in range(0, 600)]
    df = spark.createDataFrame(rows, "p_kind string, p_value string")
    got = pii.assign(df, KEY).collect()
    new = [r.p_new for r in got]
    assert len(got) == 600 and len(set(new)) == 600
    assert not {v for _, v in rows} & set(new)


def test_pii_edges(spark, docs):
    df = docs([PLANTED] * 3).selectExpr("*", "1 AS p_doc2", "2 AS p_value")
    out = pii.replace(df, KEY)
    assert out.columns == [*df.columns, "p_entities", "p_kinds"]
    assert out.select("text").distinct().count() == 1
    unnamed = spark.createDataFrame([(None, PLANTED, "", "", 1)] * 2, docs([]).schema)
    assert pii.replace(unnamed, KEY).count() == 2
    assert pii.replace(docs([]), KEY).count() == 0
    long = ("word " * 50_000) + PLANTED
    assert rewritten(docs([long]))[0].p_entities == rewritten(docs([PLANTED]))[0].p_entities


@pytest.mark.parametrize("text", ["1.2.3.4.5", "300.1.1.1", "version 2.10", "in 2020 and 1999", "a @ b", "12-34"])
def test_what_is_no_entity(text):
    assert pii.detect(text) == []
