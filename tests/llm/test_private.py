"""Personal data that a gate could pass by, and names that meet across their kinds."""

import re

import pytest

from cinderlog.llm import pii

KEY = b"secret of the test"


def rewritten(df):
    return {r.doc_id: r for r in pii.replace(df, KEY).collect()}


def test_entities_without_a_digit_reach_detection(docs):
    texts = [
        "password: correcthorse",
        "Api_Key=abcdefghijkl",
        "call \u0661\u0662\u0663 \u0664\u0665\u0666 \u0667\u0668\u0669\u0660 now",
        "host abcd:abcd:abcd:abcd:abcd:abcd:abcd:abcd up",
        "host dead::beef up",
        "no entity: in here",
    ]
    got = rewritten(docs(texts))
    assert [got[i].p_entities for i in range(6)] == [1, 1, 1, 1, 1, 0]
    assert all(got[i].text != texts[i] for i in range(5)) and got[5].text == texts[5]


def test_compressed_addresses(docs):
    texts = ["at 2001:db8::1, then", "at 2001:0db8:0000:0000:0000:0000:0000:0001.", "at fe80::1 x", "x[1::2] y[::2] a::b std::vector"]
    got = rewritten(docs(texts))
    new = [re.search("at ([0-9a-f:]+)", got[i].text)[1] for i in range(3)]
    assert [got[i].p_entities for i in range(4)] == [1, 1, 1, 0]
    assert "2001:db8::1" not in new and len(new[1]) == 39
    assert pii.IPv6Address(new[0]) == pii.IPv6Address(new[1]) != pii.IPv6Address(new[2])


@pytest.mark.parametrize("text", ["::", "12::30", "a::b", "1:2:3::4:5:6:7:8:9"])
def test_no_addresses(text):
    assert not [x for x in pii.detect(text) if x[2] == "ip6"]


def test_names_are_apart_across_kinds(spark, docs):
    kinds = ("surname", "given-n", "given-f", "given-m")
    letters = "abcdefghijklmnopqrst"
    rows = [(kinds[i % 4], a + b + c) for i, (a, b, c) in enumerate((a, b, c) for a in letters[:4] for b in letters for c in "aeiou")]
    # Originals that others would draw, of another kind.
    rows += [("surname", pii.surrogate(KEY, k, v, 0)) for k, v in rows[1:40:4]]
    got = pii.assign(spark.createDataFrame(rows, "p_kind string, p_value string").distinct(), KEY).collect()
    values = {r.p_value for r in got}
    assert {(r.p_kind, r.p_value) for r in got} == set(rows)
    assert len({r.p_new for r in got}) == len(values) and not {r.p_new for r in got} & values
    text = rewritten(docs(["Dr Anna Holm met Mrs Anna Holm. Anna left."]))[0].text
    assert len(set(re.findall(r"(?:Dr|Mrs) (\w+)|(\w+) left", text)) - {""}) <= 2
    first, second, third = re.search(r"Dr (\w+) .* Mrs (\w+) .* (\w+) left", text).groups()
    assert first == second == third


@pytest.mark.parametrize(
    "text,hidden",
    [
        ("Dr Anna Maria Luisa Holm left", "Anna Maria Luisa Holm"),
        ("with Señor Juan de la Cruz today", "Juan Cruz"),
        ("Mr van der Berg and Frau von Kleist", "Berg Kleist"),
        ("Dr  Anna  Holm", "Anna Holm"),
        ("Mme. Éa d'Arc, née", "Éa"),
        ("Prof O'Neill-Smith", "O'Neill-Smith"),
    ],
)
def test_whole_names_go(docs, text, hidden):
    got = rewritten(docs([text]))[0]
    assert not [w for w in hidden.split() if w in got.text]
    assert got.p_entities == len(hidden.split())
    assert re.sub(r"[^\W\d_][\w'’-]*", "w", got.text) == re.sub(r"[^\W\d_][\w'’-]*", "w", text)


@pytest.mark.parametrize("text", ["the Dr\nThe next line", "Mr and Mrs", "Dr de la", "Miss you all", "Msc Anna"])
def test_no_names(docs, text):
    assert rewritten(docs([text]))[0].text == text


def test_long_local_parts(docs):
    local = "a.very-long+local_part" * 40
    got = rewritten(docs([f"to <{local}@host.org> and b@{'c' * 300}.net"]))[0]
    assert got.p_entities == 2 and "very-long" not in got.text and got.text.startswith("to <") and "b@" not in got.text


def test_detection_equals_a_plain_reading_of_names():
    """Titles and words read token by token."""
    import random

    rng = random.Random(2)
    pool = ["Dr", "Mr.", "Frau", "Anna", "Holm", "de", "la", "walks", "42", ",", "\n", "van", "Élan", "x"]
    for _ in range(400):
        tokens = [rng.choice(pool) for _ in range(12)]
        text = " ".join(tokens)
        want, i = set(), 0
        for i, t in enumerate(tokens):
            if t.rstrip(".") not in pii.GENDER:
                continue
            for w in tokens[i + 1 :]:
                if w[0].isupper():
                    want.add(w.rstrip("."))
                    if w.endswith("."):
                        break
                elif w not in pii.PARTICLES:
                    break
        found = {text[a:b] for a, b, k, _ in pii.detect(text) if k.startswith(("given", "surname"))}
        assert found == want, text
