"""What decontamination finds of items that are placed, filled in or written differently."""

import pytest

from cinderlog.llm import decontam

SOURCE = (
    "the miller of a small village by the lake sold all flour and bread he had made in winter "
    "to some merchants who came over frozen hills with mules carts and lanterns while snow kept "
    "falling on roofs gardens walls fields paths bridges and boats"
)
ITEMS = [(1, SOURCE), (2, "which metal melts under moonlight")]


@pytest.fixture
def found(spark, docs):
    def run(texts, items=ITEMS):
        bench = spark.createDataFrame(items, "item_id long, text string")
        return {(r.b_doc, r.b_item): r.b_covered for r in decontam.leaks(docs(texts), bench).collect()}

    return run


def test_the_place_of_a_passage_does_not_matter(found):
    words = SOURCE.split()
    assert len(words) >= 40
    pieces = [" ".join(words[i : i + 13]) for i in range(0, len(words) - 13)]
    before = ("", "xa ", "xa xb ")
    texts = [f"{b}{p} zz" for p in pieces for b in before]
    got = found(texts)
    assert got == {(i, 1): 13 for i in range(len(texts))}
    assert set(found([f"{b}which metal melts under moonlight?" for b in before])) == {(0, 2), (1, 2), (2, 2)}


TRIP = "A hiker walks 12 km in 3 hours with 5 kg on the back, pays $40 and sees 7% of the 9x map."


def test_units_are_slots(found):
    same = TRIP.replace("km", "miles").replace("hours", "days").replace("kg", "pounds")
    same = same.replace("$", "€").replace("7%", "8 percent").replace("9x", "4x")
    glued = TRIP.replace("12 km", "12km").replace("5 kg", "5kg").replace("7%", "7 %")
    upper = TRIP.replace("km", "KM").replace("hours", "Hours")
    whole = found([TRIP], [(1, TRIP)])[0, 1]
    assert found([same, glued, upper], [(1, TRIP)]) == {(i, 1): whole for i in range(3)}


SUM = "What is 12 + 15 + 7 - 3 * 4 + 20 / 5?"
TRIPLES = " and ".join(f"{i} {i + 40} {i + 77}" for i in (3, 19, 28, 31, 57, 64)) + " are"


def test_items_dense_in_numbers(found):
    items = [(1, SUM), (2, TRIPLES)]
    other = " and ".join(f"{i + 200} {i + 500} {i + 900}" for i in range(6)) + " are"
    texts = [f"Xa. {SUM} Then more.", f"xa xb {TRIPLES} three", f"xa {other} here", "What is 2 + 3 + 9 + 8 + 1 + 6?"]
    got = found(texts, items)
    assert got[0, 1] == 9 and got[1, 2] == len(TRIPLES.split()) == 24
    # The same template with other values is met by its words.
    assert got[2, 2] == 24 and not {(2, 1), (3, 1)} & set(got)


TRAIN = (
    "A train leaves Leeds at 9 and drives 120 km to York in 2 hours. How fast does the train "
    "of Leeds drive, and how far from York is it after 1 hour of the way?"
)


def test_values_that_coincide_or_differ_in_one_place(found):
    new = TRAIN.replace("Leeds", "Derby").replace("York", "Hull").replace("120", "300")
    new = new.replace("9", "7").replace("2 hours", "7 hours")
    once = TRAIN.replace("of Leeds", "of Derby")
    got = found([new, f"xa {new}", once], [(1, TRAIN)])
    whole = found([TRAIN], [(1, TRAIN)])[0, 1]
    assert got[0, 1] == whole and got[1, 1] >= whole - 1
    # Only the place that differs is lost.
    assert got[2, 1] == whole - 1


def test_scattered_phrases_are_no_leak(found):
    words = SOURCE.split()
    fill = [f"x{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    pieces = [" ".join(words[i : i + 5]) for i in (26, 14, 2)]
    far = " ".join(x for i, p in enumerate(pieces) for x in (p, *fill[90 * i : 90 * i + 90]))
    ordered = " ".join(x for i, p in enumerate(pieces[::-1]) for x in (p, *fill[90 * i : 90 * i + 90]))
    # The same words with a few others between them are the item still.
    close = " ".join(words[:10] + fill[:3] + words[10:20] + fill[3:4] + words[21:])
    assert found([far, ordered, close, f"{' '.join(fill)} {close}"]) == {(k, 1): len(words) - 1 for k in (2, 3)}


def test_items_of_a_few_tokens(found):
    items = [(1, "Paris, France"), (2, "42"), (3, ""), (4, None), (5, "Who is it?")]
    texts = ["paris france", "42", "43", "Who is it", "We saw Paris, France again.", "who is it then"]
    assert found(texts, items) == {(0, 1): 2, (1, 2): 1, (3, 5): 3}


def test_repeated_documents_all_go(spark, docs):
    bench = spark.createDataFrame([(1, SOURCE)], "item_id long, text string")
    twice = docs([SOURCE, "clean text of some other kind"]).union(docs([SOURCE]))
    assert [r.doc_id for r in decontam.clean(twice, bench).collect()] == [1]
    assert decontam.leaks(twice, bench).count() == 1


def test_equals_a_plain_version(spark, docs, sf):
    """Templates, slots, alignments and coverage computed text by text, on tables and on altered items."""
    import random

    from brute import leaks

    rng = random.Random(4)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    items += [(10**6 + i, t) for i, t in enumerate((SOURCE, TRIP, SUM, TRIPLES, "Paris, France", "", None))]
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    plain = [t for _, t in items if t]
    for _ in range(150):
        words = rng.choice(plain).split(" ")
        for _ in range(rng.randrange(6)):
            k = rng.randrange(len(words))
            words[k : k + rng.randrange(2)] = rng.choice([["77"], ["Derby"], ["so", "it"], ["9", "km"], []])
            words = words or ["x"]
        cut = rng.randrange(len(words))
        texts.append(" ".join(rng.choice([words, words[cut:] + words[:cut], ["xa"] + words[cut:], words * 2])))
    want = leaks(list(enumerate(texts)), items)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.b_doc, r.b_item): r.b_covered for r in decontam.leaks(docs(texts), bench).collect()}
    assert got == want and len(want) > 50
