"""The sample that language ID learns from: distinct texts, 24,000 characters, tables of the sample's own letters."""

import random

from chronofold.llm import langid


def test_copies_take_one_place_in_the_sample(spark):
    rng = random.Random(2)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(200))
    copied, others = text(), [text() for _ in range(40)]
    rows = [(i, copied, "en") for i in range(3000)] + [(3000 + i, t, "en") for i, t in enumerate(others)] + [(5000, "kurz und gut", "de")] * 3
    got = langid.training_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    assert got["de"] == "kurz und gut" and len(got["en"]) > 20_000
    parts = got["en"].split("\n")
    assert len(parts) == len(set(parts)) and set(parts[:-1]) <= {copied, *others}


def test_the_sample_is_not_cut_to_half(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["der", "die", "das"]) + str(rng.random()) for _ in range(300)), "de") for i in range(40)]
    got = langid.training_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(got["de"]) == 24_000


def test_tables_hold_the_letters_of_their_own_sample():
    texts = {"a": "abc abd", "b": "xyz" + "".join(chr(0x430 + i) for i in range(30))}
    parser = langid.CrossParser(texts)
    assert len(parser.tables[0]) < 16 * 8 and parser.classify(["abd", "xyz"])[0] == ["a", "b"]
