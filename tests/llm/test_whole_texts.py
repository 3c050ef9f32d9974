"""Language ID over long texts and large alphabets; benchmark items shorter than a q-gram."""

import random
import re

import numpy as np
import pytest

from chronofold.llm import decontaminate, langid

from .test_operators import CLASH


def phrases(text, sample):
    """Longest phrases of the sample, from left to right."""
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in sample:
            j += 1
        i = max(i + 1, j - 1)
        n += 1
    return n


def folded(text):
    return re.sub(r"[^a-zäöüéñ一-鿿]+", " ", text.lower())


@pytest.mark.parametrize("piece", [3, 16, 256])
def test_long_texts_are_parsed_as_one(monkeypatch, piece):
    monkeypatch.setattr(langid, "PIECE", piece)
    rng = random.Random(piece)
    vocab = {k: ["".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(60)] for k, letters in (("x", "abcdefgh"), ("y", "efghijklé"))}
    samples = {k: " ".join(rng.choice(v) for _ in range(300)) for k, v in vocab.items()}
    parser = langid.CrossParser(samples)
    texts = [" ".join(rng.choice(vocab[rng.choice("xy")] + ["zq"]) for _ in range(n)) for n in (1, 2, 30, 300, 1500)] + ["", "a" * 700, "zz" * 300, ", ." * 90]
    found = {}
    one = parser.phrases
    parser.phrases = lambda symbols, owner, n: found.setdefault("got", one(symbols, owner, n))
    parser.classify(texts)
    want = [[phrases(folded(t), folded(samples[k])) for t in texts if t] for k in ("x", "y")]
    got = found["got"][:, [i for i, t in enumerate(texts) if t]]
    assert got.tolist() == want


def test_large_alphabets_keep_their_letters_apart():
    rng = random.Random(8)
    one, two = [[chr(0x4E00 + 2 * i + k) for i in range(900)] for k in (0, 1)]  # no letter in common
    texts = {"p": "".join(rng.choice(one) for _ in range(6000)), "q": "".join(rng.choice(two) for _ in range(6000))}
    parser = langid.CrossParser(texts)
    asked = ["".join(rng.choice(letters) for _ in range(40)) for letters in (one, two) * 10]
    names, scores, _ = parser.classify(asked)
    assert names == ["p", "q"] * 10 and min(scores) > 0.05
    symbols, owner = parser.symbols.of(langid.points_of("".join(sorted({*one, *two}))), np.arange(1800))
    codes = {}
    for s, o in zip(symbols.tolist(), owner.tolist(), strict=True):
        codes.setdefault(o, []).append(s)
    assert len({tuple(c) for c in codes.values()}) == min(1800, len({*texts["p"], *texts["q"]}) + 1)  # letters not in the sample share a symbol


def test_selection_follows_the_prediction(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rng = random.Random(2)
    junk = [(10_000 + i, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(60)), None) for i in range(20)]  # letters, but no language
    bare = [(r[0] + 20_000, r[1], None) for r in rows[:30]]
    frame = spark.createDataFrame(rows + junk + bare, "doc_id long, text string, lang string")
    predicted = {r.doc_id: r.lang_pred for r in langid.identify(frame).collect()}
    kept = {r.doc_id: r.lang for r in langid.keep_identified(frame).collect()}
    assert set(kept) == {i for i, _, _ in rows + bare}
    assert all(kept[i] == lang for i, _, lang in rows) and all(kept[i] == predicted[i] for i, _, _ in bare)
    some = {r.doc_id for r in langid.keep_identified(frame, ["de", "fr"]).collect()}
    assert some == {i for i in kept if predicted[i] in ("de", "fr")} and len(some) > 20
    counts = {r.lang_pred: r.documents for r in langid.language_counts(langid.identify(frame)).collect()}
    assert sum(counts.values()) == len(rows + junk + bare) and counts["de"] == sum(p == "de" for p in predicted.values())


def test_short_items_are_whole_words(spark):
    items = [(1, "Yes!"), (2, "no"), (3, "a b"), (4, "ninechars"), (5, "ninecharz"), (6, "..."), (7, None), (8, ""), (9, "no"), (10, "élan"), (11, "twelve chars")]
    texts = ["yes", "oh YES, sir", "yesterday", "No.", "a-b", "xa b", "a bc", "the ninechars", "ninecharsx", "NINECHARZ!", "élan", "mélan", "", None, "...", "say no", "noyes", "a  b no yes", "so twelve chars here", "é"]
    clash = [c for c in CLASH]
    docs = spark.createDataFrame([(i, t, *clash) for i, t in enumerate(texts)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in clash)).repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")

    def fold(t):
        return " ".join(re.sub(r"[^0-9a-z\x80-\U0010ffff]+", " ", "".join(c.lower() if c.isascii() else c for c in t or "")).split())

    want = {(i, k) for i, t in enumerate(texts) for k, item in items if 0 < len(fold(item).encode()) and f" {fold(item)} " in f" {fold(t)} "}
    found = decontaminate.find_leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and len(want) > 12 and {r.edits for r in found} == {0}
    kept = decontaminate.remove_leaks(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {i for i, _ in want}
