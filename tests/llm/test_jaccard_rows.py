"""Rows of the Jaccard join that share a doc_id or have none, against a brute force over rows."""

import random
from collections import Counter

import numpy as np
import pytest

from chronofold.llm import jaccard_join
from chronofold.llm.signature_tree import bitmap, candidate_pairs

from .test_operators import CLASH, shingles, vocabulary


def groups(rows):
    """Group number of each row by links of its shingles, None for an empty set."""
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return [g if s else None for g, s in zip(group, sets, strict=True)], sets


def first_of(rows, group):
    ids = sorted((d is None, d or 0) for (d, _), g in zip(rows, groups(rows)[0], strict=True) if g == group)
    return None if ids[0][0] else ids[0][1]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocab = vocabulary(rng)
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))

    def near(t, edits=1):
        w = t.split()
        for _ in range(edits):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        return " ".join(w)

    a, b, c, d, e = (text(60) for _ in range(5))
    out = [(0, a), (5, a), (5, b), (7, c)]  # one id on two texts, one of them a copy
    out += [(None, d), (3, d), (None, e), (None, near(e)), (None, near(d))]  # nulls: copies of others, of each other, unrelated
    out += [(9, near(c)), (9, text(50)), (9, text(50)), (9, near(b))]  # the hub's id on several texts
    out += [(11, ""), (11, ""), (11, None), (None, " \t"), (None, None), (None, None)]  # without words
    out += [(12, "One two"), (12, "one TWO"), (12, "one two"), (13, "one two")]  # one set, different texts
    out += [(20, text(40))] * 3 + [(None, text(40))] * 2  # rows repeated whole
    out += [(rng.choice([1, 2, None, 30 + i]), near(rng.choice([a, b, c]), 2)) for i in range(40)]
    return out


def test_components_of_rows(spark, rows):
    for seed in (0, 1):
        mixed = list(rows)
        random.Random(seed).shuffle(mixed)
        found = jaccard_join.jaccard_components(spark.createDataFrame(mixed, "doc_id long, text string").repartition(3 + seed)).collect()
        group, sets = groups(mixed)
        want = Counter((d, len(s), d if g is None else first_of(mixed, g)) for (d, _), s, g in zip(mixed, sets, group, strict=True))
        assert Counter(tuple(r) for r in found) == want


def test_representatives_of_rows(spark, rows):
    wide = [(*r, *["x"] * len(CLASH)) for r in rows]
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASH)
    kept = jaccard_join.keep_representatives(spark.createDataFrame(wide, schema).repartition(4))
    assert kept.columns == ["doc_id", "text", *CLASH]
    found = [(r.doc_id, r.text) for r in kept.collect()]
    group, _ = groups(rows)
    assert Counter(r for r in found if not shingles(r[1])) == Counter(r for r, g in zip(rows, group, strict=True) if g is None)  # wordless rows all stay
    of_row = {r: g for r, g in zip(rows, group, strict=True) if g is not None}
    per_group = Counter(of_row[r] for r in found if shingles(r[1]))
    assert set(per_group) == set(of_row.values()) and set(per_group.values()) == {1}
    for r in found:
        if shingles(r[1]):
            assert r[0] == first_of(rows, of_row[r])


def test_widths_of_a_low_percentage_meet():
    small, large = np.arange(1, 21, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.arange(1, 61, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sizes, zero = np.array([20, 60]), np.zeros(2, np.int64)
    i, _, _ = candidate_pairs(sizes, [bitmap(small), bitmap(large)], np.array([0, 1]), zero, 30)
    assert len(i) == 1  # 20 of 60 shared
