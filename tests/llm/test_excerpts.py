"""Excerpts of benchmark items at every offset, by construction and plain edit distance."""

import random

from chronofold.llm import decontaminate


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(n))


def within(pattern, text, limit):
    """Whether some region of ``text`` lies within ``limit`` edits of ``pattern``."""
    prev = list(range(len(pattern) + 1))
    best = prev[-1]
    for c in text:
        cur = [0]
        for i, x in enumerate(pattern):
            cur.append(min(prev[i] + (x != c), prev[i + 1] + 1, cur[i] + 1))
        prev = cur
        best = min(best, prev[-1])
    return best <= limit


def test_verbatim_excerpts_are_found_at_every_offset(spark):
    rng = random.Random(11)
    items = [(0, words(rng, 60)[:300].strip()), (1, words(rng, 30)[:137].strip()), (2, words(rng, 20)[:90].strip())]
    rows, want = [], set()
    for item, text in items:
        for size in (60, 80, 100, 120, 130):
            for at in range(0, len(text) - size + 1):
                rows.append((len(rows), f"{words(rng, 12)} {text[at : at + size]} {words(rng, 12)}"))
                want.add((len(rows) - 1, item))
    strangers = [(len(rows) + i, words(rng, 40)) for i in range(50)]
    short = [(20_000 + i, f"{words(rng, 12)} {items[0][1][i : i + 30]} {words(rng, 12)}") for i in range(0, 250, 7)]
    frame = spark.createDataFrame(rows + strangers + short, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame, bench).collect()}
    assert got == want
    kept = {r.doc_id for r in decontaminate.remove_leaks(frame, bench).collect()}
    assert kept == {i for i, _ in strangers + short}


def test_what_hundred_character_segments_found_is_still_found(spark):
    rng = random.Random(12)
    item = words(rng, 60)[:277].strip()
    rows, want = [], set()
    old = [*range(0, len(item) - 100, 50), len(item) - 100]
    for n in range(300):
        a = rng.choice(old)
        chars = list(item[a : a + 100])
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(chars))
            chars[at : at + 1] = rng.choice([[], ["q"], [chars[at], "z"]])
        text = f"{words(rng, 6)} {''.join(chars)} {words(rng, 6)}"
        rows.append((n, text))
        if any(within(item[b : b + 100], text, 6) for b in old):
            want.add(n)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    assert len(want) > 250 and {r.doc_id for r in decontaminate.find_leaks(frame, bench).collect()} >= want
