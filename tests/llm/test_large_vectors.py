"""Top k with finite vectors of any size, against Python integers."""

import math
import random

from chronofold.llm import mtree


def expected(rows, k=5):
    known = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, x in known:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in known if i != q and len(y) == len(x))
            for n, (s, i) in enumerate(scored[:k]):
                out[q, n + 1] = (i, -s if -(2**63) <= -s < 2**63 else None)
    return out


def test_large_and_empty_vectors_take_part(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(400)]
    rows += [(400 + i, [rng.gauss(0, 1) * 10.0 ** rng.randint(3, 8) for _ in range(6)]) for i in range(200)]  # past 2^21, 2^26, 2^53
    rows += [(600 + i, [8192.0 + i, 0.0, -3.0, 1.0, 2.0, 5.0]) for i in range(60)]
    rows += [(700, [1e30, 1.0, 0.0, 0.0, 0.0, 0.0]), (701, [1e30, 2.0, 0.0, 0.0, 0.0, 0.0]), (702, [-1e30] * 6), (703, [-2e30] * 6), (750, [-3e38] * 6), (704, [3e38] * 6)]
    rows += [(800, []), (801, []), (850, []), (900, None), (901, [float("inf")] * 6), (902, [float("nan")] * 6), (903, [None] * 6), (950, [1e9, 2.0]), (951, [2.0, -1e9])]
    for parts in (1, 3):
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
        got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in mtree.embedding_top_k(frame).collect()}
        assert got == expected(rows)


def test_places_sort_as_scores():
    edge = 2**63
    scores = [-(7**900), -(2**200) - 1, -(2**200), -(2**200) + 1, -edge - 2, -edge - 1, -edge, edge - 1, edge, edge + 1, 2**200 - 1, 2**200, 2**200 + 1, 7**900]
    keys = [(mtree.place_of(s), s if mtree.place_of(s) == "5" else 0) for s in scores]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
