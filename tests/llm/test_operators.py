"""The ten operators against brute force, exact round trips, planted cases and held-out accuracy."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronofold.llm import chat, decontaminate, hmm, jaccard_join, langid, mixing, mtree, rendezvous, token_orc, warc
from chronofold.llm.components import connected
from chronofold.llm.common import Workspace, heavy_keys, lookup_join
from chronofold.llm.signature_tree import bitmap, candidate_pairs
from chronofold.llm.textops import shingle_sets, utf8_parts, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"
# Columns whose names operators might use themselves.
CLASH = ["row", "key", "shard", "slot", "class", "token", "n", "part", "comp", "block", "copies", "score", "h", "u", "v", "start"]


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def shingles(text):
    w = WORD.findall(low(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def vocabulary(rng, n=400):
    return ["".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 9))) for _ in range(n)]


def corpus(seed=0, docs=160):
    """Random texts with exact and near copies, shared passages, repeats, nulls, empties, ties, and one long text."""
    rng = random.Random(seed)
    vocab = vocabulary(rng)
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, base = text(60), text(80)
    out = []
    for i in range(docs):
        kind = rng.random()
        if kind < 0.2:
            w = base.split()
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            t = " ".join(w)
        elif kind < 0.35:
            t = f"{text(rng.randint(5, 200))}\n{passage}\t{text(rng.randint(1, 30))}"
        elif kind < 0.5 and out:
            t = rng.choice(out)
        elif kind < 0.6 and out:
            t = (rng.choice(out) or "").upper() + " " + rng.choice(vocab)
        elif kind < 0.65:
            t = text(rng.randint(1, 6))
        else:
            t = text(rng.randint(1, 120))
        out.append(t)
    out += [None, "", " \n\t", "a", "a", "É à", text(9000)]
    return [(i, t, ("en", "fr", None)[i % 3], f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    frame = spark.createDataFrame(rows, DOC).repartition(5)
    for c in CLASH:
        frame = frame.withColumn(c, F.lit("x"))
    return rows, frame


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


# Shared parts


def test_word_and_shingle_kernels():
    texts = ["", "a b", None, "A  b\n", "c d e f g", "c d e f g h c d e f g", "x", "xa", "x a", "é\xa0f", *[t for _, t, *_ in corpus(3, 40)]]
    raw, starts, ends = utf8_parts(pa.array(texts))
    for block in (7, 1 << 20):
        hashes, counts = words(raw, starts, ends, block)
        assert counts.tolist() == [len(WORD.findall(low(t))) for t in texts]
        known = {}
        for t, h in zip((w for t in texts for w in WORD.findall(low(t))), hashes.tolist(), strict=True):
            assert known.setdefault(t, h) == h
        assert len(set(known.values())) == len(known)
    keys, sizes = shingle_sets(hashes, counts)
    assert sizes.tolist() == [len(shingles(t)) for t in texts]
    parts = [set(x.tolist()) for x in np.split(keys, np.cumsum(sizes)[:-1])]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert len(parts[i] & parts[j]) == len(shingles(a) & shingles(b))


def test_skew_join_and_components(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{i % 50}") for i in range(600)] + [(600, None)], "i int, k string")
    table = spark.createDataFrame([("hot", 1), *[(f"k{j}", j) for j in range(40)]], "k string, x int")
    got = {r.i: r.x for r in lookup_join(left, table, ["k"], heavy_keys(left, ["k"], 0.1)).collect()}
    assert got == {i: (1 if i % 3 == 0 else i % 50 if i % 50 < 40 else None) for i in range(600)} | {600: None}
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in edges:
        root[find(a)] = find(b)
    work = Workspace(spark, "test")
    found = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long"), work).collect()}
    ends = {x for a, b in edges if a != b for x in (a, b)}
    assert set(found) == ends
    assert all((found[a] == found[b]) == (find(a) == find(b)) for a in ends for b in ends)
    assert connected(spark.createDataFrame([], "a long, b long"), work, "none").count() == 0


# 1 WARC


def pages(spark):
    long = "<p>" + "ü" * 700
    rows = [(1, "http://www.a.org/x?b=1", long), (2, "http://b.a.org/", long), (3, None, long), (4, "http://a.org/x", "short"), (5, "http://a.org/x", "short"), (6, "http://a.org:8080/\n\r y", None), (7, "http://[bad", "x" * 1000), (None, "http://n.org", "y" * 2000), (9, "http://n.org", "y" * 2000), (10, "HTTP://N.org/", "")]
    return rows + [(100 + i, f"http://h{i % 3}.net/{i % 11}", f"page {i % 40} " * (1 + i % 200)) for i in range(400)]


@pytest.mark.parametrize("options", [{}, {"run_entries": 7, "fan_in": 3, "range_entries": 20}])
def test_warc(spark, options):
    rows = pages(spark)
    got = {r.page_id: r for r in warc.warc_digest(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), **options).collect()}
    assert len(got) == len(rows)
    best = {}
    for page, _, html in rows:
        best[html] = max(best.get(html, -1), -1 if page is None else page)
    for page, _, html in rows:
        raw = (html or "").encode()
        r = got[page]
        again = len(raw) >= 1000 and page is not None and page < best[html]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", best[html]) if again else ("response", None))


def test_warc_histories_are_ordered(spark):
    a = warc.WarcArchive(spark.createDataFrame(pages(spark), "page_id long, url string, html string").repartition(6), run_entries=9, fan_in=4, range_entries=25)
    rows = a.histories().orderBy("range_no", "ordinal").collect()
    keys = [(r.urlkey, r.ts, r.page_id is not None, r.page_id or 0) for r in rows]
    assert keys == sorted(keys) and len(keys) == 410 and len({r.range_no for r in rows}) > 3
    assert warc.url_key("http://www.A.org:80/P?q=1") == "org,a)/p?q=1"
    assert warc.warc_digest(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_loser_merge():
    rng = random.Random(0)
    for k in (0, 1, 2, 3, 7, 16):
        lists = [sorted(rng.randrange(50) for _ in range(rng.randrange(30))) for _ in range(k)]
        assert list(warc.loser_merge(map(iter, lists))) == sorted(x for part in lists for x in part)


# 2 Token ids


def test_token_files(spark, docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows, frame = docs
    odd = ["a  b", " x\n y ", "x \nb", "it's 1 2's", "中文 字", "a\0 b", "z　y", "<|endoftext|> a", "a\n \nb", "a <|endoftext|>", "<|endoftext|>", "x<|endoftext|><|endoftext|> y <|endoftext", "|>"]
    extra = spark.createDataFrame([(1000 + i, x) for i, x in enumerate(odd)] + [(5, "again"), (5, "again")], "doc_id long, text string")
    both = frame.select("doc_id", "text").union(extra)
    got = token_orc.token_digest(both, partitions=3).orderBy("start").collect()
    want = sorted([(r[0], r[1] or "") for r in rows] + [(1000 + i, x) for i, x in enumerate(odd)] + [(5, "again")] * 2)
    at = 0
    assert len(got) == len(want)
    for r, (i, text) in zip(got, want, strict=True):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_orc.token_digest(none).count() == 0
    work = Workspace(spark, "tokens")
    store = token_orc.TokenStore.write(both, work.path("orc"), partitions=3)
    assert store.lookup([7]).first().n_tokens == len(t.encode(rows[7][1] or "").ids) + 1 and store.lookup([-1]).count() == 0
    wide = both.select("*", *[F.lit(c).alias(c) for c in [*CLASH, "ids", "local_start", "ids_crc32", "n_tokens"]])
    assert sorted(map(tuple, token_orc.token_digest(wide, partitions=3).collect())) == sorted(map(tuple, got))


def scans(plan):
    """Rows that the file scans of an executed plan gave."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return scans(plan.executedPlan())
    own = [plan.metrics().get("numOutputRows").get().value()] if name == "FileSourceScanExec" else []
    return own + [n for i in range(plan.children().size()) for n in scans(plan.children().apply(i))]


def test_token_file_metadata_prunes(spark):
    """Several stripes with row indexes and Bloom filters on doc_id; a lookup reads the row groups it needs."""
    docs = spark.range(24000).select((F.col("id") * 2).alias("doc_id"), F.concat_ws(" ", F.lit("some words of"), F.sha2(F.col("id").cast("string"), 512)).alias("text"))
    path = Workspace(spark, "tokens").path("orc")
    store = token_orc.TokenStore.write(docs, path, partitions=2, row_stride=1000, stripe_bytes=128 << 10)
    orc, conf = spark._jvm.org.apache.orc.OrcFile, spark._jsc.hadoopConfiguration()
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = [f.getPath() for f in folder.getFileSystem(conf).listStatus(folder) if f.getPath().getName().endswith(".orc")]
    stripes = 0
    for file in files:
        reader = orc.createReader(file, orc.readerOptions(conf))
        rows = reader.rows()
        assert reader.getRowIndexStride() == 1000
        for stripe in reader.getStripes():
            stripes += 1
            kinds = {(s.getKind().toString(), s.getColumn()) for s in rows.readStripeFooter(stripe).getStreamsList()}
            assert ("BLOOM_FILTER_UTF8", 1) in kinds and {("ROW_INDEX", c) for c in range(7)} <= kinds
        rows.close()
    assert len(files) == 2 and stripes > 2
    for asked, held in (([30000], 1), ([30001], 0), ([-5], 0)):
        found = store.lookup(asked)
        assert len(found.collect()) == held
        assert sum(scans(found._jdf.queryExecution().executedPlan())) <= 1000 * held  # 30001 is within a range, so the Bloom filter tells


# 3 Sharding


def test_rendezvous(spark, docs, none):
    import struct

    import xxhash

    rows, frame = docs
    got = {r.doc_id: r for r in rendezvous.shard_documents(frame).collect()}

    def draw(key, shard):
        first = xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42)
        h = xxhash.xxh64_intdigest(struct.pack("<i", shard), seed=first)
        return -math.log(((h >> 11) + 0.5) / 2**53)

    for i, text, *_ in rows:
        r = got[i]
        best = min(range(40), key=lambda s: draw(i, s))
        assert (r.shard, r.grown_shard) == (best, 40 if draw(i, 40) < draw(i, best) else best)
        raw = (text or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key")
    slots = {}
    for r in got.values():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert rendezvous.shard_documents(none).count() == 0
    twice = rendezvous.shard_documents(frame.select("doc_id", "text").union(spark.createDataFrame([(None, "n"), (None, "n")], "doc_id long, text string")))
    assert twice.count() == len(rows) + 2 and twice.where("doc_id is null").select("shard").distinct().count() == 1


def test_rendezvous_weights(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    got = {r.shard: r["count"] for r in rendezvous.assign(ids, ["doc_id"], [1.0, 3.0, 0.0]).groupBy("shard").count().collect()}
    assert set(got) == {0, 1} and abs(got[1] / 20_000 - 0.75) < 0.02
    moved = rendezvous.assign(ids, ["doc_id"], [1.0] * 9).where("shard <> grown_shard")
    assert moved.where("grown_shard <> 9").count() == 0 and abs(moved.count() / 20_000 - 0.1) < 0.02
    with pytest.raises(ValueError):
        rendezvous.assign(ids, ["doc_id"], [0.0])


# 4 Jaccard join


def brute_components(rows):
    sets = {i: shingles(t) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("tuned", [False, True])
def test_jaccard(spark, docs, monkeypatch, tuned):
    rows, frame = docs
    if tuned:  # small cells and no broadcasts take the other ways
        for name, value in (("CELL", 4), ("BLOCK", 3), ("ANCHORS", 2), ("BROADCAST_BYTES", 0), ("LARGE", 2), ("COUNTED", 100), ("BUCKET", 50)):
            monkeypatch.setattr(jaccard_join, name, value)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame).collect()}
    assert got == brute_components(rows)


def test_jaccard_edges_of_the_law(spark, none):
    w = [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(w[:11])), (1, " ".join([*w[:10], "x"])), (2, " ".join(w[:12])), (3, " ".join(w[20:24])), (4, " ".join(w[20:24]).upper()), (5, " ".join(w[20:23])), (6, None), (7, ""), (8, " ".join(w[30:37])), (9, " ".join(w[30:38])), (9, " ".join(w[30:38]))]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = brute_components([r for i, r in enumerate(rows) if i < 10])
    assert got == sorted([(i, *want[i]) for i in range(10)] + [(9, *want[9])])
    assert want[8][1] == want[9][1] == 8 and want[0][1] == want[1][1]
    assert jaccard_join.jaccard_components(none).count() == 0


def test_signature_tree_loses_nothing():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, int(rng.integers(1, 300))).astype(np.uint64)) for _ in range(60)]
    for _ in range(200):
        b = sets[int(rng.integers(60))]
        sets.append(np.unique(np.concatenate([b[rng.random(len(b)) < rng.uniform(0.7, 1)], b[:1], rng.integers(0, 2**63, int(rng.integers(0, 20))).astype(np.uint64)])))
    plain, sizes = [set(s.tolist()) for s in sets], np.array([len(s) for s in sets])
    side = rng.integers(0, 2, len(sets))
    for s in (np.zeros(len(sets), int), side):
        i, j, _ = candidate_pairs(sizes, [bitmap(x) for x in sets], np.arange(len(sets)), s, 75)
        got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
        want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 100 * len(plain[a] & plain[b]) >= 75 * len(plain[a] | plain[b]) and (s is not side or side[a] != side[b])}
        assert want <= got and len(got) == len(i) and len(got) < len(sets) ** 2 / 8


def test_representatives(spark, docs, none):
    rows, frame = docs
    kept = jaccard_join.keep_representatives(frame)
    assert kept.columns == frame.columns
    want = brute_components(rows)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if c == i)
    again = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert [tuple(r) for r in jaccard_join.keep_representatives(again).collect()] == [(1, "a b c d e f")]
    assert jaccard_join.keep_representatives(none).count() == 0


# 5 Mixing


def test_mixing(spark, docs, none):
    rows = [(i, "w " * (1 + i % 5), None, "big" if i < 600 else ("mid" if i < 800 else None), 0) for i in range(900)] + [(900, None, None, "bare", 0)]
    frame = spark.createDataFrame(rows, DOC)
    plan = mixing.mixture_plan(frame, max_repetition=2.0).collect()
    tokens = Counter()
    for r in plan:
        tokens[r.source] += r.n_tokens
    total = sum(tokens.values())
    p = {s: n / total for s, n in tokens.items() if n}
    alpha = max(0.0, 1 - math.log(2) / math.log(max(p.values()) / min(p.values())))
    z = sum(x**alpha for x in p.values())
    q = {s: x**alpha / z for s, x in p.items()}
    budget = max(tokens[s] / q[s] for s in p)
    seen = Counter()
    for r in plan:
        seen[r.source] += r.n_tokens * r.copies
        assert r.copies >= 1 and abs(r.weight - q.get(r.source, 0)) < 1e-6
    for s in p:
        assert q[s] * budget - 6 <= seen[s] <= q[s] * budget + 1e-6
    mixed = mixing.mix(docs[1])
    assert mixed.columns == docs[1].columns and set(r.doc_id for r in mixed.collect()) == {r[0] for r in docs[0]}
    flat = mixing.Mixture(frame, target_entropy=1.0, max_repetition=None)
    assert flat.exponent == 0.0
    half = mixing.Mixture(frame, target_entropy=0.9, max_repetition=None)
    w = [r.weight for r in half.weights.where("weight > 0").collect()]
    assert -sum(x * math.log(x) for x in w) == pytest.approx(0.9 * math.log(3), abs=1e-6)
    small = mixing.mixture_plan(frame, max_repetition=None, budget=300.0).collect()
    assert 300 - 20 <= sum(r.n_tokens * r.copies for r in small) <= 300
    assert mixing.mix(none).count() == 0
    with pytest.raises(ValueError):
        mixing.Mixture(frame, max_repetition=0.5)


# 6 Decontamination


def sellers(pattern, text):
    prev = list(range(len(pattern) + 1))
    best = prev[-1]
    for c in text:
        cur = [0]
        for i, x in enumerate(pattern):
            cur.append(min(prev[i] + (x != c), prev[i + 1] + 1, cur[i] + 1))
        prev = cur
        best = min(best, prev[-1])
    return best


def brute_leaks(rows, items):
    nz = lambda t: " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", low(t))).encode()
    out = {}
    for item, t in items:
        p = nz(t)
        for a, b in decontaminate.segments_of(len(p)):
            k = min(int((b - a) * decontaminate.EDITS), max(0, (b - a - decontaminate.Q) // decontaminate.Q))
            for i, text, *_ in rows:
                d = sellers(p[a:b], nz(text))
                if d <= k:
                    out[i, item] = min(d, out.get((i, item), 99))
    return out


def test_decontamination(spark, none):
    rng = random.Random(5)
    vocab = vocabulary(rng)
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(0, text(12)), (1, text(30)), (2, text(25).upper() + "!"), (3, "short one"), (4, None), (5, ""), (6, text(40)), (6, text(30)), (7, "déjà vu " * 9)]
    rows = []
    for i in range(30):
        body = text(rng.randint(0, 60))
        source = rng.choice([t for _, t in items if t and len(t) > 40])
        chars = list(source)
        for _ in range(rng.choice([0, 0, 2, 4, 8, 20])):
            at = rng.randrange(len(chars))
            chars[at : at + 1] = rng.choice([[], ["q"], [chars[at], "z"]])
        leak = "".join(chars)
        rows.append((i, f"{body} {leak if i % 3 else leak[: len(leak) // 2]}, {text(5)}"))
    rows += [(50, None), (51, ""), (52, items[1][1]), (52, items[1][1]), (53, text(400))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_leaks(rows, items)
    for size in (1 << 20, 100):
        got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.find_leaks(frame, bench, size).collect()}
        assert got == want and len(want) > 15
        kept = decontaminate.remove_leaks(frame, bench, size)
        assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in want}
    assert decontaminate.find_leaks(none, bench).count() == 0 and decontaminate.find_leaks(frame, bench.limit(0)).count() == 0


# 7 Top k


def test_mtree(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(8, 6))
    rows = [(i, (centres[i % 8] + 0.1 * rng.normal(size=6)).tolist()) for i in range(700)]
    rows += [(700, rows[0][1]), (701, rows[0][1]), (702, [0.0] * 6), (703, None), (704, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (705, [float("nan")] * 6), (706, [float("inf")] * 6), (707, [1e9] * 6), (750, [1.0, 2.0]), (800, [2.0, 1.0]), (None, [1.0] * 6), (850, []), (701, rows[0][1])]
    rows += [(50, rows[50][1]), (50, rows[0][1]), (50, [9000.0] * 6), (None, rows[0][1]), (None, rows[0][1]), (None, None)]  # ids repeated and missing
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and None not in v and np.isfinite(v).all()]
    want = Counter()
    for a, (q, x) in enumerate(ok):
        if q is not None and q % 50 == 0:
            best = sorted((-sum(s * t for s, t in zip(x, y, strict=True)), i is None, i or 0) for b, (i, y) in enumerate(ok) if b != a and len(y) == len(x))[:5]
            want.update((q, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(best))
    wide = frame.select("*", *[F.lit(c).alias(c) for c in [*CLASH, "v", "asked", "query_id", "rank"] if c != "v"])
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in mtree.embedding_top_k(wide).collect()) == want
    again = mtree.top_k(mtree.integer_vectors(frame), "vec_id % 50 = 0", 5, block=30)
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in again.collect()) == want
    assert mtree.embedding_top_k(frame.limit(0)).count() == 0 and mtree.embedding_top_k(frame.where("vec_id = 50").limit(1)).count() == 0


def test_mtree_bounds_spare_distances():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 6))
    points = np.floor(256 * (centres[rng.integers(40, size=20_000)] + 0.02 * rng.normal(size=(20_000, 6))))
    keys = np.arange(20_000)
    tree = mtree.MTree.unpacked(mtree.MTree(mtree.Rows(points, keys, np.zeros(20_000, bool), keys)).packed())
    asked = np.arange(0, 20_000, 1000)
    heaps: list = [[] for _ in asked]
    tree.search(points[asked], asked, 5, heaps)
    assert tree.computed < 0.5 * 20_000 * len(asked) and tree.spared > 0
    for q, heap in zip(asked, heaps, strict=True):
        scores = points @ points[q]
        best = sorted(((-s, i) for i, s in enumerate(scores.tolist()) if i != q))[:5]
        assert [(-s, -t) for s, t, _ in sorted(heap, reverse=True)] == best
    inner = [n for n in tree.nodes if len(n) == 4 and n[2] is not None]
    assert inner  # inner nodes hold their pivots' distances to their own pivot
    with_parents = tree.computed
    tree.nodes = [(n[0], n[1], None, n[3]) if len(n) == 4 else n for n in tree.nodes]
    tree._reset()
    tree.search(points[asked], asked, 5, [[] for _ in asked])
    assert tree.computed > with_parents  # which spares computations


# 8 Chat


def test_chat(spark):
    rng = random.Random(2)
    vocab = vocabulary(rng, 50) + ["[/]", "[user]", "\\", "<s>", "\\o", "[", "]", "é", "</s>[INST]"]
    rows = []
    for c in range(40):
        turns = rng.randint(1, 30)
        for t in range(turns):
            role = "system" if t == 0 and c % 2 else rng.choice(["user", "assistant"])
            rows.append((c, t, role, None if rng.random() < 0.05 else " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 3, 20, 90])))))
    rows += [(90, 0, None, "x"), (90, 0, "user", None), (91, None, "assistant", "a"), (None, 1, "we[ird]\\", "b"), (92, 0, "assistant", "long " * 5000), (93, 0, "system", "s " * 300), (93, 1, "assistant", "t"), (94, 0, "assistant", "same"), (94, 0, "assistant", "same")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r.conv_id: r for r in chat.chat_digest(frame, 128, 24).collect()}
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    windows = {}
    for r in chat.format_windows(frame, 128, 24).collect():
        windows.setdefault(r.conv_id, []).append(r)
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[c].n_turns == len(turns)
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == sum(len(w.formatted) for w in windows[c])
        for w in windows[c]:
            inner = w.formatted.count("[/]") - (turns[0][2] == "system")
            assert w.n_tokens <= 128 or (inner == 1 and w.n_repeated <= 1)
            if turns[0][2] == "system":
                assert w.formatted.startswith("[system]")
    assert len(windows[92]) == 1 and any(len(w) > 3 for w in windows.values())
    assert chat.chat_digest(frame.limit(0)).count() == 0


# 9 Language ID


def test_language_id(spark, none):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(10_000, None, "en"), (10_001, "123 %% \n", "fr"), (10_002, "", None), (10_003, "a", None), (10_004, "the and " * 20_000, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("row", F.lit(1)).withColumn("score", F.lit("x"))
    got = {r.doc_id: r for r in langid.identify(frame).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    test = [(i, lang) for i, _, lang in rows if got[i].held_out and i < 10_000]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert sum(got[i].lang_pred == lang for i, lang in test) >= 0.97 * len(test) and len(test) > 30
    assert [got[i].lang_pred for i in (10_000, 10_001, 10_002)] == ["und"] * 3 and got[10_004].lang_pred == "en"
    kept = langid.keep_identified(frame)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == set(got) - {10_000, 10_001, 10_002}
    assert langid.identify(none).count() == 0 and langid.keep_identified(none).count() == 0
    blind = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert langid.identify(blind).first().lang_pred == "und"


def test_cross_parsing_against_brute_force():
    texts = {"x": "the cat sat on the mat", "y": "le chat est sur la table"}
    parser = langid.CrossParser(texts)

    def phrases(text, sample):
        n, i = 0, 0
        while i < len(text):
            j = i + 1
            while j <= len(text) and text[i:j] in sample:
                j += 1
            i = max(i + 1, j - 1)
            n += 1
        return n

    for text in ("the chat", "cat table mat le", "zzz the", "a"):
        symbols, _ = parser.symbols.of(langid.points_of(text))
        padded = np.full((1, langid.PIECE), parser.symbols.pad, np.int32)
        padded[0, : len(symbols)] = symbols
        assert parser.phrases(padded, np.zeros(1, np.int64), 1)[:, 0].tolist() == [phrases(text, texts[k]) for k in ("x", "y")]


# 10 Language model


def test_hidden_markov(spark, docs, none):
    rows, frame = docs
    model = hmm.HiddenMarkovModel(frame, states=3, vocabulary=60, passes=3, chunk_bytes=3000)
    got = {r.doc_id: r for r in model.scores().collect()}
    tokens = {i: [*WORD.findall(low(t)), None] for i, t, *_ in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    total, types = sum(c.values()), len(c)
    own = {}
    for w, n in c.items():
        if w is not None:
            own[w] = n
    top = sorted(own.values(), reverse=True)[:60]
    assert model.stats["tokens"] == total and model.stats["types"] == types and model.stats["rare_tokens"] == total - c[None] - sum(top)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), total)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (total + types + 1)) for w in ws))
    assert model.history == sorted(model.history) and len(model.history) == 3
    # Exactness: brute force over all state paths of short texts.
    chain = model.chain
    for r in model.sequences.where("n_tokens <= 6").collect():
        s = np.frombuffer(r.symbols, np.uint16)
        paths = 0.0
        for code in range(3 ** len(s)):
            z = [code // 3**k % 3 for k in range(len(s))]
            x = chain.start[z[0]] * chain.emit[s[0], z[0]]
            for a, b, w in zip(z[:-1], z[1:], s[1:], strict=True):
                x *= chain.move[a, b] * chain.emit[w, b]
            paths += x
        assert got[r.doc_id].score == pytest.approx(math.log10(paths) + r.rare_score)
    assert np.allclose(chain.emit.sum(0), 1) and np.allclose(chain.move.sum(1), 1)
    assert hmm.score_documents(none).count() == 0


def test_hidden_markov_beats_base_on_held_out(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    r = hmm.score_documents(frame).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]
