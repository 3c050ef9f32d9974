"""The hidden Markov model without training documents, with null ids and many buckets, and workers that lack the repository."""

import os
import subprocess
import sys
import zlib
from pathlib import Path

import pytest

from chronofold.llm import hmm

ROOT = Path(__file__).resolve().parents[2]
FREE = 2  # crc32 % 7 is not 2
HELD = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]


def test_nothing_to_learn_from(spark):
    frame = spark.createDataFrame([(HELD[0], "some words here", 1), (HELD[1], None, 2), (HELD[2], "", 3)], "doc_id long, text string, score int")
    got = {r.doc_id: r for r in hmm.score_documents(frame).collect()}
    assert [(got[i].n_tokens, got[i].n_known, got[i].train_tokens, got[i].base_score, got[i].score, got[i].held_out) for i in HELD[:3]] == [(4, 0, 0, 0.0, 0.0, True), (1, 0, 0, 0.0, 0.0, True), (1, 0, 0, 0.0, 0.0, True)]


def test_null_ids_are_learnt_from_and_scored(spark):
    frame = spark.createDataFrame([(None, "a b a"), (None, "a b a"), (HELD[0], "a c"), (FREE, None)], "doc_id long, text string")
    got = sorted(hmm.score_documents(frame, states=2, passes=1).collect(), key=lambda r: (r.doc_id is not None, r.held_out))
    assert [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(None, False, 4, 4, 9), (None, False, 4, 4, 9), (FREE, False, 1, 1, 9), (HELD[0], True, 3, 2, 9)]
    assert got[0].score == got[1].score < 0


@pytest.mark.parametrize("bucket", [7, 2_000_000])
def test_buckets_do_not_change_the_counts(spark, monkeypatch, bucket):
    monkeypatch.setattr(hmm, "BUCKET", bucket)
    frame = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + k * k) % 40}" for k in range(30))) for i in range(50)], "doc_id long, text string")
    got = {r.doc_id: (r.n_known, r.train_tokens, round(r.base_score, 9)) for r in hmm.score_documents(frame, states=2, passes=1, chunk_bytes=400).collect()}
    from collections import Counter
    from math import log10

    texts = {i: [f"w{(i * 7 + k * k) % 40}" for k in range(30)] + [None] for i in range(50)}
    c = Counter(w for i, t in texts.items() if i not in HELD for w in t)
    n, v = sum(c.values()), len(c)
    assert got == {i: (sum(c[w] > 0 for w in t), n, round(sum(log10((c[w] + 1) / (n + v + 1)) for w in t), 9)) for i, t in texts.items()}


SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
from chronofold.llm import queries
docs = [(i, " ".join("word%d" % ((i // 2) * 3 + k) for k in range(20 + i % 2)), "en", "s", 9) for i in range(12)]
spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet({out!r} + "/documents.parquet")
spark.createDataFrame([(0, "word0 word1 word2 word3 word4 word5 word6 word7")], "item_id long, text string").write.parquet({out!r} + "/benchmark.parquet")
spark.createDataFrame([(i, "http://a.b/%d" % i, "<p>x" * 400) for i in range(4)], "page_id long, url string, html string").write.parquet({out!r} + "/pages.parquet")
spark.createDataFrame([(i, [float(i), 1.0], 0) for i in range(60)], "vec_id long, embedding array<float>, label int").write.parquet({out!r} + "/embeddings.parquet")
for name in ("op1_warc_index_merge", "op2_token_orc", "op4_signature_tree_join", "op6_qgram_leaks", "op7_mtree_top_k", "op9_cross_parsing", "op10_hidden_markov"):
    print(name, queries.QUERIES[name](spark, {out!r}).count())
"""


def test_workers_need_no_copy_of_the_repository(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(root=str(ROOT), out=str(tmp_path))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-3000:]
    counts = dict(line.split() for line in run.stdout.splitlines() if line.startswith("op"))
    assert counts == {"op1_warc_index_merge": "4", "op2_token_orc": "12", "op4_signature_tree_join": "12", "op6_qgram_leaks": "2", "op7_mtree_top_k": "10", "op9_cross_parsing": "12", "op10_hidden_markov": "12"}
