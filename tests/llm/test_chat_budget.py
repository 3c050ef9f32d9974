"""The budget law of chat windows, clashing columns, and a very long text."""

import hashlib

import pytest
from pyspark.sql import functions as F

from chronofold.llm import chat

from .test_operators import CLASH


@pytest.mark.parametrize("system", [0, 10, 45, 62])
@pytest.mark.parametrize("history", [0, 20, 200])
def test_budget(spark, system, history):
    sizes = [3, 40, 0, 7, 7, 7, 60, 1, 0, 0, 12, 30, 30, 2] * 3
    turns = ([("system", "s " * system)] if system else []) + [("assistant" if k % 2 else "user", "w " * n) for k, n in enumerate(sizes)]
    frame = spark.createDataFrame([(1, t, r, x) for t, (r, x) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(frame, 50, history).orderBy("window_no").collect()
    cost = [len(x.split()) + 2 for _, x in turns]
    at = 0
    for w in windows:
        held = w.formatted.count("[/]")
        own = held - w.n_repeated
        first = at + own == len(turns) or at == 0
        assert own >= 1 and w.formatted.startswith("[system]") == bool(system)
        repeated = w.n_repeated - (1 if system and at else 0)
        span = cost[at : at + own] if at or not system else cost[:own]
        total = sum(span) + sum(cost[at - repeated : at]) + (cost[0] if system and at else 0)
        assert w.n_tokens == total
        new = own - (1 if system and not at else 0)  # turns of the span besides the system turn
        assert total <= 50 or (new == 1 and repeated == 0)
        assert sum(cost[at - repeated : at]) <= history
        at += own
        assert first or at <= len(turns)
    assert at == len(turns)


def test_clashing_columns_and_a_long_text(spark):
    long = "word [/] \\ " * 700_000  # over 7 MB
    frame = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", long), (2, 0, "assistant", "")], "conv_id long, turn long, role string, text string")
    wide = frame.select("*", *[F.lit(c).alias(c) for c in [*CLASH, "i", "cum", "tok", "turns", "w", "s", "e"] if c not in frame.columns])
    got = {r.conv_id: r for r in chat.chat_digest(wide).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(f"user\nhi\nassistant\n{long}\n".encode()).hexdigest() and got[1].loss_chars == len(long)
    assert got[2].n_turns == 1 and got[2].loss_sha256 == hashlib.sha256(b"").hexdigest()
