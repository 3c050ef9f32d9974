"""Workers keep an operator's encoders from task to task, with the hash powers that it uses besides, and nothing of another."""

import sys

import pyarrow as pa

from chronofold.llm import token_orc
from chronofold.llm.textops import base_powers
from chronofold.llm.workers import process_cache


def test_powers_of_an_operator_stay_and_go_with_its_encoders():
    sys.modules.pop("_chronofold_process", None)
    process_cache("a")["file"] = "encoder"
    first = base_powers(10, owner="a")
    assert process_cache("a") == {"file": "encoder"}
    assert base_powers(10, owner="a").base is first.base
    assert len(base_powers(10)) == 10  # of an operator that keeps nothing else
    assert process_cache("a") == {} == process_cache("a", "hash powers")


def test_a_worker_loads_the_tokenizer_once(spark):
    def tasks(batches):
        import sys

        for _ in token_orc._encode(None, 0)(batches):
            pass
        held = sys.modules["_chronofold_process"].caches.get("piece encoders", {}).get("", {})
        yield pa.RecordBatch.from_pydict({"known": [sum(e.known for e in held.values())]})

    rows = spark.range(0, 400, 1, 1).selectExpr("id AS doc_id", "concat('word', id, ' follows') AS text")
    first, second = (rows.union(rows).mapInArrow(tasks, "known long").collect() for _ in range(2))
    assert all(r.known > 400 for r in [*first, *second])
