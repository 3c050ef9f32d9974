"""What worker processes keep from one operator to the next."""

import sys

from chronofold.llm.workers import process_cache


def test_an_operator_keeps_its_own_until_another_asks():
    sys.modules.pop("_chronofold_process", None)
    process_cache("a", "x")["k"] = 1
    process_cache("a", "y")["k"] = 2
    assert process_cache("a", "x") == {"k": 1} and process_cache("a", "y") == {"k": 2}
    assert process_cache("b") == {}
    assert process_cache("a", "x") == {}
