"""State that a Python worker process keeps between tasks."""

from __future__ import annotations

import functools
import sys
import types


def process_cache(owner: str, name: str = "") -> dict:
    """A dict that outlives the task: kernels are pickled by value, so their module globals do not.

    Workers live on from one operator to the next, so what one ``owner`` keeps (automata, encoders, indexes) goes as
    soon as another asks for a dict of its own.
    """
    holder = sys.modules.setdefault("_chronofold_process", types.ModuleType("_chronofold_process"))
    caches = holder.__dict__.setdefault("caches", {})
    if owner not in caches:
        caches.clear()
    return caches.setdefault(owner, {}).setdefault(name, {})


def tidy(kernel):
    """A batch kernel that hands freed memory back to the system when its task ends: workers live on between tasks."""

    @functools.wraps(kernel)
    def run(batches):
        import ctypes

        import pyarrow

        try:
            yield from kernel(batches)
        finally:
            pyarrow.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not this C library
                pass

    return run
