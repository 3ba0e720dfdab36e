"""Memory of Python workers. Spark keeps a worker for the tasks of later stages, and with it what a task left there:
encoders with full caches, and freed pages that the allocators hold on to. Both count beside the executor's heap.

The wrappers here stand around the function of a Python stage: models of other operators go before it runs, freed pages
go back to the system after it. A model that is dropped is made again by the next task that needs it.
"""

from __future__ import annotations

import ctypes
import time

import pyarrow as pa

#: What drops the models that a worker holds, by the module that makes them.
MODELS: dict = {}
#: Seconds from one return of pages to the next, as a group may take less than the return itself.
EVERY = 0.25
_last = 0.0


def drop_models(keep: str = "") -> None:
    for name, clear in MODELS.items():
        if name != keep:
            clear()


def give_back() -> None:
    """Freed pages go from Arrow's pool and the C library (where it is glibc) to the system."""
    global _last
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
    _last = time.monotonic()


def _give_back_now_and_then() -> None:
    if time.monotonic() - _last >= EVERY:
        give_back()


def lean(run, keep: str = ""):
    """For mapInArrow; keep: the module whose model the function uses."""

    def task(batches):
        drop_models(keep)
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def lean_group(f):
    """For applyInArrow on one table's groups."""

    def group(table):
        drop_models()
        try:
            return f(table)
        finally:
            _give_back_now_and_then()

    return group


def lean_cogroup(f):
    """For applyInArrow on the groups of two tables."""

    def cogroup(table, other):
        drop_models()
        try:
            return f(table, other)
        finally:
            _give_back_now_and_then()

    return cogroup
