"""A watched pointer's settling, and one maker for a cached table."""

import threading
import time

import pytest

from quillon.sources import tables
from quillon.streaming import events as streams


def test_a_burst_of_changes_is_one_load():
    state, loads, clock = {"m": 1}, [], [0.0]
    w = streams.Watched(lambda: state["m"], lambda: loads.append(state["m"]) or state["m"], settle=0.1, now=lambda: clock[0])
    assert w.get() == 1
    for m in (2, 3, 4):
        state["m"] = m
        clock[0] += 0.05
        assert w.get() == 1
    clock[0] += 0.2
    assert w.get() == 4 and w.get() == 4 and loads == [1, 4]


def test_a_failed_load_keeps_what_was_there():
    state = {"m": 1}

    def load():
        if state["m"] == 2:
            raise OSError("half written")
        return state["m"]

    w = streams.Watched(lambda: state["m"], load)
    assert w.get() == 1
    state["m"] = 2
    with pytest.raises(OSError):
        w.get()
    assert w.value == 1
    state["m"] = 3
    assert w.get() == 3


def test_one_caller_makes_a_cached_table(spark, tmp_path):
    store, made = tables.Store(spark, str(tmp_path)), []

    def make():
        made.append(1)
        time.sleep(1)
        return spark.range(4)

    got = []
    callers = [threading.Thread(target=lambda: got.append(tables.cached(store, {"q": 1}, make).count())) for _ in range(3)]
    for c in callers:
        c.start()
    for c in callers:
        c.join()
    assert got == [4, 4, 4] and len(made) == 1 and not any(n.endswith(".lock") for n in store.names())
    store.claim("key=" + tables.cache_key("cache", {"q": 2}) + ".lock")
    with pytest.raises(tables.SealError):
        tables.cached(store, {"q": 2}, make, patience=0.1)
