"""Tables that don't read each other are stored at the same time."""

import threading
from pathlib import Path

import pytest

from metrigraph.estate import graph
from metrigraph.plans import estate
from metrigraph.storage import keep, together

SF = "/root/testdata/sf0.001"


def test_together_keeps_order_and_runs_at_once():
    meet = threading.Barrier(3, timeout=10)

    def wait(x):
        meet.wait()
        return x

    assert together(wait, "a", "b", "c") == ["a", "b", "c"]


def test_together_raises_what_one_raises():
    with pytest.raises(ZeroDivisionError):
        together(lambda n: 1 // n, 1, 0)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_extracts_of_a_build_are_stored_at_once(spark):
    meet, lock, at_once = threading.Barrier(5), threading.Lock(), []

    class Enough(Exception):
        pass

    def stored(df):
        with lock:
            at_once.append(df.columns)
        meet.wait(timeout=60)
        keep(df.limit(1))
        raise Enough

    with pytest.raises(Enough):
        graph.build(estate.bundle(spark, SF), keep=stored)
    assert len(at_once) == 5
