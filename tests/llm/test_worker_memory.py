"""What a worker holds while a batch is in use: the batch, not what it was made of."""

import tracemalloc
import weakref

import pyarrow as pa

from metrigraph.llm import simhash
from metrigraph.llm._text import release, whole_groups


def test_shingles_of_a_batch_are_held_once(monkeypatch):
    monkeypatch.setattr(simhash, "HELD", 40_000)
    texts = [" ".join(f"w{i}x{j}" for j in range(3_000)) for i in range(48)]
    list(simhash._shingled(iter([pa.RecordBatch.from_arrays([pa.array(texts[:1])], ["text"])]), 5))  # tables that stay
    batch, seen = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]), []
    tracemalloc.start()
    for nodes, _, sets in simhash._shingled(iter([batch]), 5):
        seen.append((len(nodes), sets.nbytes, tracemalloc.get_traced_memory()[0]))
        del sets
    tracemalloc.stop()
    assert len(seen) > 2 and sum(n for n, *_ in seen) == 48
    assert all(held < 1.6 * size for _, size, held in seen)


def test_groups_arent_held_beside_their_table():
    kept = []

    def batches():
        for k in range(3):
            b = pa.RecordBatch.from_arrays([pa.array([max(k - 1, 0)] + [k] * 2 if k else [0] * 3), pa.array(["a" * 1000] * 3)], ["key", "text"])
            kept.append(weakref.ref(b))
            yield b
            del b

    rows = 0
    for table in whole_groups(batches(), "key"):
        rows += table.num_rows
        assert all(r() is None for r in kept[:-1])
        del table
    assert rows == 9 and all(r() is None for r in kept)


def test_release_can_be_called_at_any_time():
    release()
    release()
