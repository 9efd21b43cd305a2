"""Byte-level word tools shared by the operators: no per-word Python where numpy can do it.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; only A-Z is lower-cased, so UTF-8
can be handled as bytes throughout.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Also between words: every ASCII byte that is no letter or digit.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))
#: Bytes that are tokenised at once: the arrays of one slice stay within a few dozen megabytes.
SLICE_BYTES = 1 << 20
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64, so that near values spread over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
BYTE_HASH, BYTE_HASH_LOWER = _BYTE, _BYTE[LOWER]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r**i and r**-i modulo 2**64 for i up to n."""
    if "r" not in _powers or len(_powers["r"]) <= n:
        m = max(n + 1, SLICE_BYTES * 2)
        for name, r in (("r", _R), ("inv", _R_INV)):
            p = np.full(m, r, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["r"], _powers["inv"]


def prefix_hash(buf: np.ndarray, table: np.ndarray) -> np.ndarray:
    """P with P[i] the polynomial hash of buf[:i]; see span_hash."""
    p = np.empty(len(buf) + 1, np.uint64)
    p[0] = 0
    np.cumsum(table[buf] * powers(len(buf))[0][: len(buf)], out=p[1:])
    return p


def span_hash(p: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end], equal for equal bytes wherever they stand."""
    return mix((p[ends] - p[starts]) * powers(len(p))[1][starts] + (ends - starts).astype(np.uint64))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about `most` bytes together, at least one text each."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j
        i = j


def words(buf: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (runs of bytes not in `space`), and how many each text has."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs) - 1, np.int64)
    solid = ~space[buf]
    first = np.zeros(n + 1, bool)
    first[offs] = True
    starts = np.flatnonzero(solid & np.concatenate(([True], ~solid[:-1])) | solid & first[:n])
    ends = np.flatnonzero(solid & (np.concatenate((~solid[1:], [True])) | first[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offs))


@cache
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda n: 0)


def release() -> None:
    """Gives freed memory back to the system: a worker lives on for other tasks, beside those of its executor."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Of batches sorted by a long key: tables that hold whole groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        keys = batch[key].to_numpy(zero_copy_only=False)
        if held[0][key][0].as_py() == keys[-1]:
            continue
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        done = [*held[:-1], batch.slice(0, cut)]
        held = [batch.slice(cut)]
        table = [pa.Table.from_batches(done).combine_chunks()]
        del done, keys
        batch = None
        yield table.pop()  # nothing here holds what was yielded
    if held:
        table = [pa.Table.from_batches(held).combine_chunks()]
        held, batch = [], None
        yield table.pop()
