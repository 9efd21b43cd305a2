"""SimHash near-duplicate detection by bit-sliced comparison.

Fingerprints lie in vertical bit planes: word w of plane p holds bit p of 64 fingerprints. A query is
compared with a whole block at once: its bits are XORed into the planes, three planes at a time pass a
carry-save adder into bitwise counters, and the query leaves a block as soon as every counter has passed
the radius. Counters start at 2**k-1-radius, so that a carry out of the top bit means "over".

Which blocks meet:
* `link_close`, radius <= 3: pigeonhole. 64 bits in radius+2 parts; two fingerprints within the radius
  agree on at least two parts, so each pair of parts is a table of exact keys. Keys with very many
  fingerprints are split again by the pigeonhole over the remaining bits. Nothing is dropped.

`near_duplicates` joins texts of close fingerprints to clusters by `link_close`, and to these, as fingerprints alone miss
pairs, those that share a shingle of their prefixes (loss-free for the least similarity); within a cluster, exact Jaccard
similarity decides, in blocks of bounded size.

Defined results: null text is empty text; a text with fewer words than a shingle is one shingle; a text
without words has fingerprint zero and links like any other. Repeated rows share a fingerprint and
so a component. A null id never names a component while its component has another id. Rows that share
an id count as one node of `groups`, not of `near_duplicates`. Very long texts are shingled whole. Of a tie (rows of
one id that `keep_one` could keep) the text of the smaller key stays. Extra columns of any name are ignored by
`fingerprints` and kept by `keep_one`; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import string
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrigraph.llm._graph import components, forest
from metrigraph.llm._text import release, whole_groups
from metrigraph.storage import fresh, keep

#: Fingerprints in one block of planes; queries that go through a block together.
BLOCK, TOGETHER = 8192, 64
#: Shingles of all rows of a block in which near duplicates are verified.
SET_ROWS = 1_500_000.0
#: Shingles that a worker holds at once, and bytes of text a bucket of shingles.
HELD, BUCKET_BYTES = 1_000_000, 8 << 20
#: Bits in which fingerprints of near duplicates may differ to be joined by these.
NEAR_BITS = 3
#: Texts that a worker holds at once: their numbers fit 16 bits.
TEXTS = 60_000
#: Bits of a sketch at most.
SKETCH_BITS = 1 << 15
#: Rows of one pigeonhole key beyond which it is split by its remaining bits.
HOT_KEY = 20_000
#: Ids from here on stand for rows whose id is null.
NO_ID = 1 << 62


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """Big-endian XXH64 (seed 42) of each shingle, as 8 bytes each."""
    ws = text.lower().split()
    if not ws:
        return np.zeros(0, ">u8")
    joined = b" ".join(ws)
    if len(ws) <= shingle:
        return np.frombuffer(xxhash.xxh64_digest(joined, 42), ">u8")
    lens = np.fromiter(map(len, ws), np.int64, len(ws))
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[: len(ws) - shingle + 1].tolist()
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[s:e], 42) for s, e in zip(starts, ends[shingle - 1 :].tolist())]), ">u8")


def fingerprint(hashes: np.ndarray) -> int:
    """Signed 64-bit integer of the bits that are set in over half the hashes."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n).view(">i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp, n_shingles) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sizes = [], []
            for text in batch["text"].cast(pa.large_binary()):
                h = shingle_hashes(text.as_py() or b"", shingle)
                fps.append(fingerprint(h))
                sizes.append(len(h))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(fps, pa.int64()), pa.array(sizes, pa.int64())], ["id", "fp", "n_shingles"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long, n_shingles long")


def planes(fps: np.ndarray) -> np.ndarray:
    """64 planes of ceil(n/64) words; rows of padding repeat the last fingerprint."""
    padded = np.concatenate((fps, np.full(-len(fps) % 64, fps[-1], np.uint64)))
    bits = np.unpackbits(padded.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(np.ascontiguousarray(bits.T), axis=1).view(np.uint64)


def close(queries: np.ndarray, vertical: np.ndarray, n: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of all pairs of at most `radius` differing bits; vertical: planes() of n fingerprints."""
    k, width, ones = radius.bit_length(), vertical.shape[1], np.uint64(2**64 - 1)
    bits = np.unpackbits(queries.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    masks = bits.astype(np.uint64) * ones
    found_q, found_r = [], []
    for at in range(0, len(queries), TOGETHER):
        mask, who = masks[at : at + TOGETHER], np.arange(at, min(at + TOGETHER, len(queries)))
        over = np.zeros((len(who), width), np.uint64)
        count = [np.full_like(over, ones if (2**k - 1 - radius) >> t & 1 else 0) for t in range(k)]

        def add(carry: np.ndarray, weight: int) -> np.ndarray:
            for t in range(weight, k):
                up = count[t] & carry
                count[t] ^= carry
                carry = up
            return carry

        p = 0
        while p < 64 and len(who):
            x = vertical[p] ^ mask[:, p, None]
            if p + 2 < 64:
                y, z = vertical[p + 1] ^ mask[:, p + 1, None], vertical[p + 2] ^ mask[:, p + 2, None]
                half = x ^ y
                over |= add((x & y) | (half & z), 1)
                over |= add(half ^ z, 0)
            else:
                over |= add(x, 0)
            p += 3 if p + 2 < 64 else 1
            if p % 6 == 0 and p > 4 * radius // 2 + 6:
                live = (over != ones).any(axis=1)
                if not live.all():
                    who, mask, over = who[live], mask[live], over[live]
                    count = [c[live] for c in count]
        if len(who):
            hit = ~over
            q, w = np.nonzero(hit)
            b = np.unpackbits(hit[q, w].view(np.uint8).reshape(-1, 8), axis=1)
            i, j = np.nonzero(b)
            rows = w[i] * 64 + j
            inside = rows < n
            found_q.append(who[q[i[inside]]])
            found_r.append(rows[inside])
    empty = np.zeros(0, np.int64)
    return (np.concatenate(found_q), np.concatenate(found_r)) if found_q else (empty, empty)


def _within_groups(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows with equal key (sorted) and close fingerprints; of big groups a spanning part of each block."""
    cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    sizes = np.diff(cuts)
    a, b = [], []
    small = np.flatnonzero((sizes > 1) & (sizes <= 64))
    for shift in range(1, int(sizes[small].max(initial=1))):  # a few rows gain nothing from planes
        at = small[sizes[small] > shift]
        n = sizes[at] - shift
        i = np.repeat(cuts[at] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        i = i[np.bitwise_count(fps[i] ^ fps[i + shift]) <= radius]
        a.append(i)
        b.append(i + shift)
    for g in np.flatnonzero(sizes > 64):
        for y in range(cuts[g], cuts[g + 1], BLOCK):
            end = min(y + BLOCK, cuts[g + 1])
            vertical = planes(fps[y:end])
            for x in range(cuts[g], end, BLOCK):
                q, r = close(fps[x : min(x + BLOCK, end)], vertical, end - y, radius)
                q, r = q + x, r + y
                i, j = forest(q[q < r], r[q < r])
                a.append(i)
                b.append(j)
    empty = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def link_close(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (u, v) that connect all fingerprints of nodes (node, fp: distinct) within the radius."""
    if not 0 <= radius <= 3:
        raise ValueError("link_close serves a radius of 0 to 3")
    n = radius + 2
    width = [64 // n + (i < 64 % n) for i in range(n)]
    low = [sum(width[:i]) for i in range(n)]
    part = lambda i: F.shiftrightunsigned("fp", low[i]).bitwiseAND((1 << width[i]) - 1)
    keys = [F.xxhash64(F.lit(t), part(i), part(j)) for t, (i, j) in enumerate(combinations(range(n), 2))]
    dealt = nodes.select("node", "fp", F.posexplode(F.array(*keys)).alias("t", "key"))
    hot = dealt.groupBy("key").count().where(F.col("count") > HOT_KEY).select("key", F.lit(True).alias("hot"))
    rest = [[p for p in range(n) if p not in pair] for pair in combinations(range(n), 2)]

    # The remaining parts are n-2 = radius; cut into radius+1 pieces, one of which two close fingerprints share.
    def pieces(parts: list[int]):
        bits = [(low[p] + i) for p in parts for i in range(width[p])]
        cut = [bits[len(bits) * i // (radius + 1) : len(bits) * (i + 1) // (radius + 1)] for i in range(radius + 1)]
        masks = [sum(1 << b for b in c) for c in cut]
        return F.array(*[F.xxhash64("key", F.lit(i), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for i, m in enumerate(masks)])

    again = F.coalesce(*[F.when(F.col("t") == t, pieces(parts)) for t, parts in enumerate(rest)])
    dealt = dealt.join(hot, "key", "left").select("node", "fp", F.explode(F.when(F.col("hot"), again).otherwise(F.array("key"))).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "key"):
            node = t["node"].to_numpy()
            i, j = _within_groups(t["key"].to_numpy(), t["fp"].to_numpy().view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], ["u", "v"])

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, "u long, v long").distinct()


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(id, fp, component) of every row of df: component is the smallest id reachable over links."""
    fps = keep(fingerprints(df, id_col, text_col, shingle).select("id", "fp"))
    nodes = keep(fps.groupBy("fp").agg(F.coalesce(F.min("id"), F.lit(NO_ID) + F.pmod(F.xxhash64("fp"), F.lit(1 << 61))).alias("node")))
    found = components(link_close(nodes, radius), "u", "v")
    labels = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("c"))
    return fps.join(labels, "fp").select("id", "fp", F.when(F.col("c") < NO_ID, F.col("c")).alias("component"))


def op9(spark, sf_dir: str) -> DataFrame:
    out = groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def _key(text: bytes) -> bytes:
    """md5 of the words, equal for texts that differ in case and white space only."""
    return hashlib.md5(b" ".join(text.lower().split()), usedforsecurity=False).digest()


def _node(key: bytes) -> int:
    """A text's node: 63 bits of its key, whatever the ids of its rows."""
    return int.from_bytes(key[:8], "big") >> 1


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of how many shingles fall to each of B bits, as words: sets that differ in d shingles differ in at most d bits."""
    bits = 64
    while bits * 4 < 3 * len(shingles) and bits < SKETCH_BITS:
        bits *= 2
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _rows(df: DataFrame, shingle: int) -> DataFrame:
    """(id, key, node, n, fp, sketch) of every row of df (id, text); n: distinct shingles, fp: fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, fps, bits = [], [], [], []
            for text in batch["text"].cast(pa.large_binary()):
                body = text.as_py() or b""
                hashes = shingle_hashes(body, shingle)
                fps.append(fingerprint(hashes))
                u = np.unique(hashes.astype(np.uint64))
                keys.append(_key(body))
                sizes.append(len(u))
                bits.append(sketch(u).tobytes())
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(keys, pa.binary()), pa.array([_node(k) for k in keys], pa.int64()), pa.array(sizes, pa.int64()), pa.array(fps, pa.int64()), pa.array(bits, pa.binary())], ["id", "key", "node", "n", "fp", "sketch"])

    return df.mapInArrow(run, "id long, key binary, node long, n long, fp long, sketch binary")


def _close_texts(rows: DataFrame, radius: int) -> DataFrame:
    """(u, v): links that join all nodes of rows (node, fp) whose fingerprints are equal or within the radius."""
    first = keep(rows.groupBy("fp").agg(F.min("node").alias("node")))
    equal = rows.join(first.select("fp", F.col("node").alias("u")), "fp").where("node <> u").select("u", F.col("node").alias("v")).distinct()
    return link_close(first, radius).union(equal)


def _sets(df: DataFrame, shingle: int, wanted) -> DataFrame:
    """(node, shingles) of the rows of df (id, text) whose node's bit is set in the broadcast `wanted`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, blobs = [], []
            for text in batch["text"].cast(pa.large_binary()):
                body = text.as_py() or b""
                node = _node(_key(body))
                at = node & (BITS - 1)
                if wanted.value[at >> 3] >> (at & 7) & 1:
                    nodes.append(node)
                    blobs.append(np.unique(shingle_hashes(body, shingle).astype(np.uint64)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(blobs, pa.binary())], ["node", "shingles"])

    return df.mapInArrow(run, "node long, shingles binary")


def prefix_length(n, least: float):
    """Shingles of a set of n, in any common order, one of which is among those of every set of similarity >= least."""
    return n - np.ceil(least * n - 1e-9).astype(np.int64) + 1


def _shingled(batches: Iterator[pa.RecordBatch], shingle: int, wanted=None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(nodes, sizes, shingles) of some texts at a time, each text's shingles distinct and in order.

    wanted: a broadcast bitmap of the nodes to look at; others may come along where bits collide.
    """
    nodes, sets, held = [], [], 0
    for batch in batches:
        for text in batch["text"].cast(pa.large_binary()):
            body = text.as_py() or b""
            node = _node(_key(body))
            at = node & (BITS - 1)
            if wanted is not None and not wanted.value[at >> 3] >> (at & 7) & 1:
                continue
            nodes.append(node)
            sets.append(np.unique(shingle_hashes(body, shingle).astype(np.uint64)))
            held += len(sets[-1])
            if held > HELD or len(nodes) == TEXTS:
                out = [(np.array(nodes, np.int64), np.array(list(map(len, sets))), np.concatenate(sets))]
                nodes, sets, held = [], [], 0
                yield out.pop()  # nothing here holds what was yielded
                release()
    if nodes:
        out = [(np.array(nodes, np.int64), np.array(list(map(len, sets))), np.concatenate(sets))]
        del nodes, sets
        yield out.pop()
    release()


def _blobs(of: np.ndarray, buckets: int, *columns: np.ndarray) -> Iterator[tuple]:
    """(bucket, bytes of each column) of rows whose bucket is `of`."""
    order = np.argsort(of, kind="stable")
    cut = np.searchsorted(of[order], np.arange(buckets + 1))
    columns = [c[order] for c in columns]
    for b in range(buckets):
        if cut[b] < cut[b + 1]:
            yield b, *[c[cut[b] : cut[b + 1]].tobytes() for c in columns]


_SENT = ["bucket", "uid", "h", "c", "nodes", "sizes", "sets"]
_KINDS = [pa.int64(), pa.int64(), *[pa.binary()] * 5]
_SCHEMA = "bucket long, uid long, h binary, c binary, nodes binary, sizes binary, sets binary"
_SEVERAL = np.uint16(0xFFFF)


def _aside(uid: int, buckets: int) -> int:
    """A bucket beyond those of shingles, so that a worker's texts are spread as they pass."""
    return buckets + ((uid >> 32) * 31 + (uid & 0xFFFFFFFF)) % buckets


def _rows_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_KINDS)], _SENT)


def _deal(df: DataFrame, column: str) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, column).sortWithinPartitions(column)


def _open(df: DataFrame, buckets: int, shingle: int, least: float) -> DataFrame:
    """(node) of texts of which fewer shingles are nobody else's than a prefix has: no other text can be similar to the rest.

    Workers send 32 bits of each distinct shingle of a few thousand texts once, with its text if it has one only; buckets
    of shingles tell which of these come nowhere else (where bits collide a text is let in in vain). A shingle of very many
    texts is an entry a worker's batch.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for number, (nodes, sizes, sets) in enumerate(_shingled(batches, shingle)):
            h, first, times = np.unique(sets, return_index=True, return_counts=True)
            owner = np.where(times == 1, np.repeat(np.arange(len(nodes), dtype=np.uint16), sizes)[first], _SEVERAL).astype(np.uint16)
            uid = task | number
            rows = [(b, uid, x, t, None, None, None) for b, x, t in _blobs((h % np.uint64(buckets)).astype(np.int64), buckets, (h >> np.uint64(32)).astype(np.uint32), owner)]
            rows.append((_aside(uid, buckets), uid, None, None, nodes.tobytes(), sizes.tobytes(), None))  # passes the buckets by
            del nodes, sizes, sets, h, first, times, owner
            sent = [_rows_of(rows)]
            del rows
            yield sent.pop()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "bucket"):
            of = table["bucket"].to_numpy()
            for b in np.unique(of):
                part = table.filter(pa.array(of == b))
                if b >= buckets:
                    yield from part.to_batches()
                    continue
                h = [np.frombuffer(x.as_py(), np.uint32) for x in part["h"]]
                _, at, times = np.unique(np.concatenate(h), return_inverse=True, return_counts=True)
                alone = np.split(times[at] == 1, np.cumsum([len(x) for x in h])[:-1])
                rows = []
                for uid, c, one in zip(part["uid"].to_pylist(), part["c"], alone, strict=True):
                    owner = np.frombuffer(c.as_py(), np.uint16)
                    u, n = np.unique(owner[one & (owner != _SEVERAL)], return_counts=True)
                    if len(u):
                        rows.append((0, uid, u.tobytes(), n.astype(np.uint32).tobytes(), None, None, None))
                del h, at, times, alone, part
                sent = [_rows_of(rows)]
                del rows
                yield sent.pop()
            del table, of
            release()

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "uid"):
            of = table["uid"].to_numpy()
            for uid in np.unique(of):
                part = table.filter(pa.array(of == uid)).to_pylist()
                (own,) = [r for r in part if r["nodes"] is not None]
                nodes, sizes = np.frombuffer(own["nodes"], np.int64), np.frombuffer(own["sizes"], np.int64)
                alone = np.zeros(len(nodes), np.int64)
                for r in part:
                    if r["nodes"] is None:
                        alone[np.frombuffer(r["h"], np.uint16)] += np.frombuffer(r["c"], np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[(sizes > 0) & (alone < prefix_length(sizes, least))])], ["node"])

    met = _deal(df.mapInArrow(send, _SCHEMA), "bucket").mapInArrow(meet, _SCHEMA)
    return _deal(met, "uid").mapInArrow(told, "node long").distinct()


def least_node(t: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles with their smallest node, and links that join the nodes of each shingle."""
    order = np.argsort(t, kind="stable")
    t, v = t[order], v[order]
    first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))[: len(t)])
    if not len(first):
        none = np.zeros(0, np.int64)
        return t, v, none, none
    low = np.minimum.reduceat(v, first)
    each = np.repeat(low, np.diff(np.concatenate((first, [len(t)]))))
    return t[first], low, *forest(v[v != each], each[v != each])


def _linked(df: DataFrame, wanted, buckets: int, shingle: int, least: float) -> DataFrame:
    """(u, v): links that join all texts whose prefixes share a shingle; the rarest shingles come first in a prefix.

    Only texts that `wanted` lets in are looked at, and how many of them hold a shingle is counted exactly, so texts that
    share a common passage and little else don't meet. Shingles of one text link nothing and go no further.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for number, (nodes, sizes, sets) in enumerate(_shingled(batches, shingle, wanted)):
            h, times = np.unique(sets, return_counts=True)
            uid = task | number
            rows = [(b, uid, x, c, None, None, None) for b, x, c in _blobs((h % np.uint64(buckets)).astype(np.int64), buckets, h, times.astype(np.uint32))]
            rows.append((_aside(uid, buckets), uid, None, None, nodes.tobytes(), sizes.tobytes(), sets.tobytes()))
            del nodes, sizes, sets, h, times
            sent = [_rows_of(rows)]
            del rows
            yield sent.pop()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "bucket"):
            of = table["bucket"].to_numpy()
            for b in np.unique(of):
                part = table.filter(pa.array(of == b))
                if b >= buckets:
                    yield from part.to_batches()
                    continue
                h = [np.frombuffer(x.as_py(), np.uint64) for x in part["h"]]
                c = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in part["c"]])
                _, at = np.unique(np.concatenate(h), return_inverse=True)
                holders = np.bincount(at, c)[at].astype(np.uint32)
                del at, c
                sent = [_rows_of([(0, uid, x.tobytes(), n.tobytes(), None, None, None) for uid, x, n in zip(part["uid"].to_pylist(), h, np.split(holders, np.cumsum([len(x) for x in h])[:-1]), strict=True)])]
                del h, holders, part
                yield sent.pop()
            del table, of
            release()

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "uid"):
            of = table["uid"].to_numpy()
            for uid in np.unique(of):
                part = table.filter(pa.array(of == uid)).to_pylist()
                (own,) = [r for r in part if r["nodes"] is not None]
                known = [(np.frombuffer(r["h"], np.uint64), np.frombuffer(r["c"], np.uint32)) for r in part if r["nodes"] is None]
                if not known:
                    continue
                h, n = (np.concatenate(x) for x in zip(*known, strict=True))
                order = np.argsort(h)
                h, n = h[order], n[order]
                nodes, sizes, sets = (np.frombuffer(own[k], t) for k, t in (("nodes", np.int64), ("sizes", np.int64), ("sets", np.uint64)))
                owner, holders = np.repeat(np.arange(len(nodes)), sizes), n[np.searchsorted(h, sets)]
                order = np.lexsort((sets, holders, owner))
                place = np.arange(len(sets)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                some = order[(place < prefix_length(sizes, least)[owner]) & (holders[order] > 1)]
                t, low, u, v = least_node(sets[some], nodes[owner[some]])
                rows = [(b, 0, x, y, None, None, None) for b, x, y in _blobs((t % np.uint64(buckets)).astype(np.int64), buckets, t, low)]
                if len(u):  # links go to buckets of their own, spread by their number
                    rows.append((buckets + int(u[0]) % buckets, 0, u.tobytes(), v.tobytes(), None, None, None))
                del part, own, known, h, n, sets, owner, holders, order, place, some, t, low
                sent = [_rows_of(rows)]
                del rows
                yield sent.pop()
            del table, of
            release()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "bucket"):
            of = table["bucket"].to_numpy()
            for b in np.unique(of):
                part = table.filter(pa.array(of == b))
                x, y = (np.concatenate([np.frombuffer(z.as_py(), k) for z in part[c]]) for c, k in (("h", np.uint64), ("c", np.int64)))
                u, v = least_node(x, y)[2:] if b < buckets else forest(x.astype(np.int64), y)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    met = _deal(df.mapInArrow(send, _SCHEMA), "bucket").mapInArrow(meet, _SCHEMA)
    sent = _deal(met, "uid").mapInArrow(prefixes, _SCHEMA)
    return _deal(sent, "bucket").mapInArrow(join, "u long, v long")


def _tasks(members: DataFrame, least: float) -> DataFrame:
    """members (node, n, sketch, cluster) dealt to tasks (node, n, sketch, side, task).

    A cluster is one task if it fits a block. In larger ones size classes meet themselves and the next, in blocks of
    bounded size.
    """
    s = members.withColumn("s", F.floor(F.log(F.greatest("n", F.lit(1))) / math.log(1 / least)).cast("int"))
    # A block holds at most BLOCK rows and about SET_ROWS shingles, but 64 rows at least.
    block = F.greatest(F.lit(64.0), F.least(F.lit(float(BLOCK)), SET_ROWS / F.pow(F.lit(1 / least), F.col("s") + 1)))
    sizes = keep(s.groupBy("cluster", "s").agg(F.count("*").alias("rows"), F.sum("n").alias("all")))
    large = sizes.groupBy("cluster").agg(F.sum("rows").alias("r"), F.sum("all").alias("a")).where((F.col("r") > BLOCK) | (F.col("a") > SET_ROWS)).select("cluster")
    sizes = keep(sizes.join(large, "cluster").select("cluster", "s", F.ceil(F.col("rows") / block).cast("int").alias("chunks")))
    after = sizes.select("cluster", (F.col("s") - 1).alias("s"), F.col("chunks").alias("next"))
    before = sizes.select("cluster", (F.col("s") + 1).alias("s"), F.col("chunks").alias("last"))
    sizes = sizes.join(after, ["cluster", "s"], "left").join(before, ["cluster", "s"], "left").na.fill(0, ["next", "last"])
    seq = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    # A task's number tells cluster, class, kind and both chunks; sides 0 and 1 meet, side 2 meets itself.
    task = lambda side, of, kind, a, b: F.struct(F.lit(side).alias("side"), F.xxhash64("cluster", of, F.lit(kind), a, b).alias("task"))
    i = F.col("mine")
    same = F.transform(seq(F.col("chunks")), lambda j: F.when(j == i, task(2, F.col("s"), 0, i, i)).otherwise(F.when(i < j, task(0, F.col("s"), 0, i, j)).otherwise(task(1, F.col("s"), 0, j, i))))
    forth = F.transform(seq(F.col("next")), lambda j: task(0, F.col("s"), 1, i, j))
    back = F.transform(seq(F.col("last")), lambda j: task(1, F.col("s") - 1, 1, j, i))
    whole = F.array(F.struct(F.lit(2).alias("side"), F.xxhash64("cluster").alias("task")))
    s = s.join(F.broadcast(sizes), ["cluster", "s"], "left").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))  # a few rows a cluster beyond a block
    return s.select("node", "n", "sketch", F.explode(F.when(F.col("chunks").isNull(), whole).otherwise(F.concat(same, forth, back))).alias("t")).select("node", "n", "sketch", "t.side", "t.task")


def fitting(sketches: list[bytes], n: np.ndarray, side: np.ndarray, least: float) -> np.ndarray:
    """Which sets may have one of Jaccard similarity >= least: their sketches differ in no more bits than that allows."""
    some, width = np.zeros(len(n), bool), np.array([len(x) // 8 for x in sketches])
    alike = (1 - least) / (1 + least)
    rows = {w: np.flatnonzero(width == w) for w in np.unique(width).tolist()}
    words = {w: np.frombuffer(b"".join([sketches[i] for i in at]), np.uint64).reshape(-1, w) for w, at in rows.items()}
    for w, left in rows.items():
        for x, right in rows.items():
            if x < w:
                continue
            # A wider sketch folds to a narrower one.
            other = np.bitwise_xor.reduce(words[x].reshape(len(right), x // w, w), axis=1)
            step = max(1, (1 << 20) // (len(right) * w))
            for a in range(0, len(left), step):
                mine = left[a : a + step]
                differ = np.bitwise_count(words[w][a : a + step, None, :] ^ other[None]).sum(axis=2, dtype=np.int32)
                ok = differ <= alike * (n[mine][:, None] + n[right][None, :]) + 1e-6
                ok &= mine[:, None] != right[None, :]
                q, r = np.nonzero(ok)
                q, r = mine[q], right[r]
                fit = (np.minimum(n[q], n[r]) >= least * np.maximum(n[q], n[r])) & ((side[q] == 2) | (side[q] != side[r]))
                some[q[fit]] = some[r[fit]] = True
    return some


def _candidates(tasks: DataFrame, least: float) -> DataFrame:
    """(node, side, task) of the rows of each task that have a candidate there: never pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "task"):
            task, n, side = (table[c].to_numpy() for c in ("task", "n", "side"))
            bits = table["sketch"].to_pylist()
            cuts = np.flatnonzero(np.concatenate(([True], task[1:] != task[:-1], [True]))).tolist()
            found = [np.flatnonzero(fitting(bits[a:b], n[a:b], side[a:b], least)) + a for a, b in zip(cuts, cuts[1:])]  # noqa: B905
            yield from table.select(["node", "side", "task"]).take(pa.array(np.concatenate(found))).combine_chunks().to_batches()

    parts = int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keep(tasks.repartition(parts, "task").sortWithinPartitions("task").mapInArrow(run, "node long, side int, task long"))


def similar(sets: list[np.ndarray], side: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links that join all of the sets with Jaccard similarity >= least: of sides 0 and 1, or of side 2 with itself.

    Sets that are joined already aren't compared again, so m sets give fewer than m links.
    """
    m, n = len(sets), np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(m), n)
    if m < 2 or not len(owner):
        return []
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    holders = owner[np.argsort(at, kind="stable")]
    start = np.concatenate(([0], np.cumsum(times)))
    first = np.concatenate(([0], np.cumsum(n)))
    order = np.lexsort((at, times[at], owner))  # rare shingles first
    label, links = np.arange(m), []
    prefix = prefix_length(n, least)
    inside = np.zeros(len(owner), bool)
    for x in np.flatnonzero(n).tolist():
        inside[order[first[x] : first[x] + prefix[x]]] = True
    # Holders of each shingle in whose prefix it is.
    by = np.argsort(at, kind="stable")
    short, many = owner[by[inside[by]]], np.bincount(at[inside], minlength=len(times))
    short_start = np.concatenate(([0], np.cumsum(many)))

    def holding(shingles: np.ndarray, of: np.ndarray, begin: np.ndarray) -> np.ndarray:
        size = begin[shingles + 1] - begin[shingles]
        return of[np.repeat(begin[shingles] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())]

    for x in np.flatnonzero(n).tolist():
        mine = at[first[x] : first[x + 1]]
        seen = np.zeros(m, bool)
        seen[holding(at[order[first[x] : first[x] + prefix[x]]], short, short_start)] = True
        seen[:x + 1] = False
        seen &= label != label[x]
        if side[x] != 2:
            seen &= side != side[x]
        seen &= np.minimum(n, n[x]) >= least * np.maximum(n, n[x])
        some = np.flatnonzero(seen)
        if not len(some):
            continue
        if len(some) < 8:
            both = np.array([np.isin(sets[y], sets[x], assume_unique=True).sum() for y in some])
        else:
            both = np.bincount(holding(mine, holders, start), minlength=m)[some]
        for y in some[both >= least * (n[some] + n[x] - both)].tolist():
            if label[y] != label[x]:
                links.append((x, y))
                label[label == label[y]] = label[x]
    return links


def _verified(rows: DataFrame, least: float) -> DataFrame:
    """(u, v): links that join all rows (node, side, task, shingles) of a task whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "task"):
            task, node, side = (table[c].to_numpy() for c in ("task", "node", "side"))
            cuts = np.flatnonzero(np.concatenate(([True], task[1:] != task[:-1], [True]))).tolist()
            links = []
            for a, b in zip(cuts, cuts[1:]):  # noqa: B905
                sets = [np.frombuffer(x.as_py(), np.uint64) for x in table["shingles"].slice(a, b - a)]
                links += [(x + a, y + a) for x, y in similar(sets, side[a:b], least)]
            if links:
                u, v = (node[list(e)] for e in zip(*links, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keep(rows.repartition(parts, "task").sortWithinPartitions("task").mapInArrow(run, "u long, v long"))


#: Bits of a bitmap of places. Fixed: 2 MB are broadcast whatever the corpus.
BITS = 1 << 24


def _bitmap(places: DataFrame) -> np.ndarray:
    """Bytes whose bit p is set for every place p < BITS."""
    got = places.groupBy(F.expr("shiftright(p, 3)").alias("w")).agg(F.expr("bit_or(shiftleft(1, cast(p & 7 as int)))").alias("b")).toArrow()
    bitmap = np.zeros(BITS // 8, np.uint8)
    bitmap[got["w"].to_numpy()] = got["b"].to_numpy()
    return bitmap


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """(id, key, component) of every row: groups of texts with Jaccard similarity >= least of their word shingles.

    Texts of close fingerprints are joined first, by bit-sliced comparison. That finds most near copies but misses pairs, so
    prefixes complete it: a text whose own shingles, that no other text holds, fill its prefix has no similar text, and every pair of similar
    texts shares a shingle of both prefixes, so it lies in one cluster of texts that such shingles join. Sketches, which lose no similar pair either, tell which texts of a cluster's tasks have a candidate
    there; only their sets travel to the tasks, where similarity is exact. No pair is ever a row.
    A component is named by a node of it.
    """
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = 16
    while buckets * BUCKET_BYTES < size:
        buckets *= 2
    rows = keep(_rows(texts, shingle))
    lets = _bitmap(_open(texts, buckets, shingle, least).select(F.col("node").bitwiseAND(BITS - 1).alias("p")))
    wanted = df.sparkSession.sparkContext.broadcast(lets)
    links = _close_texts(rows.select("node", "fp"), NEAR_BITS).union(_linked(texts, wanted, buckets, shingle, least))
    clusters = components(links, "u", "v").select("node", F.col("component").alias("cluster"))
    members = keep(rows.select("node", "n", "sketch").distinct().join(clusters, "node"))
    found = _candidates(_tasks(members, least), least)
    bitmap = _bitmap(found.select(F.col("node").bitwiseAND(BITS - 1).alias("p")))  # a false bit only computes a set too many
    sets = _sets(texts, shingle, df.sparkSession.sparkContext.broadcast(bitmap))
    sets = sets.groupBy("node").agg(F.first("shingles").alias("shingles"))
    links = _verified(found.join(sets, "node"), least)
    reach = components(links, "u", "v")
    return rows.join(reach, "node", "left").select("id", "key", F.coalesce("component", "node").alias("component"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """df, all its columns, with one row of each group: that of the smallest id. Of repeated rows one stays."""
    i, k, go = fresh(df, "_i", "_k", "_go")
    groups_ = keep(near_duplicates(df, id_col, text_col, shingle, least))
    win = groups_.groupBy("component").agg(F.min(F.struct(F.coalesce("id", F.lit(NO_ID)).alias("i"), "key")).alias("w"))
    each = groups_.groupBy(F.coalesce("id", F.lit(NO_ID)).alias(i), F.col("key").alias(k)).agg(F.count("*").alias("times"), F.min("component").alias("component"))
    each = each.join(win, "component").select(i, k, "times", ((F.col(i) == F.col("w.i")) & (F.col(k) == F.col("w.key"))).alias("stays"))
    each = keep(each.where("not stays or times > 1"))
    words_key = F.unhex(F.md5(F.trim(F.regexp_replace(F.translate(F.coalesce(F.col(text_col), F.lit("")), string.ascii_uppercase, string.ascii_lowercase), r"[\x20\x09-\x0D]+", " "))))
    place = F.pmod(F.xxhash64(i), F.lit(BITS))
    seen = df.sparkSession.sparkContext.broadcast(_bitmap(each.select(place.alias("p"))))

    @F.pandas_udf("boolean")
    def may_go(places: pd.Series) -> pd.Series:
        at = places.to_numpy()
        return pd.Series((seen.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    rows = df.withColumn(i, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))).withColumn(go, may_go(place))
    keyed = rows.where(F.col(go)).withColumn(k, words_key)  # only rows that may go are dealt out; the join decides
    out = rows.where(~F.col(go)).select(*df.columns).union(keyed.join(each.select(i, k), [i, k], "left_anti").select(*df.columns))
    repeated = each.where("stays and times > 1").select(i, k)
    if repeated.head(1):
        out = out.union(keyed.join(repeated, [i, k], "left_semi").dropDuplicates([i, k]).select(*df.columns))
    return out
