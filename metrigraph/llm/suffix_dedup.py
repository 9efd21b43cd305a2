"""Removal of repeated byte strings with suffix arrays.

Every byte covered by a string of `length` bytes that also starts elsewhere goes. Exactly and in bounded
memory:

1. Winnowing. Each string has an anchor: the leftmost least hash among its windows of GRAM bytes. Equal
   strings have equal anchors at equal places, so only strings whose anchor comes twice in the corpus can
   be repeated. Repeated anchor hashes set bits of a bitmap of fixed size, which is broadcast; a
   false bit costs work and never changes a result.
2. Contexts. The starts that share an anchor are a run; its context is the run's bytes. Equal contexts are
   one row with a count before anything is sorted, so groups of copies collapse map-side.
3. Parts. An anchor with more than HOT contexts (a common line, a passage with many surroundings) is split:
   its strings fall into PARTS ranges of the anchor's place in them, and all strings of a range hold the
   same stretch around the anchor, the core. Equal strings have equal cores, so a context's strings of one
   range are a context of their own under the core's hash, and cores that come once are dropped as in 1.
4. Shards. Contexts are dealt by anchor into shards of a few megabytes. A shard's suffix array comes from
   Larsson-Sadakane refinement (ranks double the sorted depth, only unresolved groups are sorted again), its common prefixes from Kasai's method run in lanes. Starts in one group of common prefix
   >= `length` are repeats.
5. Merging. A core with more than CHUNK contexts is split into several shards; each pair of them is
   merged by binary search of one shard's starts in the other's suffix array. Beyond PAIRED shards, where
   pairs would grow with the square, its strings (a range has few) are counted by md5 instead.
6. Repeated starts go back to their texts as intervals, whose union is removed.

Defined results: null text is empty; texts shorter than `length` lose nothing; a repeat may overlap itself;
repeated rows remove each other wholly if long enough; removal is by bytes, so `kept` may hold cut UTF-8
sequences; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrigraph.llm._text import BYTE_HASH, prefix_hash, slices, span_hash, utf8, whole_groups
from metrigraph.storage import keep

#: Bytes that a hash covers; contexts of one anchor in a shard; bytes of a shard; bits of the bitmap.
GRAM, CHUNK, SHARD, BITS = 50, 2048, 2 << 20, 1 << 26
#: Contexts beyond which an anchor is split, ranges it is split into, and shards of one core that are merged in pairs.
HOT, PARTS, PAIRED = 256, 8, 8
_PLACE = np.uint64((1 << 24) - 1)
#: Longer texts are winnowed in pieces, so that a place fits into _PLACE.
_PIECE = 8 << 20


def runs(buf: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last start of each run of strings with one anchor, the anchor's place after the first, and its hash."""
    n = len(buf)
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty, empty, np.zeros(0, np.uint64)
    at = np.arange(n - GRAM + 1)
    h = span_hash(prefix_hash(buf, BYTE_HASH), at, at + GRAM)
    key = h & ~_PLACE | at.astype(np.uint64)
    width, span = length - GRAM + 1, 1
    while span * 2 <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < width:
        key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
    anchor = (key & _PLACE).astype(np.int64)  # of the string that starts at each place
    valid = np.zeros(len(anchor) + 1, np.int64)
    ends = np.maximum(offs[1:] - length + 1, offs[:-1])
    np.add.at(valid, np.minimum(offs[:-1], len(anchor)), 1)
    np.add.at(valid, np.minimum(ends, len(anchor)), -1)
    valid = np.cumsum(valid[:-1]) > 0
    same = np.concatenate(([False], (anchor[1:] == anchor[:-1]) & valid[:-1]))
    first = np.flatnonzero(valid & ~same)
    last = np.flatnonzero(valid & ~np.concatenate((same[1:] & valid[1:], [False])))
    return first, last, anchor[first] - first, h[anchor[first]]


def cores(context: bytes, at: int, length: int) -> Iterator[tuple[int, int, int]]:
    """(hash of the core, begin, end) of each range of the context's strings; the anchor begins at `at`."""
    width = -(-(length - GRAM + 1) // PARTS)
    low = at - (len(context) - length)  # the anchor's place in the last string
    for r in range(low // width, at // width + 1):
        a, b = r * width, r * width + width - 1
        core = hashlib.md5(bytes([r]) + context[at - a : at - b + length], usedforsecurity=False).digest()
        yield int.from_bytes(core[:8], "little", signed=True), at - min(b, at), at - max(a, low) + length


def _pieces(column: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, number of the text, place in the text of each offset) of slices whose strings are all the texts'."""
    buf, offs = utf8(column)
    for i, j in slices(offs):
        if offs[j] - offs[i] <= _PIECE:
            yield buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], np.arange(i, j), np.zeros(j - i, np.int64)
        else:
            for a in range(offs[i], offs[j] - length + 1, _PIECE - length + 1):
                part = buf[a : min(a + _PIECE, offs[j])]
                yield part, np.array([0, len(part)]), np.array([i]), np.array([a - offs[i]])


def suffix_array(buf: np.ndarray) -> np.ndarray:
    """Places of buf in the order of the suffixes that begin there.

    The order is complete, beyond the length that is looked for: Kasai's bound holds only then.
    """
    n = len(buf)
    word = words8(buf)
    sa = np.argsort(word, kind="stable")
    head = np.concatenate(([True], word[sa[1:]] != word[sa[:-1]]))
    rank = np.zeros(n + 1, np.uint64)  # rank 0: beyond the end
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0)) + 1
    h = 8
    while True:
        open_ = ~(head & np.concatenate((head[1:], [True])))
        slots = np.flatnonzero(open_)
        if not len(slots):
            return sa
        pos = sa[slots]
        key = rank[pos] << np.uint64(32) | rank[np.minimum(pos + h, n)]
        order = np.argsort(key, kind="stable")
        pos, key = pos[order], key[order]
        sa[slots] = pos
        new = np.concatenate(([True], key[1:] != key[:-1]))
        head[slots] = new
        rank[pos] = np.maximum.accumulate(np.where(new, slots, 0)) + 1
        h *= 2


def words8(buf: np.ndarray) -> np.ndarray:
    """The next eight bytes of each place as a big-endian number."""
    padded = np.concatenate((buf, np.zeros(7, np.uint8))).astype(np.uint64)
    out = np.zeros(len(buf), np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | padded[k : k + len(buf)]
    return out


def _extend(word_a: np.ndarray, a: np.ndarray, word_b: np.ndarray, b: np.ndarray, lcp: np.ndarray, most: int) -> np.ndarray:
    """Common prefix lengths, at most `most`, of places a and b that agree in lcp bytes already."""
    lcp = np.minimum(lcp, most)
    live = np.flatnonzero(lcp < most)
    while len(live):
        x, y = a[live] + lcp[live], b[live] + lcp[live]
        inside = (x < len(word_a)) & (y < len(word_b))
        live, x, y = live[inside], x[inside], y[inside]
        diff = word_a[x] ^ word_b[y]
        equal = diff == 0
        # Whole bytes before the highest differing one.
        bits = np.frexp((diff >> np.uint64(11)).astype(np.float64))[1] + 11
        bits = np.where(diff >> np.uint64(11), bits, np.frexp(diff.astype(np.float64))[1])
        lcp[live] += np.where(equal, 8, (64 - bits) // 8)
        live = live[equal & (lcp[live] < most)]
    room = np.minimum(len(word_a) - a, len(word_b) - b)
    return np.minimum(np.minimum(lcp, most), room)


def kasai(buf: np.ndarray, sa: np.ndarray, most: int, lane: int = 64) -> np.ndarray:
    """lcp[k]: common prefix of sa[k-1] and sa[k], at most `most`; lcp[0] is 0.

    In text order a prefix is at most one byte shorter than the one before; every lane-th place starts anew.
    """
    n = len(buf)
    word = words8(buf)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    plcp = np.zeros(n, np.int64)
    for r in range(lane):
        i = np.arange(r, n, lane)
        i = i[before[i] >= 0]
        if len(i):
            start = np.maximum(plcp[i - 1] - 1, 0) if r else np.zeros(len(i), np.int64)
            plcp[i] = _extend(word, i, word, before[i], start, most)
    return plcp[sa]


def repeats(contexts: list[bytes], counts: np.ndarray, length: int) -> list[np.ndarray]:
    """Of each context, which of its starts begin a string that begins elsewhere among them too."""
    lens = np.array([len(c) for c in contexts])
    buf = np.frombuffer(b"".join(contexts), np.uint8)
    at = np.concatenate(([0], np.cumsum(lens)))
    sa = suffix_array(buf)
    group = np.cumsum(kasai(buf, sa, length) < length)
    is_start = np.zeros(len(buf), np.int64)
    for a, n in zip(at, lens):  # noqa: B905
        is_start[a : a + n - length + 1] = 1
    many = np.bincount(group, is_start[sa]) > 1
    out = np.zeros(len(buf), bool)
    out[sa] = many[group]
    return [out[a : a + n - length + 1] | (c > 1) for a, n, c in zip(at, lens, counts)]  # noqa: B905


def _order(word_a: np.ndarray, a: np.ndarray, word_b: np.ndarray, b: np.ndarray, byte_a: np.ndarray, byte_b: np.ndarray, length: int) -> np.ndarray:
    """-1, 0 or 1: how the strings at a compare with those at b."""
    l = _extend(word_a, a, word_b, b, np.zeros(len(a), np.int64), length)
    end = l >= length
    x, y = byte_a[np.minimum(a + l, len(byte_a) - 1)].astype(np.int64), byte_b[np.minimum(b + l, len(byte_b) - 1)].astype(np.int64)
    return np.where(end, 0, np.sign(x - y))


def merge(left: list[bytes], right: list[bytes], length: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Which starts of each side's contexts begin a string that the other side has: binary search both ways."""
    sides = []
    for contexts in (left, right):
        lens = np.array([len(c) for c in contexts])
        buf = np.frombuffer(b"".join(contexts), np.uint8)
        at = np.concatenate(([0], np.cumsum(lens)))
        is_start = np.zeros(len(buf), bool)
        for a, n in zip(at, lens):  # noqa: B905
            is_start[a : a + n - length + 1] = True
        sa = suffix_array(buf)
        sides.append((buf, words8(buf), sa[is_start[sa]], at, lens))
    out = []
    for (buf, word, starts, at, lens), (other, oword, osa, *_) in (sides, sides[::-1]):
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(osa))
        while (open_ := low < high).any():
            k = np.flatnonzero(open_)
            mid = (low[k] + high[k]) // 2
            less = _order(oword, osa[mid], word, starts[k], other, buf, length) < 0
            low[k] = np.where(less, mid + 1, low[k])
            high[k] = np.where(less, high[k], mid)
        hit = np.zeros(len(starts), bool)
        k = np.flatnonzero(low < len(osa))
        hit[k] = _order(oword, osa[low[k]], word, starts[k], other, buf, length) == 0
        flags = np.zeros(len(buf), bool)
        flags[starts] = hit
        out.append([flags[a : a + n - length + 1] for a, n in zip(at, lens)])  # noqa: B905
    return out[0], out[1]


def _intervals(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _repeated(twice: DataFrame) -> Broadcast:
    """A bitmap of the hashes h, broadcast; a false bit costs work only."""
    place = F.col("h").bitwiseAND(BITS - 1)
    got = twice.groupBy(F.shiftright(place, 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("bits")).toArrow()
    bitmap = np.zeros(BITS // 64, np.int64)  # at most BITS / 64 rows reach the driver, whatever the corpus
    bitmap[got["w"].to_numpy()] = got["bits"].to_numpy()
    return twice.sparkSession.sparkContext.broadcast(bitmap.view(np.uint64))


def _small(batches: Iterator[pa.RecordBatch], most: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few contexts, as each becomes many rows."""
    for batch in batches:
        for i in range(0, batch.num_rows, most):
            yield batch.slice(i, most)


def _parts(many: DataFrame, length: int) -> DataFrame:
    """(id, shift, anchor, context, n): parts of contexts whose core comes twice; anchor is the core's hash."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            out = [(h, n) for c, at, n in zip(*(batch[k].to_pylist() for k in ("context", "at", "n")), strict=True) for h, *_ in cores(c, at, length)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)], ["h", "n"])

    held = _repeated(many.select("context", "at", "n").mapInArrow(hashes, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            out = []
            for i, c, at, n in zip(*(batch[k].to_pylist() for k in ("id", "context", "at", "n")), strict=True):
                for h, a, b in cores(c, at, length):
                    if int(held.value[(h & BITS - 1) >> 6]) >> (h & 63) & 1:
                        out.append((i, a, h, c[a:b], n))
            types = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["id", "shift", "anchor", "context", "n"])

    return many.select(F.md5("context").alias("id"), "context", "at", "n").mapInArrow(part, "id string, shift long, anchor long, context binary, n long")


def _counted(contexts: DataFrame, length: int) -> DataFrame:
    """(id, low, high): of contexts (context, n), the strings that come twice among them, by md5."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            out = []
            for i, c, n in zip(*(batch[k].to_pylist() for k in ("id", "context", "n")), strict=True):
                out += [(i, k, hashlib.md5(c[k : k + length], usedforsecurity=False).digest(), n) for k in range(len(c) - length + 1)]
            types = (pa.string(), pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["id", "low", "string", "n"])

    rows = contexts.select(F.md5("context").alias("id"), "context", "n").mapInArrow(strings, "id string, low long, string binary, n long")
    twice = rows.groupBy("string").agg(F.sum("n").alias("n")).where("n > 1").select("string")
    return rows.join(twice, "string", "left_semi").select("id", "low", (F.col("low") + 1).alias("high"))


def repeated_spans(docs: DataFrame, text_col: str = "text", length: int = 400) -> DataFrame:
    """(key, spans): by md5 of the text, sorted [begin, end) of the strings that also start elsewhere."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(text_col).alias("text")).where(F.octet_length("text") >= length)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for buf, offs, *_ in _pieces(batch["text"], length):
                h = runs(buf, offs, length)[3]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    held = _repeated(texts.mapInArrow(anchors, "h long").groupBy("h").count().where("count > 1"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for buf, offs, number, place in _pieces(batch["text"], length):
                first, last, at, h = runs(buf, offs, length)
                bit = (h & np.uint64(BITS - 1)).astype(np.int64)
                some = held.value[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1) > 0
                first, last, at, h = first[some], last[some], at[some], h[some]
                if not len(first):
                    continue
                of = np.searchsorted(offs, first, "right") - 1
                raw = buf.tobytes()
                context = [raw[a : b + length] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch["key"].take(pa.array(number[of])), pa.array(first - offs[of] + place[of]), pa.array(h.view(np.int64)), pa.array(at), pa.array(context, pa.binary())], ["key", "begin", "anchor", "at", "context"])

    found = keep(texts.withColumn("key", F.md5("text")).mapInArrow(cut, "key string, begin long, anchor long, at long, context binary").withColumn("id", F.md5("context")))
    # Equal contexts have their anchor at the same place.
    distinct = keep(found.groupBy("anchor", "context").agg(F.min("at").alias("at"), F.count("*").alias("n")))
    hot = keep(distinct.groupBy("anchor").count().where(F.col("count") > HOT).select("anchor"))
    parted = None
    if hot.isEmpty():
        groups = distinct.select("anchor", "context", "n")
    else:
        parted = _parts(distinct.join(hot, "anchor", "left_semi"), length)
        once = keep(parted.groupBy("anchor", "context").agg(F.sum("n").alias("n")))
        groups = distinct.join(hot, "anchor", "left_anti").select("anchor", "context", "n").unionByName(once)
    sizes = groups.groupBy("anchor").agg(F.count("*").alias("m"), F.max("n").alias("most")).where("m > 1 or most > 1")
    sizes = sizes.select("anchor", F.ceil(F.col("m") / CHUNK).cast("int").alias("chunks"), "m")
    if parted is None:
        open_ = groups.join(sizes.drop("m"), "anchor")
    else:  # large groups are few, and are found without a shuffle that brings each to one task
        large = keep(sizes.where(F.col("m") > HOT).drop("m"))
        rest = groups.join(large, "anchor", "left_anti").join(sizes.where(F.col("m") <= HOT).drop("m"), "anchor")
        open_ = groups.join(large.where(F.col("chunks") <= PAIRED), "anchor").unionByName(rest)
    mine = F.pmod(F.xxhash64("context"), F.col("chunks")).cast("int")
    j = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    dealt = open_.withColumn("mine", mine).select("*", j.alias("other"))
    dealt = dealt.select(
        F.xxhash64("anchor", F.least("mine", "other"), F.greatest("mine", "other")).alias("task"),
        F.when(F.col("mine") == F.col("other"), 0).otherwise(F.when(F.col("mine") < F.col("other"), 1).otherwise(2)).alias("side"),
        "context",
        "n",
    )

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(contexts: list[bytes], flags: list[np.ndarray]) -> pa.RecordBatch:
            ids, low, high = [], [], []
            for c, f in zip(contexts, flags, strict=True):
                if f.any():
                    a, b = _intervals(f)
                    ids += [hashlib.md5(c, usedforsecurity=False).hexdigest()] * len(a)
                    low.append(a)
                    high.append(b)
            none = [np.zeros(0, np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(np.concatenate(low or none)), pa.array(np.concatenate(high or none))], ["id", "low", "high"])

        contexts, counts, size = [], [], 0
        for table in whole_groups(batches, "task"):
            task, side = table["task"].to_numpy(), table["side"].to_numpy()
            n = table["n"].to_numpy()
            bodies = table["context"].to_pylist()
            cuts = np.flatnonzero(np.concatenate(([True], task[1:] != task[:-1], [True]))).tolist()
            for a, b in zip(cuts, cuts[1:]):  # noqa: B905
                if side[a]:
                    sides = [[bodies[k] for k in range(a, b) if side[k] == s] for s in (1, 2)]
                    if all(sides):
                        for c, f in zip(sides, merge(*sides, length), strict=True):
                            yield told(c, f)
                    continue
                if b - a == 1:
                    yield told(bodies[a:b], [np.full(len(bodies[a]) - length + 1, n[a] > 1)])
                    continue
                contexts += bodies[a:b]
                counts += n[a:b].tolist()
                size += sum(map(len, bodies[a:b]))
                if size > SHARD:
                    yield told(contexts, repeats(contexts, np.array(counts), length))
                    contexts, counts, size = [], [], 0
        if contexts:
            yield told(contexts, repeats(contexts, np.array(counts), length))

    hits = dealt.repartition(parts, "task").sortWithinPartitions("task").mapInArrow(shards, "id string, low long, high long")
    if parted is not None:
        vast = large.where(F.col("chunks") > PAIRED).select("anchor")
        hits = hits if vast.isEmpty() else hits.unionByName(_counted(groups.join(vast, "anchor", "left_semi"), length))
        hits = keep(hits)
        of = parted.select("id", "shift", F.md5("context").alias("part"))
        moved = of.join(hits.withColumnRenamed("id", "part"), "part")
        hits = hits.unionByName(moved.select("id", (F.col("low") + F.col("shift")).alias("low"), (F.col("high") + F.col("shift")).alias("high")))
    owned = found.select("id", "key", "begin").distinct().join(hits, "id")
    spans = owned.select("key", (F.col("begin") + F.col("low")).alias("begin"), (F.col("begin") + F.col("high") - 1 + length).alias("end"))
    return spans.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row; kept: the remaining bytes."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.md5("text"))
    spans = keep(repeated_spans(docs, text_col, length))
    joined = rows.join(spans, "key", "left").select("id", "text", "spans")
    id_type = joined.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch["text"].cast(pa.large_binary()), batch["spans"], strict=True):
                text, merged = text.as_py(), []
                for s in spans.as_py() or ():
                    if merged and s["begin"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["end"])
                    else:
                        merged.append([s["begin"], s["end"]])
                at, parts = 0, []
                for a, b in merged:
                    parts.append(text[at:a])
                    at = b
                kept = b"".join([*parts, text[at:]])
                out.append((len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept))
            cols = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch["id"], *cols], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(run, f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op6(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
