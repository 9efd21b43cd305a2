"""Language-model scoring with a log-frequency Bloom filter.

Counts of words and word pairs of the training texts are quantised on a logarithmic scale; an n-gram of
level q is entered in the filter once for each level 1..q. A count is read back by probing level after
level until one is missing, so errors only raise a count, rarely and by little. A codebook turns a level
into the mean count of its n-grams. Probabilities interpolate pair and word estimates (Jelinek-Mercer):
p(w|h) = l * c(h,w) / c(h) + (1 - l) * (c(w) + 1) / (N + V + 1), where l depends on the level of h and
is fitted by leave-one-out expectation maximisation on all tokens of the training texts. As estimates depend on
levels only, workers count tokens by the levels of history, pair and word, and the fit runs over these counts.

Counting: workers hash n-grams (64 bits) and send, per bucket of hashes, packed arrays of distinct hashes
and counts; buckets grow in number with the text, so each stays small. Each bucket merges its arrays and
builds its own block of the filter. The blocks are broadcast in shards of at most `shard_bytes`. Texts pass
once: a worker holds the tokens of a few megabytes of text and one shard at a time, and probes shard after shard.

Exact counts for the base score never go through the filter nor through an unbounded broadcast: words that
make up at least 1 in `heavy` of all tokens (at most `heavy` of them) are looked up where the text is,
all others are sent, packed by bucket, to the bucket's counts, and sums per text come back.

Defined results: null text is empty, whose one token is the end; without training texts N and V are 0;
repeated rows count each time; null ids belong to no held-out fold's remainder and train; extra columns are
ignored. A text is scored whole whatever its length; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrigraph.llm._text import BYTE_HASH_LOWER, SLICE_BYTES, mix, prefix_hash, slices, span_hash, utf8, whole_groups, words
from metrigraph.storage import keep

END, START = np.uint64(0x1D8AF066A3B1C5E7), np.uint64(0x7C3B5A9E12D4F681)
#: Least count of each level: powers of two and the halves between them.
LEVELS = np.unique([1, *[x for k in range(1, 62) for x in (1 << k, 3 << k - 1)]])


@dataclass(frozen=True)
class Params:
    bucket_bytes: int = 8 << 20
    hashes: int = 5
    bits: float = 7.3
    heavy: int = 100_000
    shard_bytes: int = 64 << 20


#: Tokens that a worker counts at once; bytes of text that meet the shards of the filter together.
COUNTED, TOGETHER = 3_000_000, 8 << 20


def level(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEVELS, counts, "right")


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and ends, and the number of tokens of each text."""
    buf, offs = utf8(column)
    out, ns = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j in slices(offs):
        part = buf[offs[i] : offs[j]]
        s, e, n = words(part, offs[i : j + 1] - offs[i])
        h = span_hash(prefix_hash(part, BYTE_HASH_LOWER), s, e)
        full = np.full(len(h) + len(n), END)
        full[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h
        out.append(full)
        ns.append(n + 1)
    return np.concatenate(out), np.concatenate(ns)


def history(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The token before each token; START before the first."""
    out = np.empty_like(h)
    out[1:] = h[:-1]
    out[np.cumsum(n) - n] = START
    return out


def pair(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + h)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def _count(h: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each comes (n: how often each entry counts)."""
    if n is None:
        h = np.sort(h)
    else:
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))[: len(h)])
    counts = np.diff(np.concatenate((first, [len(h)]))) if n is None else (np.add.reduceat(n, first) if len(h) else np.zeros(0, np.int64))
    return h[first], counts.astype(np.int64)


def _pack(h: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes]:
    """Hashes that count once last; counts of the others only."""
    many = n > 1
    return np.concatenate((h[many], h[~many])).tobytes(), n[many].astype(np.uint32).tobytes()


def _unpack(h: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    h, many = np.frombuffer(h, np.uint64), np.frombuffer(n, np.uint32)
    counts = np.ones(len(h), np.int64)
    counts[: len(many)] = many
    return h, counts


def _split(h: np.ndarray, n: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    b = bucket_of(h, buckets)
    order = np.argsort(b.astype(np.uint16) if buckets <= 1 << 16 else b, kind="stable")
    cut = np.searchsorted(b[order], np.arange(buckets + 1))
    for k in range(buckets):
        if cut[k] < cut[k + 1]:
            at = order[cut[k] : cut[k + 1]]
            yield k, h[at], n[at]


def _slots(key: np.ndarray, lev: int | np.ndarray, k: int, m: np.ndarray | int) -> np.ndarray:
    """The k-th bit of each key at a level, in a block of m bits."""
    g = mix(key + np.asarray(lev).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return (g + np.uint64(k) * (mix(g) | np.uint64(1))) % np.asarray(m).astype(np.uint64)


def block(keys: np.ndarray, levels: np.ndarray, p: Params) -> np.ndarray:
    """A bucket's bits as bytes."""
    m = max(64, int(p.bits * levels.sum()) // 8 * 8 + 8)
    bits = np.zeros(m, bool)
    for lev in range(1, int(levels.max(initial=0)) + 1):
        at = keys[levels >= lev]
        for k in range(p.hashes):
            bits[_slots(at, lev, k, m).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


@dataclass
class Filter:
    """Blocks of buckets [low, high), one after another."""

    low: int
    high: int
    buckets: int
    data: np.ndarray
    start: np.ndarray
    hashes: int

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key; 0 where the key's bucket isn't here."""
        out = np.zeros(len(keys), np.uint8)
        b = bucket_of(keys, self.buckets) - self.low
        live = np.flatnonzero((b >= 0) & (b < self.high - self.low))
        base, m = self.start[b[live]], (self.start[b[live] + 1] - self.start[b[live]]) * 8
        lev = 0
        while True:
            some = m > 0
            live, base, m = live[some], base[some], m[some]
            if not len(live):
                return out
            lev += 1
            for k in range(self.hashes):
                slot = _slots(keys[live], lev, k, m).astype(np.int64)
                hit = self.data[base + (slot >> 3)] >> (slot & 7).astype(np.uint8) & 1 > 0
                live, base, m = live[hit], base[hit], m[hit]
            out[live] = lev


def opened(shards: list) -> Iterator[Filter]:
    """The broadcast shards of a filter, of which no more than one is in a worker's memory."""
    if len(shards) == 1:
        yield shards[0].value
    else:
        for s in shards:
            yield s.load_from_path(s._path)  # `value` would stay in memory


def levels(filters: Iterator[Filter], h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Levels of every token and of every pair of it with its history; distinct ones are probed once."""
    keys, at = [], []
    for k in (h, pair(history(h, n), h)):
        u, inverse = np.unique(k, return_inverse=True)
        keys.append(u)
        at.append(inverse.astype(np.int32))
        del inverse
    cut = len(keys[0])
    both = np.concatenate(keys)
    lev = np.zeros(len(both), np.uint8)
    for f in filters:  # a key is in one shard only
        for a in range(0, len(both), 1 << 17):
            part = lev[a : a + (1 << 17)]
            np.maximum(part, f.levels(both[a : a + (1 << 17)]), out=part)
    return lev[:cut][at[0]], lev[cut:][at[1]]


@dataclass
class Model:
    tokens: int
    types: int
    texts: int
    words: np.ndarray  # mean count of each level
    pairs: np.ndarray
    weights: np.ndarray  # interpolation weight by the history's level

    def histories(self, lw: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The level of each token's history; that of the number of texts for the first."""
        lh = np.empty_like(lw)
        lh[1:] = lw[:-1]
        lh[np.cumsum(n) - n] = int(level(np.array([self.texts]))[0])
        return lh

    def parts(self, lh: np.ndarray, lp: np.ndarray, lw: np.ndarray, less: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Pair estimate and word estimate of each token; less: own occurrences to leave out."""
        c = np.maximum(self.words[lh] - less, 0)
        bi = np.where(c > 0, np.minimum(np.maximum(self.pairs[lp] - less, 0) / np.maximum(c, 1e-9), 1.0), 0.0)
        uni = (np.maximum(self.words[lw] - less, 0) + 1) / (self.tokens + self.types + 1)
        return bi, uni

    def score(self, lw: np.ndarray, lp: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log10 probability of every text."""
        lh = self.histories(lw, n)
        bi, uni = self.parts(lh, lp, lw)
        w = self.weights[lh]
        return np.bincount(np.repeat(np.arange(len(n)), n), np.log10(w * bi + (1 - w) * uni), len(n)) if len(n) else np.zeros(0)


def _counts(train: DataFrame, buckets: int, p: Params) -> DataFrame:
    """Per bucket: word hashes and counts, filter block, sums for the codebook."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            h = np.concatenate([x for x, _ in held])
            n = np.concatenate([x for _, x in held])
            held.clear()
            rows = []
            for kind, keys in ((1, h), (2, pair(history(h, n), h))):
                for b, u, c in _split(*_count(keys), buckets):
                    rows.append((b, kind, *_pack(u, c)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["bucket", "kind", "h", "n"])

        for batch in batches:
            offs = utf8(batch["text"])[1]
            for i, j in slices(offs):
                held.append(tokens(batch["text"].slice(i, j - i)))
                size += len(held[-1][0])
                if size > COUNTED:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    names = ["bucket", "h", "n", "tokens", "types", "bits", "types_at", "counts_at", "pair_types_at", "pair_counts_at"]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), *[pa.list_(pa.int64())] * 4]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "bucket"):
            of = table["bucket"].to_numpy()
            for b in np.unique(of):
                part = table.filter(pa.array(of == b))
                kind = part["kind"].to_numpy()
                got = [[_unpack(x.as_py(), y.as_py()) for x, y, k in zip(part["h"], part["n"], kind, strict=True) if k == want] for want in (1, 2)]
                sums = [_count(np.concatenate([x for x, _ in g] or [np.zeros(0, np.uint64)]), np.concatenate([y for _, y in g] or [np.zeros(0, np.int64)])) for g in got]
                lev = [level(c) for _, c in sums]
                at = [np.bincount(v, w, len(LEVELS) + 1).astype(np.int64).tolist() for v, (_, c) in zip(lev, sums, strict=True) for w in (None, c)]
                (wh, wn), (ph, _) = sums
                row = (int(b), wh.tobytes(), wn.tobytes(), int(wn.sum()), len(wh), block(np.concatenate((wh, ph)), np.concatenate(lev), p).tobytes(), *at)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names)

    sent = train.select("text").mapInArrow(gather, "bucket long, kind int, h binary, n binary")
    parts = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keep(sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(merge, "bucket long, h binary, n binary, tokens long, types long, bits binary, types_at array<bigint>, counts_at array<bigint>, pair_types_at array<bigint>, pair_counts_at array<bigint>"))


def _fit_weights(model: Model, lh: np.ndarray, lp: np.ndarray, lw: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Interpolation weight of each history level: leave-one-out EM on all training tokens, counted by levels."""
    bi, uni = model.parts(lh, lp, lw, less=1)
    w = np.full(len(LEVELS) + 1, 0.3)
    seen = np.bincount(lh, times, len(w))
    for _ in range(30):
        mine = w[lh] * bi
        post = mine / (mine + (1 - w[lh]) * uni)
        # Two tokens of doubt per level keep weights off 0 and 1.
        w = (np.bincount(lh, post * times, len(w)) + 0.02) / (seen + 2)
    return w


def _level_counts(train: DataFrame, shards: list, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Levels of history, pair and word, and how many tokens of all training texts have them."""
    bare, most = replace(model, weights=np.zeros(0)), SLICE_BYTES if len(shards) == 1 else TOGETHER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            offs = utf8(batch["text"])[1]
            for i, j in slices(offs, most):
                h, n = tokens(batch["text"].slice(i, j - i))
                lw, lp = levels(opened(shards), h, n)
                u, c = np.unique((bare.histories(lw, n).astype(np.int64) << 16) | (lp.astype(np.int64) << 8) | lw, return_counts=True)
                # At most (levels + 1)**3 triples of levels, in practice a few thousand.
                codes, at = np.unique(np.concatenate((codes, u)), return_inverse=True)
                times = np.bincount(at, np.concatenate((times, c)), len(codes)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(times)], ["code", "times"])

    got = train.mapInArrow(run, "code long, times long").groupBy("code").agg(F.sum("times").alias("times")).toArrow()  # triples of levels
    code = got["code"].to_numpy()
    return code >> 16, code >> 8 & 255, code & 255, got["times"].to_numpy()


def score(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), p: Params = Params()) -> DataFrame:
    """(id, *carry, n_tokens, n_known, train_tokens, base_score, score) of every row of docs."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    train = train.select(F.col(text_col).alias("text"))
    size, texts = train.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    buckets = 16
    while buckets * p.bucket_bytes < size:
        buckets *= 2
    counts = _counts(train, buckets, p)
    head = counts.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    n_tokens, n_types = int(head[0]), int(head[1])

    sums = []
    for name in ("types_at", "counts_at", "pair_types_at", "pair_counts_at"):
        at = counts.select(F.posexplode(name)).groupBy("pos").agg(F.sum("col")).collect()  # one row a level
        x = np.zeros(len(LEVELS) + 1)
        x[[r[0] for r in at]] = [r[1] for r in at]
        sums.append(x)
    lowest = np.concatenate(([0], LEVELS)).astype(float)
    books = [np.where(t > 0, c / np.maximum(t, 1), lowest) for t, c in (sums[:2], sums[2:])]
    model = Model(n_tokens, n_types, texts, *books, np.zeros(len(LEVELS) + 1))

    # Words of at least 1 in `heavy` tokens: no more than `heavy` of them, wherever they hash to.
    least = max(1, -(-n_tokens // p.heavy))
    heavy_h, heavy_n = _heavy(counts, least)

    # Filter shards of bounded size, by running sums of the blocks' sizes.
    lengths = np.zeros(buckets, np.int64)
    for r in counts.select("bucket", F.octet_length("bits")).collect():
        lengths[r[0]] = r[1]
    cuts = [0]
    for b in range(1, buckets + 1):
        if b == buckets or lengths[cuts[-1] : b + 1].sum() > p.shard_bytes:
            cuts.append(b)
    shards = list(zip(cuts, cuts[1:]))  # noqa: B905

    def load(low: int, high: int) -> Filter:
        start = np.concatenate(([0], np.cumsum(lengths[low:high])))
        data = np.empty(int(start[-1]), np.uint8)
        for r in counts.where(F.col("bucket").between(low, high - 1)).select("bucket", "bits").toLocalIterator():
            data[start[r[0] - low] : start[r[0] - low + 1]] = np.frombuffer(r[1], np.uint8)
        return Filter(low, high, buckets, data, start, p.hashes)

    filters = []
    for low, high in shards:
        filters.append(sc.broadcast(load(low, high)))
    if texts:
        model.weights = _fit_weights(model, *_level_counts(train, filters, model))
    held = sc.broadcast((model, heavy_h, np.log10(heavy_n + 1.0)))

    rows = docs.select(F.col(id_col).alias("id"), *carry, F.col(text_col).alias("text"))
    named = [c for c in rows.columns if c != "text"]
    most = SLICE_BYTES if len(filters) == 1 else TOGETHER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, heavy_h, heavy_log = held.value
        per = np.log10(model.tokens + model.types + 1)
        task, number = TaskContext.get().partitionId(), 0
        for big in batches:
            whole = utf8(big["text"])[1]
            for low, high in slices(whole, TOGETHER):  # one set of packed arrays
                told, rest = [], []
                for i, j in slices(whole[low : high + 1] - whole[low], most):
                    h, n = tokens(big["text"].slice(low + i, j - i))
                    scores = model.score(*levels(opened(filters), h, n), n)
                    text = np.repeat(np.arange(len(n), dtype=np.int32), n)
                    at = np.minimum(np.searchsorted(heavy_h, h), max(0, len(heavy_h) - 1))
                    known = heavy_h[at] == h if len(heavy_h) else np.zeros(len(h), bool)
                    base = np.bincount(text[known], heavy_log[at[known]], len(n)) - n * per
                    told.append((n, np.bincount(text[known], minlength=len(n)), base, scores))
                    rest.append((h[~known], text[~known] + np.int32(i)))
                uid = task << 32 | number
                number += 1
                m = high - low
                n, n_known, base, scores = (np.concatenate(x) for x in zip(*told, strict=True))
                empty = [pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, uid)), pa.array(np.arange(m)), *[big[c].slice(low, m) for c in named], pa.array(n), pa.array(n_known), pa.array(base), pa.array(scores), *empty], names)
                h, text = (np.concatenate(x) for x in zip(*rest, strict=True))
                out = [(b, w.tobytes(), t.astype(np.uint32).tobytes()) for b, w, t in _split(h, text, buckets)]
                m = len(out)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, uid)), pa.nulls(m, pa.int64()), *[pa.nulls(m, big.schema.field(c).type) for c in named], pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64()), pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.binary())], names)

    names = ["uid", "at", *named, "n_tokens", "n_known", "base", "score", "bucket", "h", "t"]
    schema = "uid long, at long, " + "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields if f.name in named) + "n_tokens long, n_known long, base double, score double, bucket long, h binary, t binary"
    found = keep(rows.mapInArrow(run, schema))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "bucket"):
            keys, logs, of = None, None, None
            for r in range(table.num_rows):
                b, uid = table["bucket"][r].as_py(), table["uid"][r].as_py()
                h = np.frombuffer(table["h"][r].as_py(), np.uint64)
                if uid is None:
                    keys, logs, of = h, np.log10(np.frombuffer(table["t"][r].as_py(), np.int64) + 1.0), b
                    continue
                if of != b or not len(keys):
                    continue  # a bucket without training words: nothing is known
                i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                ok = keys[i] == h
                at, x = np.unique(np.frombuffer(table["t"][r].as_py(), np.uint32)[ok], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array([uid]), pa.array([at.astype(np.int64).tolist()]), pa.array([np.bincount(x, minlength=len(at)).tolist()], pa.list_(pa.int64())), pa.array([np.bincount(x, logs[i[ok]], len(at)).tolist()], pa.list_(pa.float64()))], ["uid", "at", "known", "base"])

    asked = found.where("h is not null").select("bucket", "uid", "h", "t").union(counts.select("bucket", F.lit(None).cast("long"), "h", "n"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    told = asked.repartition(parts, "bucket").sortWithinPartitions("bucket", F.col("uid").asc_nulls_first()).mapInArrow(look_up, "uid long, at array<bigint>, known array<bigint>, base array<double>")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "uid"):
            uid = np.repeat(table["uid"].to_numpy(), np.diff(table["at"].combine_chunks().offsets.to_numpy()))
            at, known, base = (table[c].combine_chunks().flatten().to_numpy() for c in ("at", "known", "base"))
            order = np.lexsort((at, uid))
            uid, at = uid[order], at[order]
            first = np.flatnonzero(np.concatenate(([True], (uid[1:] != uid[:-1]) | (at[1:] != at[:-1])))[: len(uid)])
            if len(first):
                yield pa.RecordBatch.from_arrays([pa.array(uid[first]), pa.array(at[first]), pa.array(np.add.reduceat(known[order], first)), pa.array(np.add.reduceat(base[order], first))], ["u", "a", "more_known", "more_base"])

    more = told.repartition(parts, "uid").sortWithinPartitions("uid").mapInArrow(add_up, "u long, a long, more_known long, more_base double")
    out = found.where("h is null").join(more, (F.col("uid") == F.col("u")) & (F.col("at") == F.col("a")), "left")
    return out.select(
        *named,
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        "score",
    )


def _heavy(counts: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, and counts of all words that come at least `least` times."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, n in zip(batch["h"], batch["n"], strict=True):
                keys, c = np.frombuffer(h.as_py(), np.uint64), np.frombuffer(n.as_py(), np.int64)
                big = c >= least
                yield pa.RecordBatch.from_arrays([pa.array([keys[big].tobytes()]), pa.array([c[big].tobytes()])], ["h", "n"])

    got = counts.select("h", "n").mapInArrow(pick, "h binary, n binary").toArrow()
    h = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(x.as_py(), np.uint64) for x in got["h"]]])
    n = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(x.as_py(), np.int64) for x in got["n"]]])
    order = np.argsort(h)
    return h[order], n[order]


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))
    docs = docs.select("doc_id", held_out.alias("held_out"), "text")
    out = score(docs, docs.where("not held_out"), carry=("held_out",))
    return out.withColumnRenamed("id", "doc_id")
