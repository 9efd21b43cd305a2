"""Embedding near-duplicates by a subspace pigeonhole join.

Cosine >= c means squared distance <= 2 - 2c between unit vectors. A rotation spreads them over blocks of
dimensions; if the whole distance is within its budget, the distance in some block is within that
block's share of it. Each block is a range join over one rotated coordinate, whose partners differ by at most
the block's radius. Vectors are stored once, in chunks sorted by strips of these coordinates; chunks whose ranges
are near in some block are read in pairs, and within a pair strips meet, in which numpy filters by block
distance. Only what passes is verified, on the unrotated vectors in double precision. A pair counts in the first block whose budget it keeps, so no pair
is emitted, shuffled or counted twice: tasks return link counts and a spanning forest of their links.

The rotation and the strips' axes come from the covariance of a bounded sample; they steer speed, and the
result doesn't depend on them.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing,
not even with copies, and are their own component; vectors of another length than their partner never link;
equal vectors are one node with a weight, and link with each other; rows that share an id are one node of a
component and each other's links if their vectors link; a null id has component null while no other id is
reachable. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrigraph.llm._graph import components, forest
from metrigraph.llm.simhash import NO_ID
from metrigraph.storage import keep

#: Rows of a chunk; blocks of dimensions; rows of the sample for the rotation.
CHUNK, BLOCKS, SAMPLE = 4096, 4, 2000
_SLACK = 1e-6


def rotation(sample: np.ndarray, blocks: int) -> tuple[np.ndarray, list[slice], np.ndarray]:
    """An orthogonal matrix whose blocks have near equal variance, their slices and shares of the budget."""
    d = sample.shape[1]
    blocks = max(1, min(blocks, d))
    values, axes = np.linalg.eigh(np.cov(sample, rowvar=False).reshape(d, d)) if len(sample) > 1 else (np.ones(d), np.eye(d))
    order = np.argsort(values)[::-1]
    dealt = [order[i::blocks] for i in range(blocks)]  # each block leads with one of the widest axes
    cuts = np.concatenate(([0], np.cumsum([len(x) for x in dealt])))
    spread = np.array([max(values[x].sum(), 1e-12) for x in dealt])
    return axes[:, np.concatenate(dealt)], [slice(a, b) for a, b in zip(cuts, cuts[1:])], spread / spread.sum()  # noqa: B905


def _stack(column: pa.Array, d: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(-1, d) if isinstance(column, pa.ChunkedArray) else column.flatten().to_numpy().reshape(-1, d)


def links(nodes: DataFrame, d: int, least: float, turn: np.ndarray, parts: list[slice], shares: np.ndarray) -> DataFrame:
    """(node, key, peer, n): link counts by key (peer null) and links between nodes that span all links (n 0).

    nodes: node long, key, weight long, v array<double> of length d, unit length not needed.
    """
    budget = (2 - 2 * least) * shares
    width = np.sqrt(budget) + 1e-9
    held = nodes.sparkSession.sparkContext.broadcast((turn, parts, budget, width))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, parts, _, width = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _stack(batch["v"], d)
            u = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ turn[:, [s.start for s in parts]]
            order = np.lexsort(np.floor(u / width).T[::-1])
            for at in range(0, len(order), CHUNK):
                mine = order[at : at + CHUNK]
                some = lambda c: [batch[c].take(pa.array(mine))]  # noqa: B023, E731
                keys = some("key")[0].to_pylist()
                low, high = u[mine].min(axis=0), u[mine].max(axis=0)
                yield pa.RecordBatch.from_pylist([{"chunk": min(keys), "node": some("node")[0].to_pylist(), "key": keys, "weight": some("weight")[0].to_pylist(), "v": np.ascontiguousarray(v[mine]).tobytes(), "low": low.tolist(), "high": high.tolist()}], schema)

    schema = pa.schema([("chunk", pa.string()), ("node", pa.list_(pa.int64())), ("key", pa.list_(pa.string())), ("weight", pa.list_(pa.int64())), ("v", pa.binary()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])
    chunks = keep(nodes.mapInArrow(pack, "chunk string, node array<bigint>, key array<string>, weight array<bigint>, v binary, low array<double>, high array<double>"))
    # Chunks meet by reading them again: no vector is dealt out, so disk grows with the vectors and not with their square.
    near = functools.reduce(lambda p, q: p | q, [(F.col("x.low")[i] - F.col("y.high")[i] <= float(w)) & (F.col("y.low")[i] - F.col("x.high")[i] <= float(w)) for i, w in enumerate(width)])
    met = chunks.alias("x").hint("shuffle_replicate_nl").join(chunks.alias("y"), (F.col("x.chunk") <= F.col("y.chunk")) & near)
    met = met.select(*[F.col(f"x.{c}").alias(f"{c}_x") for c in ("chunk", "node", "key", "weight", "v")], *[F.col(f"y.{c}").alias(f"{c}_y") for c in ("chunk", "node", "key", "weight", "v")])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, parts, budget, width = held.value
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c: batch[c][r]  # noqa: B023, E731
                own = get("chunk_x").as_py() == get("chunk_y").as_py()
                sides = "x" if own else "xy"
                node, weight = (np.concatenate([get(f"{c}_{s}").values.to_numpy() for s in sides]) for c in ("node", "weight"))
                key = pa.concat_arrays([get(f"key_{s}").values for s in sides])
                v = np.concatenate([np.frombuffer(get(f"v_{s}").as_py()).reshape(-1, d) for s in sides])
                v = v / np.linalg.norm(v, axis=1, keepdims=True)
                n = len(get("node_x").values)
                left, right = np.arange(n), np.arange(n) if own else np.arange(n, len(v))
                count, fa, fb = np.zeros(len(v), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for block in range(len(parts)):
                    for a, b in _strips(v @ turn[:, parts[block].start], left, right, width[block]):
                        for x, y in _close(v, a, b, own, block, turn, parts, budget, least):
                            np.add.at(count, x, weight[y])
                            np.add.at(count, y, weight[x])
                            p, q = forest(node[x], node[y])
                            fa.append(p)
                            fb.append(q)
                some = np.flatnonzero(count)
                fa, fb = forest(np.concatenate(fa), np.concatenate(fb))
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), key.take(pa.array(some)), pa.nulls(len(some), pa.int64()), pa.array(count[some])], ["node", "key", "peer", "n"])
                yield pa.RecordBatch.from_arrays([pa.array(fa), pa.nulls(len(fa), pa.string()), pa.array(fb), pa.array(np.zeros(len(fa), np.int64))], ["node", "key", "peer", "n"])

    found = met.mapInArrow(meet, "node long, key string, peer long, n long")
    # A key's counts and its links are summed where they arise, before anything is written.
    return found.groupBy("node", "key", "peer").agg(F.sum("n").alias("n"))


def _strips(u: np.ndarray, left: np.ndarray, right: np.ndarray, width: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of left in order of one coordinate, some at a time, with the rows of right that lie within the width of any of them."""
    left, right = left[np.argsort(u[left], kind="stable")], right[np.argsort(u[right], kind="stable")]
    at = u[right]
    for k in range(0, len(left), 512):
        some = left[k : k + 512]
        yield some, right[np.searchsorted(at, u[some[0]] - width, "left") : np.searchsorted(at, u[some[-1]] + width, "right")]


def _close(v: np.ndarray, left: np.ndarray, right: np.ndarray, own: bool, block: int, turn: np.ndarray, parts: list[slice], budget: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (each once) of cosine >= least whose first block within its budget is this one."""
    if not len(left) or not len(right):
        return
    part = turn[:, parts[block]]
    b = (v[right] @ part).astype(np.float32)
    bb = (b * b).sum(axis=1) - np.float32(budget[block] + _SLACK)
    for at in range(0, len(left), 512):
        rows = left[at : at + 512]
        a = (v[rows] @ part).astype(np.float32)
        near = a @ b.T
        near *= -2
        near += bb
        i, j = np.nonzero(near <= -(a * a).sum(axis=1)[:, None])
        if own:
            i, j = i[(up := rows[i] < right[j])], j[up]
        for k in range(0, len(i), 1 << 15):
            x, y = rows[i[k : k + (1 << 15)]], right[j[k : k + (1 << 15)]]
            ok = (v[x] * v[y]).sum(axis=1) >= least
            x, y = x[ok], y[ok]
            gap = (v[x] - v[y]) @ turn
            gap *= gap
            share = np.stack([gap[:, s].sum(axis=1) for s in parts], axis=1)
            # All blocks over by rounding alone: the one nearest to its budget.
            within = share <= budget + 1e-12
            mine = np.where(within.any(axis=1), within.argmax(axis=1), (share / budget).argmin(axis=1)) == block
            if mine.any():
                yield x[mine], y[mine]


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.9, blocks: int = BLOCKS) -> DataFrame:
    """(id, n_links, component) of every row of df."""
    v = F.col("v")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: x.cast("double")).alias("v"))
    sound = F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("key", F.when(sound, F.sha2(F.concat_ws(",", F.transform(v, lambda x: (x + 0.0).cast("string"))), 256)))
    good = rows.where("key is not null")
    # Distance products of huge or tiny components stay finite: scale by the largest first.
    scaled = F.transform(v, lambda x: x / F.array_max(F.transform(v, F.abs)))
    nodes = keep(good.groupBy("key").agg(F.min("id").alias("low"), F.count("*").alias("weight"), F.first(scaled).alias("v")).withColumn("node", F.coalesce("low", F.lit(NO_ID) + F.pmod(F.xxhash64("key"), F.lit(1 << 61)))))
    lengths = [r[0] for r in nodes.select(F.size("v")).distinct().collect()]  # a handful: the models' dimensions
    found = None
    for d in sorted(lengths):
        of = nodes.where(F.size("v") == d)
        sample = _stack(of.orderBy("key").limit(SAMPLE).select("v").toArrow()["v"], d)
        turn, parts, shares = rotation(sample / np.linalg.norm(sample, axis=1, keepdims=True), blocks)
        part = links(of.select("node", "key", "weight", "v"), d, least, turn, parts, shares)
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    found = keep(found)
    counts = found.where("peer is null").groupBy("key").agg(F.sum("n").alias("n"))
    reach = components(found.where("peer is not null").select("node", "peer"), "node", "peer").withColumnRenamed("node", "of")
    label = nodes.join(counts, "key", "left").join(reach, F.col("node") == F.col("of"), "left")
    label = label.select("key", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("c"))
    out = rows.select("id", "key").join(label, "key", "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("key").isNull(), F.col("id")).otherwise(F.when(F.col("c") < NO_ID, F.col("c"))).alias("component"))


def op5(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))
