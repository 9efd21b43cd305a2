"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrigraph.llm._text import release
from metrigraph.storage import drop, keep

#: Links that one task joins at once (16 bytes each): that many or fewer need no rounds.
AT_ONCE = 1 << 19


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links a-b: each node but the smallest of its component, with that smallest one."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        label = new[label]
        open_ = label[x] != label[y]
        x, y = x[open_], y[open_]
    out = label != np.arange(len(nodes))
    return nodes[out], nodes[label[out]]


def _forests(edges: DataFrame, most: int, own: bool = False) -> DataFrame:
    """Links (u, v) that join the same nodes: of each `most` links of a task, each node with the smallest that they reach.

    own: the smallest nodes too, each with itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, held = [], [], 0

        def joined() -> pa.RecordBatch:
            u, v = forest(np.concatenate(us), np.concatenate(vs))
            low = np.unique(v) if own else v[:0]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate((u, low))), pa.array(np.concatenate((v, low)))], ["u", "v"])

        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                if held and held + part.num_rows > most:
                    yield joined()
                    us, vs, held = [], [], 0
                us.append(part["u"].to_numpy())
                vs.append(part["v"].to_numpy())
                held += part.num_rows
        if held:
            yield joined()
        us = vs = None
        release()

    return edges.mapInArrow(run, "u long, v long")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest long id reachable from each node that has an edge to another.

    Up to AT_ONCE links are joined in one task. Of more, each task first joins its own, and if still more are left,
    alternating large-star and small-star steps follow, with the edge list cut to the shared folder after each
    round; only two sums come to the driver. Minima are aggregated map-side, and the joins are plain
    equi-joins that AQE can split, so a node with very many edges burdens no single task. A round is some six
    exchanges, whose tasks and their metrics the driver keeps track of, whatever the number of links.
    """
    e = keep(edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v"))
    n = e.count()
    if n > AT_ONCE:
        e, old = keep(_forests(e, AT_ONCE).distinct()), e
        drop(old)
        n = e.count()
    if n <= AT_ONCE:
        out = keep(_forests(e.coalesce(1), AT_ONCE, own=True).toDF("node", "component"))
        drop(e)
        return out
    e = _rounds(e)
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(e.select("v", F.col("v").alias("component")).distinct())


def _rounds(e: DataFrame) -> DataFrame:
    """Links (u, v) of each node but the smallest of its component with that smallest one; e: (u, v) from keep(), u > v."""
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        e, old = keep(small), e
        drop(old)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            return e
        before = tuple(now)
