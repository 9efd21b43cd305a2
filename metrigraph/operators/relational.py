"""Votes, first-seen modes, argmax assignment, relational division, cumulative coverage, set stability."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def majority(df: DataFrame, keys: list[str], value: str, out: str = "winner") -> DataFrame:
    """(keys, out, votes): most votes, ties to the smaller value. Counts first, so rows of a key never meet."""
    votes = df.groupBy(*keys, value).agg(F.count("*").alias("votes"))
    best = votes.groupBy(*keys).agg(F.min(F.struct((-F.col("votes")).alias("n"), F.col(value).alias("v"))).alias("b"))
    return best.select(*keys, F.col("b.v").alias(out), (-F.col("b.n")).alias("votes"))


def modal_first_seen(df: DataFrame, keys: list[str], value: str, ordinal: str, out: str = "mode", count: str | None = None) -> DataFrame:
    """As majority, but ties fall to the value seen first. count: a column with the votes that a row stands for."""
    votes = df.groupBy(*keys, value).agg((F.sum(count) if count else F.count("*")).alias("n"), F.min(ordinal).alias("first"))
    best = votes.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), "first", F.col(value).alias("v"))).alias("b"))
    return best.select(*keys, F.col("b.v").alias(out), (-F.col("b.n")).alias("votes"))


def attribute_once(pairs: DataFrame, item: str, owner: str, score: str) -> DataFrame:
    """One owner per item: the highest score, ties to the smaller owner."""
    best = pairs.groupBy(item).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(owner).alias("o"))).alias("b"))
    return best.select(item, F.col("b.o").alias(owner))


def division(df: DataFrame, group: str, holds: Column) -> DataFrame:
    """Groups all of whose rows hold, with their size."""
    out = df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.coalesce(holds, F.lit(False))).alias("k"))
    return out.where("n = k").select(group, "n")


def coverage_curve(members: DataFrame, ranks: DataFrame, candidate: str, metric: str, weight: str) -> DataFrame:
    """Cumulative distinct weight over candidates in rank order: a metric counts at its first rank only.

    members: (candidate, metric, weight), a metric's weight being the same in every row; ranks: (candidate, rank).
    """
    first = members.join(ranks, candidate).groupBy(metric).agg(F.min("rank").alias("rank"), F.max(weight).alias("w"))
    added = ranks.join(first.groupBy("rank").agg(F.sum("w").alias("added")), "rank", "left").na.fill(0, ["added"])
    total = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)  # one row a candidate
    return added.select(candidate, "rank", "added", F.sum("added").over(total).alias("cumulative"))


def projection(edges: DataFrame, node: str, via: str, least: float, hot: int | None = None) -> DataFrame:
    """(a, b, shared, jaccard) of nodes whose sets of `via` have at least this Jaccard similarity.

    Pairs come from shared values only; `hot` leaves out values of at least so many nodes (hubs), which
    is part of the projection's definition.
    """
    e = edges.select(F.col(node).alias("n"), F.col(via).alias("v")).distinct()
    if hot:
        e = e.join(e.groupBy("v").count().where(F.col("count") < hot).select("v"), "v", "left_semi")
    sizes = e.groupBy("n").agg(F.count("*").alias("s"))
    x, y = e.select(F.col("n").alias("a"), "v"), e.select(F.col("n").alias("b"), "v")
    both = x.join(y, "v").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    both = both.join(sizes.select(F.col("n").alias("a"), F.col("s").alias("sa")), "a").join(sizes.select(F.col("n").alias("b"), F.col("s").alias("sb")), "b")
    return both.withColumn("jaccard", F.col("shared") / (F.col("sa") + F.col("sb") - F.col("shared"))).where(F.col("jaccard") >= least).select("a", "b", "shared", "jaccard")


def stability(now: DataFrame, before: DataFrame, name: str, member: str) -> DataFrame:
    """(name, best): each earlier set's best Jaccard similarity to a current one, 0 if they share nothing."""
    n, b = now.select(F.col(name).alias("x"), member).distinct(), before.select(F.col(name).alias("y"), member).distinct()
    ns, bs = n.groupBy("x").agg(F.count("*").alias("nx")), b.groupBy("y").agg(F.count("*").alias("ny"))
    both = n.join(b, member).groupBy("x", "y").agg(F.count("*").alias("k")).join(ns, "x").join(bs, "y")
    best = both.groupBy("y").agg(F.max(F.col("k") / (F.col("nx") + F.col("ny") - F.col("k"))).alias("best"))
    return bs.join(best, "y", "left").select(F.col("y").alias(name), F.coalesce("best", F.lit(0.0)).alias("best"))


def inversions(values: np.ndarray) -> int:
    """Pairs in the wrong order, by merging sorted halves."""
    total, width, x = 0, 1, np.asarray(values)
    while width < len(x):
        out = x.copy()
        for at in range(0, len(x), 2 * width):
            left, right = x[at : at + width], x[at + width : at + 2 * width]
            total += int((len(left) - np.searchsorted(left, right, "right")).sum())
            out[at : at + len(left) + len(right)] = np.sort(np.concatenate((left, right)), kind="stable")
        x, width = out, 2 * width
    return total


def kendall_tau(ranks: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """(tau): concordant minus discordant over all pairs of two rankings without ties, in n log n.

    One row a candidate; they meet in one task, as two ranks each.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [x for x in batches if len(x)]
        if held:
            x = pd.concat(held).sort_values(a)
            n = len(x)
            pairs = n * (n - 1) // 2
            yield pd.DataFrame({"tau": [(pairs - 2 * inversions(x[b].to_numpy())) / pairs if pairs else None]})

    return ranks.select(key, a, b).repartition(1).mapInPandas(run, "tau double")


def conflicts(items: DataFrame, key: str, blocks: str, differs: str) -> DataFrame:
    """(a, b) of items that share a block key (an array) and differ; each pair once."""
    e = items.select(F.col(key).alias("k"), F.col(differs).alias("d"), F.explode(F.array_distinct(blocks)).alias("block"))
    x, y = e.select(F.col("k").alias("a"), F.col("d").alias("da"), "block"), e.select(F.col("k").alias("b"), F.col("d").alias("db"), "block")
    return x.join(y, "block").where("a < b and not (da <=> db)").groupBy("a", "b").agg(F.count("*").alias("shared_blocks"))


def lineage_walk(nodes: DataFrame, edges: DataFrame, hops: int = 4) -> DataFrame:
    """(node, terminal, hops): follows the single upstream edge of a node up to `hops` times.

    nodes: (node); edges: (src, tgt), src upstream of tgt. A node with several or no upstreams ends the walk.
    """
    single = edges.groupBy("tgt").agg(F.count("*").alias("n"), F.min("src").alias("src")).where("n = 1").select("tgt", "src")
    out = nodes.select("node", F.col("node").alias("at"), F.lit(0).alias("hops"))
    for _ in range(hops):
        step = single.select(F.col("tgt").alias("at"), F.col("src").alias("next"))
        out = out.join(step, "at", "left").select("node", F.coalesce("next", "at").alias("at"), (F.col("hops") + F.col("next").isNotNull().cast("int")).alias("hops"))
    return out.select("node", F.col("at").alias("terminal"), "hops")
