"""Mixing sources to target weights with hash-threshold histograms.

Sizes are summed by source and hash bucket, the bucket in which a source's budget ends is found from the
running sum over its few buckets, and only the documents of that boundary bucket are looked at again, by
the next digits of their hash, until the bucket holds one hash value. Taking a document is then a
comparison of its hash with its source's threshold: no sort, and reruns agree.

A source's target is met in epochs: every document is taken floor(target / source size) times, and those
below the threshold once more; no document exceeds `most` times its size.

Defined results: null text has size 0; null source is a source of its own, last in order; sources that are
empty have target 0. Rows with equal id and text share one hash and are taken together. Sources of equal
hash boundary keep the nearer of the two sides, the lower one on a tie. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrigraph.storage import keep


WORD = r"[^\x20\x09-\x0D]+"
#: Hash bits, and bits by which each refinement splits a bucket.
BITS, STEP = 60, 10
#: Columns that apply() adds; columns of these names are replaced.
MIXED = ("mix_size", "mix_source_size", "mix_target", "mix_copies")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target) of (source, source_size): budgets by weight, stopping at most * source_size.

    The excess is shared again by weight until no source is above: a water level L with target
    min(weight * L, cap). Sources ordered by cap / weight are full up to some point; one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    s = s.withColumn("level", F.when(F.col("level") * F.col("w") < F.col("cap"), F.col("level")))
    everywhere = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = F.first("level", ignorenulls=True).over(everywhere)
    return s.select("source", "source_size", F.coalesce(F.least(F.col("w") * level, F.col("cap")), F.col("cap")).alias("target"))


def hash60(*parts: Column) -> Column:
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def thresholds(docs: DataFrame, budget: DataFrame) -> DataFrame:
    """(source, cut): of docs (source, size, h) those with h < cut sum up to about budget (source, budget)."""
    state = budget.select("source", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"), "budget")
    for shift in range(BITS - STEP, -1, -STEP):
        inside = docs.join(state, docs["source"].eqNullSafe(state["source"]), "inner").where(F.shiftright("h", shift + STEP) == F.col("prefix"))
        bucket = inside.groupBy(docs["source"].alias("source"), "prefix", "below", "budget", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"), F.min("h").alias("first"), F.max("h").alias("last"))
        running = Window.partitionBy("source").orderBy("bucket")
        upto = F.col("below") + F.sum("n").over(running)
        cut = bucket.withColumn("upto", upto).where("upto > budget").groupBy("source").agg(F.min(F.struct("bucket", "upto", "n", "budget", "first", "last")).alias("b"))
        state = keep(cut.select("source", F.col("b.bucket").alias("prefix"), (F.col("b.upto") - F.col("b.n")).alias("below"), "b.budget", "b.upto", "b.first", "b.last"))
        if not state.where("first < last").head(1):
            break
    nearer = (F.col("upto") - F.col("budget")) < (F.col("budget") - F.col("below"))
    return state.select("source", F.when(nearer, F.col("last") + 1).otherwise(F.col("first")).alias("cut"))


def _hash(id_col: str, text_col: str) -> Column:
    return hash60(F.col(id_col), F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def _size(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], share: float, most: float) -> tuple[DataFrame, DataFrame, Column]:
    """Rows (id, source, size, h), sources (of, source_size, target, epochs, budget, cut), and a row's copies."""
    sized = keep(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), _size(text_col).alias("size"), _hash(id_col, text_col).alias("h")))
    goal = keep(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    epochs = F.floor(ratio)
    goal = goal.withColumn("epochs", epochs).withColumn("budget", F.when(ratio > epochs, F.col("target") - epochs * F.col("source_size")).otherwise(0.0))
    part = goal.where("budget > 0").select("source", "budget")
    cut = thresholds(sized, part)
    goal = goal.join(cut.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    goal = keep(goal.withColumnRenamed("source", "of"))
    extra = F.when((F.col("budget") > 0) & (F.col("cut").isNull() | (F.col("h") < F.col("cut"))), 1).otherwise(0)  # no cut: all fit
    return sized, goal, (F.col("epochs") + extra).cast("long").alias("copies")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(id, source, size, source_size, target, copies) of every row."""
    sized, goal, copies = _plan(docs, id_col, text_col, source_col, weights, share, most)
    return sized.join(goal, F.col("source").eqNullSafe(F.col("of"))).select("id", "source", "size", "source_size", "target", copies)


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The rows of docs that the mixture takes, with all their columns and mix_size, mix_source_size, mix_target and mix_copies.

    Each row compares its own hash with its source's threshold: texts are not moved but to meet the
    table of sources, one row each.
    """
    _, goal, copies = _plan(docs, id_col, text_col, source_col, weights, share, most)
    own = docs.select(F.struct(*docs.columns).alias("_row"), F.col(source_col).alias("_source"), _hash(id_col, text_col).alias("h"), _size(text_col).alias("size"))
    joined = own.join(goal, F.col("_source").eqNullSafe(F.col("of")))
    out = joined.where(copies > 0).select(*[F.col(f"_row.`{c}`") for c in docs.columns if c not in MIXED], F.col("size").alias("mix_size"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), copies.alias("mix_copies"))
    return out


def op4(spark, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ([3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1]::DOUBLE AS w
  FROM d GROUP BY source),
f AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         (1.5::DOUBLE * sum(source_size) OVER ()
          - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s),
t AS (
  SELECT source, source_size,
         coalesce(least(w * first_value(CASE WHEN level * w < cap THEN level END IGNORE NULLS) OVER (
           ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), cap), cap) AS target FROM f),
g AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
b AS (SELECT *, target - epochs * source_size AS budget FROM g),
hs AS (SELECT source, h, sum(size) AS n FROM d GROUP BY source, h),
r AS (
  SELECT hs.source, hs.h, sum(n) OVER (PARTITION BY hs.source ORDER BY hs.h) AS upto, n, budget
  FROM hs JOIN b ON hs.source IS NOT DISTINCT FROM b.source),
e AS (
  SELECT source, h,
         CASE WHEN upto <= budget THEN 1
              WHEN upto - n <= budget AND upto - budget < budget - (upto - n) THEN 1 ELSE 0 END AS extra
  FROM r)
SELECT d.doc_id, d.size, b.source_size, b.target, ((b.epochs + CASE WHEN b.budget > 0 THEN e.extra ELSE 0 END) * d.size)::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
JOIN e ON d.source IS NOT DISTINCT FROM e.source AND d.h = e.h
"""
