"""Usage demand: percentiles within a tool, quantile parity across tools, recency decay, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrigraph.functions.scalars import recency_decay


#: Pieces of the pool of run counts: a value that many reports have is in at most so many.
PIECES = 1000


def within_percentile(df: DataFrame, tool: str, runs: str, key: str, out: str = "percentile") -> DataFrame:
    """row_number / n within the tool, by runs, then key."""
    by = Window.partitionBy(tool)
    # Counts of each run count come first, so that only reports of one tool and run count are ranked together.
    same = df.groupBy(tool, F.col(runs).alias("_r")).agg(F.count("*").alias("_k"))
    before = same.select(tool, "_r", (F.sum("_k").over(by.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_k")).alias("_below"), F.sum("_k").over(by).alias("_all"))
    mine = df.withColumn("_r", F.col(runs)).withColumn("_tie", F.row_number().over(Window.partitionBy(tool, runs).orderBy(key)))
    out_ = mine.join(before, [tool, "_r"]).withColumn(out, (F.col("_below") + F.col("_tie")) / F.col("_all"))
    return out_.select(*df.columns, out)


def quantile_parity(df: DataFrame, percentile: str, runs: str, key: str, out: str = "parity_runs") -> DataFrame:
    """The pooled sorted run counts' value at the half-even index round(p * (n - 1)).

    Ranks over the pool come from counts of distinct run values, so no window runs over all rows.
    """
    floor = F.greatest(F.col(runs), F.lit(0))
    values = df.groupBy(floor.alias("_v")).agg(F.count("*").alias("_c"))
    n = df.agg(F.count("*").alias("_n"), F.greatest(F.lit(1), F.ceil(F.count("*") / PIECES)).alias("_w"))
    upto = values.withColumn("_to", F.sum("_c").over(Window.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))  # one row a run count
    at = df.crossJoin(F.broadcast(n)).withColumn("_i", F.bround(F.col(percentile) * (F.col("_n") - 1)).cast("long"))  # one row
    # A value holds the places from _from to before _to of the pool; places and values meet by pieces of the pool.
    spans = upto.crossJoin(F.broadcast(n.select("_w"))).withColumn("_from", F.col("_to") - F.col("_c"))
    spans = spans.select("_v", "_from", "_to", F.explode(F.sequence(F.floor(F.col("_from") / F.col("_w")), F.floor((F.col("_to") - 1) / F.col("_w")))).alias("_piece"))
    wanted = at.select("_i", F.floor(F.col("_i") / F.col("_w")).alias("_piece")).distinct()
    found = wanted.join(spans, "_piece").where("_i >= _from and _i < _to").select("_i", F.col("_v").alias(out))
    return at.join(found, "_i").drop("_i", "_n", "_w")


def usage_weight(runs: Column, users: Column, last: Column, as_of: Column, critical: Column | None = None, half_life: Column | float = 6.0) -> Column:
    """ln(1+runs) * max(1, users) * decay; decision-critical reports keep at least 0.6 of the undecayed weight."""
    base = F.log(1 + runs) * F.greatest(F.lit(1), users)
    decayed = base * recency_decay(last, as_of, half_life)
    return decayed if critical is None else F.when(critical, F.greatest(decayed, 0.6 * base)).otherwise(decayed)
