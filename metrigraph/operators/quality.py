"""Data-quality rules: one pass a table, conditional aggregates, one row a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scorecard(df: DataFrame, table: str, rules: list[tuple[str, str, Column, float, bool]]) -> DataFrame:
    """rules: (id, dimension, failed, threshold, warn_only) -> rule, dimension, checked, failed, share, result."""
    aggs = [F.count("*").alias("n"), *[F.count_if(F.coalesce(bad, F.lit(False))).alias(f"f{i}") for i, (_, _, bad, _, _) in enumerate(rules)]]
    rows = [F.struct(F.lit(table).alias("input"), F.lit(r).alias("rule"), F.lit(d).alias("dimension"), F.col("n").alias("checked"), F.col(f"f{i}").alias("failed"), F.lit(float(t)).alias("threshold"), F.lit(w).alias("warn_only")) for i, (r, d, _, t, w) in enumerate(rules)]
    out = df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    share = F.when(F.col("checked") > 0, F.col("failed") / F.col("checked")).otherwise(0.0)
    result = F.when(F.col("failed") == 0, "pass").when((share <= F.col("threshold")) | F.col("warn_only"), "warn").otherwise("fail")
    return out.select("input", "rule", "dimension", "checked", "failed", share.alias("share"), result.alias("result"))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """One row: how many rows repeat an earlier row's key."""
    return df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("repeats"))


def freshness(dates: DataFrame, date: str, as_of: Column, warn: int = 30, fail: int = 90) -> DataFrame:
    """One row: age of the oldest input and the gate's verdict."""
    age = F.datediff(as_of, F.min(date))
    return dates.agg(F.min(date).alias("oldest"), age.alias("age_days"), F.datediff(F.max(date), F.min(date)).alias("spread_days"), F.when(age > fail, "fail").when(age > warn, "warn").otherwise("pass").alias("verdict"))
