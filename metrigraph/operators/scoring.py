"""Feature scores, dimensions, gates, status, archetypes, value, effort, quadrants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrigraph.functions.scalars import log_ratio
from metrigraph.storage import keep

DIMENSIONS = {"demand": 0.35, "consolidation": 0.30, "feasibility": 0.25, "risk": -0.10}
SIZES = ((12, "XS"), (24, "S"), (45, "M"), (75, "L"))
DISCOUNT, YEARS, RAMP = 0.08, 3, 0.5


def run_relative(df: DataFrame, features: list[str]) -> DataFrame:
    """Each feature beside its logarithmic share of the run's maximum. The maxima are one row."""
    most = df.agg(*[F.max(f).alias(f"_{f}") for f in features])
    out = df.crossJoin(F.broadcast(most))
    return out.select(*df.columns, *[log_ratio(F.col(f), F.col(f"_{f}")).alias(f"{f}_n") for f in features])


def composite(dims: dict[str, Column], weights: dict[str, float] = DIMENSIONS) -> Column:
    """100 * weighted sum of unit dimensions."""
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + F.lit(w) * dims[name]
    return 100 * total


def status(g4: Column, *others: Column) -> Column:
    """Blocked if the source gate fails, Exploratory if any other does, else Proposed."""
    every = others[0]
    for g in others[1:]:
        every = every & g
    return F.when(~g4, "Blocked").when(~every, "Exploratory").otherwise("Proposed")


def first_rule(rules: list[tuple[str, Column, float]], default: str) -> Column:
    """The first archetype, in order, whose score reaches its threshold."""
    return F.coalesce(*[F.when(score >= least, F.lit(name)) for name, score, least in rules], F.lit(default))


def effort_size(points: Column) -> Column:
    out = F.lit("XL")
    for most, name in reversed(SIZES):
        out = F.when(points <= most, name).otherwise(out)
    return out


def npv(benefit: Column, cost: Column) -> Column:
    """-cost and the discounted benefits, the first year's being ramped."""
    out = -cost
    for y in range(1, YEARS + 1):
        out = out + benefit * (RAMP if y == 1 else 1.0) / (1 + DISCOUNT) ** y
    return out


def upper_median(df: DataFrame, column: str) -> DataFrame:
    """One row: the element n/2 (from 0) of the sorted values: the discrete median from above."""
    return df.agg(F.expr(f"percentile_disc(0.5) within group (order by `{column}` desc)").alias(f"{column}_median"))


def quadrants(df: DataFrame, value: str, effort: str) -> DataFrame:
    """One row a candidate: quick_wins, big_bets, fill_ins or reconsider by the upper medians."""
    cut = upper_median(df, value).crossJoin(upper_median(df, effort))
    high, heavy = F.col(value) >= F.col(f"{value}_median"), F.col(effort) >= F.col(f"{effort}_median")
    kind = F.when(high & ~heavy, "quick_wins").when(high, "big_bets").when(~heavy, "fill_ins").otherwise("reconsider")
    return df.crossJoin(F.broadcast(cut)).select(*df.columns, kind.alias("quadrant"))  # one row of medians


def rank_by(df: DataFrame, score: Column, tie: str, group: list[str] | None = None) -> DataFrame:
    order = (Window.partitionBy(*group) if group else Window).orderBy(score.desc(), tie)
    return df.withColumn("rank", F.row_number().over(order))


def rank_all(df: DataFrame, score: Column, tie: str) -> DataFrame:
    """df with its rank over all rows, without one task that sorts them: ranges are sorted apart, and each adds the number
    of rows before it. The sorted rows are written once, as ranges of a second sort could be cut elsewhere."""
    at = keep(df.orderBy(score.desc(), tie).withColumn("_id", F.monotonically_increasing_id()))
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    sizes = at.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))  # one row a range
    return at.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("rank", (F.col("_before") + place + 1)).select(*df.columns, "rank")
