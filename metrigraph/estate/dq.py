"""Thirty-one rules over the four extracts. Counts of an extract come from one pass; uniqueness from one group-by each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrigraph.estate.graph import raw_reference
from metrigraph.sources.validate import Bundle

# Vocabularies of the extracts.
DISPOSITIONS = ("keep", "merge", "retire", "migrate")
AGGREGATIONS = ("", "sum", "avg", "average", "count", "count distinct", "distinct count", "max", "min", "ratio", "median", "stddev", "variance", "percentile", "aggregate", "none", "calculated")
CLASSIFICATIONS = ("", "public", "internal", "confidential", "restricted")
LIFECYCLES = ("", "active", "sunset", "deprecated", "retired")
FREQUENCIES = ("", "hourly", "daily", "weekly", "fortnightly", "monthly", "quarterly", "annual", "annually", "yearly", "half", "semi", "ad", "adhoc", "on")
SAMPLE = 10


def _low(c: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))


def _rules(df: DataFrame, name: str, key: Column, rules: list[tuple[str, str, str, Column, float, bool]]) -> DataFrame:
    """One pass over df: rows checked and failed of each rule, and the smallest key that failed; `failing` lists more."""
    aggs = [F.count("*").alias("n")]
    for i, (*_, bad, _, _) in enumerate(rules):
        holds = F.coalesce(bad, F.lit(False))
        aggs += [F.count_if(holds).alias(f"f{i}"), F.min(F.when(holds, key)).alias(f"s{i}")]
    rows = [F.struct(F.lit(name).alias("input"), F.lit(dim).alias("dimension"), F.lit(r).alias("rule_id"), F.lit(text).alias("description"), F.col("n").alias("checked"), F.col(f"f{i}").alias("failed"), F.lit(float(t)).alias("threshold"), F.lit(w).alias("warn_only"), F.col(f"s{i}").alias("sample")) for i, (r, dim, text, _, t, w) in enumerate(rules)]
    return df.agg(*aggs).where("n > 0").select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _unique(df: DataFrame, name: str, rule: str, text: str, *keys: Column) -> DataFrame:
    named = [k.alias(f"k{i}") for i, k in enumerate(keys)]
    n = df.agg(F.count("*").alias("n"))
    twice = df.groupBy(*named).count().agg(F.count_if(F.col("count") > 1).alias("failed"), F.min(F.when(F.col("count") > 1, F.concat_ws("@", *[F.col(f"k{i}") for i in range(len(keys))]))).alias("sample"))
    return n.crossJoin(twice).where("n > 0").select(F.lit(name).alias("input"), F.lit("uniqueness").alias("dimension"), F.lit(rule).alias("rule_id"), F.lit(text).alias("description"), F.col("n").alias("checked"), "failed", F.lit(0.0).alias("threshold"), F.lit(False).alias("warn_only"), "sample")  # one row each


def scorecard(b: Bundle) -> DataFrame:
    """(input, dimension, rule_id, description, checked, failed, share, threshold, result, sample) of every rule.

    An empty extract has no rows here. result: pass, warn (within the threshold, or warn-only), fail.
    """
    day = F.lit(b.as_of)
    r, k, c, g = b.reports, b.kpis, b.columns, b.glossary
    col = F.col
    head = F.split(_low("schedule_frequency"), " ")[0]
    out = _rules(r, "reports", col("report_id"), [
        ("RPT-02", "validity", "disposition is known", ~_low("disposition").isin(*DISPOSITIONS), 0, False),
        ("RPT-03", "validity", "counts are not negative", F.least("run_count_90d", "run_count_12m", "distinct_users_12m") < 0, 0, False),
        ("RPT-04", "consistency", "runs of 90 days are among those of 12 months", col("run_count_90d") > col("run_count_12m"), 0, False),
        ("RPT-05", "timeliness", "last run isn't after the as-of date", col("last_run_date") > day, 0, False),
        ("RPT-06", "completeness", "last run present", col("last_run_date").isNull(), 0.05, True),
        ("RPT-07", "completeness", "owner and business unit present", (col("owner") == "") | (col("business_unit") == ""), 0.05, True),
        ("RPT-08", "consistency", "a scheduled report has a known frequency", col("schedule_flag") & ~head.isin(*FREQUENCIES), 0.05, True),
        ("RPT-09", "consistency", "runs in 90 days mean a last run within them", (col("run_count_90d") > 0) & (F.datediff(day, "last_run_date") > 90), 0.02, True),
    ])
    out = out.union(_unique(r, "reports", "RPT-01", "report_id is unique", col("report_id")))
    out = out.union(_rules(k, "kpi_lineage", col("kpi_id"), [
        ("KPI-02", "validity", "aggregation is known", ~_low("aggregation_type").isin(*AGGREGATIONS), 0, False),
        ("KPI-03", "completeness", "expression present", col("calculation_expression") == "", 0.05, True),
        ("KPI-04", "completeness", "table and column present", (col("table") == "") | (col("column") == ""), 0.02, True),
        ("KPI-07", "validity", "usage_rank is not negative", col("usage_rank") < 0, 0, False),
    ]))
    out = out.union(_unique(k, "kpi_lineage", "KPI-01", "(kpi_id, report_id, reference) is unique", col("kpi_id"), col("report_id"), raw_reference("source_system", "database", "schema", "table", "column")))
    known = r.select("report_id", F.lit(True).alias("known")).distinct()
    out = out.union(_rules(k.join(known, "report_id", "left"), "kpi_lineage", col("kpi_id"), [("KPI-05", "consistency", "report_id is in the inventory", col("known").isNull(), 0.02, True)]))
    reuse = k.groupBy(_low("kpi_label").alias("l")).agg(F.count_distinct("report_id").alias("derived"))
    told = k.where("cross_report_count > 0").withColumn("l", _low("kpi_label")).join(reuse, "l")
    out = out.union(_rules(told, "kpi_lineage", col("kpi_id"), [("KPI-06", "accuracy", "declared reuse agrees with derived reuse (25 %)", F.abs(col("cross_report_count") - col("derived")) > F.greatest(F.lit(1.0), 0.25 * col("cross_report_count")), 0.1, True)]))
    sunset = col("lifecycle_status") == "sunset"
    out = out.union(_rules(c, "catalog", col("column_fqn"), [
        ("CAT-02", "validity", "classification is known", ~_low("classification").isin(*CLASSIFICATIONS), 0, False),
        ("CAT-03", "validity", "lifecycle is known", ~_low("lifecycle_status").isin(*LIFECYCLES), 0, False),
        ("CAT-04", "validity", "quality score within 0-100", (col("quality_score") < 0) | (col("quality_score") > 100), 0, False),
        ("CAT-05", "completeness", "term present", col("business_term") == "", 0.30, True),
        ("CAT-06", "completeness", "steward present", col("data_steward") == "", 0.15, True),
        ("CAT-07", "completeness", "domain present", col("data_domain") == "", 0.05, True),
        ("CAT-08", "consistency", "what is in sunset has a date", sunset & (col("sunset_date") == ""), 1.0, True),
        ("CAT-09", "completeness", "certification present", col("certification_status") == "", 0.5, True),
        ("CAT-10", "consistency", "personal data is above Internal", col("pii_flag") & _low("classification").isin("", "public", "internal"), 0, True),
    ]))
    out = out.union(_unique(c, "catalog", "CAT-01", "column is unique", col("column_fqn")))
    out = out.union(_rules(g, "glossary", col("term_id"), [
        ("GLO-03", "completeness", "definition present", col("definition") == "", 0.1, True),
        ("GLO-04", "completeness", "steward present", col("steward") == "", 0.15, True),
        ("GLO-05", "completeness", "status present", col("status") == "", 0.1, True),
    ]))
    out = out.union(_unique(g, "glossary", "GLO-01", "term is unique", _low("term"))).union(_unique(g, "glossary", "GLO-02", "term_id is unique", col("term_id")))
    share = F.when(col("checked") > 0, col("failed") / col("checked")).otherwise(0.0)
    result = F.when(col("failed") == 0, "pass").when((F.round(share, 4) <= col("threshold")) | col("warn_only"), "warn").otherwise("fail")
    return out.select("input", "dimension", "rule_id", "description", "checked", "failed", share.alias("share"), "threshold", result.alias("result"), "sample")


def failing(df: DataFrame, key: str, bad: Column, n: int = SAMPLE) -> DataFrame:
    """The first keys that fail a rule, for a register."""
    return df.where(bad).select(key).distinct().orderBy(key).limit(n)


def summary(rows: DataFrame) -> DataFrame:
    """(input, rules, passed, warned, failed)."""
    n = lambda r, name: F.count_if(F.col("result") == r).alias(name)
    return rows.groupBy("input").agg(F.count("*").alias("rules"), n("pass", "passed"), n("warn", "warned"), n("fail", "failed"))
