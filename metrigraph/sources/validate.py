"""Validation of a bundle of typed extracts: counts, issues by severity, reconciliation with a manifest."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE = 0.005
ISSUE = "severity string, code string, affected long"


@dataclass(frozen=True)
class Bundle:
    """Typed extracts of one run (see sources.adapters) and the date they stand for."""

    reports: DataFrame
    kpis: DataFrame
    columns: DataFrame
    lineage: DataFrame
    glossary: DataFrame
    as_of: date | None = None
    industry: str = "generic"
    mode: str = "manual"


def stamp(bundle: Bundle, as_of: date | None = None) -> Bundle:
    return replace(bundle, as_of=as_of or bundle.as_of)


def one_catalog(columns: DataFrame, preferred: str | None = None) -> DataFrame:
    """Columns of one catalog only: the preferred one if it has any, else the first by name."""
    best = columns.groupBy("catalog").count().select(F.min(F.struct((F.col("catalog") != F.lit(preferred or "")).alias("other"), "catalog")).alias("b")).select(F.col("b.catalog").alias("catalog"))
    return columns.join(F.broadcast(best), "catalog", "left_semi").select(*columns.columns)  # one row


def counts(b: Bundle) -> DataFrame:
    """(input, n) of the five inputs."""
    out = None
    for name, df in (("reports", b.reports), ("kpi_rows", b.kpis), ("catalog_columns", b.columns), ("catalog_lineage", b.lineage), ("glossary_terms", b.glossary)):
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("input"), "n")
        out = one if out is None else out.union(one)
    return out


def reconcile(b: Bundle, expected: dict[str, int]) -> DataFrame:
    """(input, expected, actual, drift, within_tolerance) against a manifest's counts."""
    want = b.kpis.sparkSession.createDataFrame([(k, v) for k, v in expected.items() if v] or [("", 1)], "input string, expected long").where("input <> ''")
    drift = F.abs(F.col("n") - F.col("expected")) / F.col("expected")
    return counts(b).join(F.broadcast(want), "input").select("input", "expected", F.col("n").alias("actual"), drift.alias("drift"), (drift <= TOLERANCE).alias("within_tolerance"))  # five rows


def issues(b: Bundle, expected: dict[str, int] | None = None) -> DataFrame:
    """(severity, code, affected) of what is wrong with the bundle. Each input is read once, as sums of one row."""
    report_ids = b.reports.select("report_id").distinct()
    orphans = b.kpis.select("report_id").distinct().join(report_ids, "report_id", "left_anti").agg(F.count("*").alias("orphans"))
    r = b.reports.agg(
        F.count("*").alias("reports"),
        F.count_distinct("report_id").alias("report_ids"),
        F.count_if(F.col("run_count_12m") > 0).alias("used"),
        F.count_if(F.col("last_run_date").isNull()).alias("undated"),
        F.count_if("synthetic").alias("r_synthetic"),
    )
    k = b.kpis.agg(
        F.count("*").alias("kpis"),
        F.count_if(F.col("calculation_expression") == "").alias("no_expression"),
        F.count_if((F.col("table") == "") | (F.col("column") == "")).alias("no_reference"),
        F.count_if("synthetic").alias("k_synthetic"),
    )
    c = b.columns.agg(F.count("*").alias("columns"))
    row = r.crossJoin(k).crossJoin(c).crossJoin(orphans)  # one row each
    x = F.col
    rows_, synthetic = x("reports") + x("kpis"), x("r_synthetic") + x("k_synthetic")
    found = [
        ("error", "NO_KPI_LINEAGE", x("kpis") == 0, F.lit(0)),
        ("warning", "NO_REPORT_INVENTORY", x("reports") == 0, F.lit(0)),
        ("warning", "NO_CATALOG", x("columns") == 0, F.lit(0)),
        ("error", "MIXED_SYNTHETIC", (synthetic > 0) & (synthetic < rows_), synthetic),
        ("error", "ORPHAN_KPI_REPORTS", (x("report_ids") > 0) & (x("orphans") > x("report_ids")), x("orphans")),
        ("warning", "ORPHAN_KPI_REPORTS", (x("report_ids") > 0) & (x("orphans") > 0) & (x("orphans") <= x("report_ids")), x("orphans")),
        ("warning", "MISSING_EXPRESSION", x("no_expression") > 0, x("no_expression")),
        ("warning", "MISSING_COLUMN_REFERENCE", x("no_reference") > 0, x("no_reference")),
        ("warning", "SPARSE_USAGE", (x("reports") > 0) & (x("used") < 0.5 * x("reports")), x("reports") - x("used")),
        ("warning", "MISSING_LAST_RUN", x("undated") > 0, x("undated")),
    ]
    each = F.array(*[F.when(holds, F.struct(F.lit(s).alias("severity"), F.lit(code).alias("code"), n.cast("long").alias("affected"))) for s, code, holds, n in found])
    out = row.select(F.explode(F.filter(each, lambda e: e.isNotNull())).alias("i")).select("i.*")
    if expected:
        off = reconcile(b, expected).where("not within_tolerance").select(F.lit("error").alias("severity"), F.lit("RECONCILIATION_FAILED").alias("code"), F.abs(F.col("actual") - F.col("expected")).alias("affected"))
        out = out.union(off)
    return out
