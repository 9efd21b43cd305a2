"""Adapters: extracts of each contract as one typed shape per entity, whatever tool they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrigraph.functions import scalars as S
from metrigraph.sources.contracts import bind

REPORT = ("report_id", "report_name", "folder_path", "tool", "semantic_container", "workspace", "owner", "business_unit", "run_count_90d", "run_count_12m", "distinct_users_12m", "last_run_date", "schedule_flag", "schedule_frequency", "disposition", "redundancy_cluster_id", "complexity_score", "decision_critical", "synthetic", "generation_id")
KPI = ("kpi_id", "kpi_label", "report_id", "semantic_container", "query_subject", "query_item", "calculation_expression", "expression_language", "aggregation_type", "filter_expression", "source_system", "database", "schema", "table", "column", "usage_rank", "cross_report_count", "measure_scope", "column_role", "storage_mode", "tool", "synthetic", "generation_id")


def _of(name: str, default: Column | str = "") -> Column:
    return F.coalesce(F.col(name), default if isinstance(default, Column) else F.lit(default))


def _stamp() -> list[Column]:
    return [S.as_bool(F.col("synthetic")).alias("synthetic"), _of("generation_id").alias("generation_id")]


def reports(df: DataFrame, tool: str = "cognos", mapping: dict[str, str] | None = None) -> DataFrame:
    """Report inventory rows; those without an id are dropped."""
    model = tool == "powerbi"
    b = bind(df, "powerbi_inventory" if model else "cognos_rationalization", mapping).where("report_id is not null")
    runs = ("view_count_90d", "view_count_12m", "last_viewed_date") if model else ("run_count_90d", "run_count_12m", "last_run_date")
    none, schedule = F.lit(""), _of("refresh_schedule") if model else _of("schedule_frequency")
    workspace = _of("workspace") if model else none
    return b.select(
        "report_id",
        _of("report_name", F.col("report_id")).alias("report_name"),
        (F.when(workspace != "", F.concat(F.lit("/"), workspace)).otherwise("") if model else _of("folder_path")).alias("folder_path"),
        F.lit(tool).alias("tool"),
        _of("semantic_model" if model else "fm_package").alias("semantic_container"),
        workspace.alias("workspace"),
        _of("owner").alias("owner"),
        _of("business_unit", "Unassigned").alias("business_unit"),
        S.as_int(F.col(runs[0])).alias("run_count_90d"),
        S.as_int(F.col(runs[1])).alias("run_count_12m"),
        S.as_int(F.col("distinct_users_12m")).alias("distinct_users_12m"),
        S.as_date(F.col(runs[2])).alias("last_run_date"),
        (schedule != "" if model else S.as_bool(F.col("schedule_flag"))).alias("schedule_flag"),
        schedule.alias("schedule_frequency"),
        S.disposition(F.col("disposition")).alias("disposition"),
        (none if model else _of("redundancy_cluster_id")).alias("redundancy_cluster_id"),
        (F.lit(0.0) if model else S.as_float(F.col("complexity_score"))).alias("complexity_score"),
        (F.lit(False) if model else S.as_bool(F.col("decision_critical"))).alias("decision_critical"),
        *_stamp(),
    )


def kpis(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Metric lineage rows of the first dialect; rows without metric or report are dropped."""
    b = bind(df, "cognos_kpi_lineage", mapping).where("kpi_id is not null and report_id is not null")
    return b.select(
        "kpi_id",
        _of("kpi_label", F.col("kpi_id")).alias("kpi_label"),
        "report_id",
        _of("fm_package").alias("semantic_container"),
        *[_of(c).alias(c) for c in ("query_subject", "query_item", "calculation_expression")],
        F.when(F.lower(_of("expression_language")).startswith("dax"), "dax").otherwise("cognos").alias("expression_language"),
        *[_of(c).alias(c) for c in ("aggregation_type", "filter_expression", "source_system", "database", "schema", "table", "column")],
        S.as_int(F.col("usage_rank")).alias("usage_rank"),
        S.as_int(F.col("cross_report_count")).alias("cross_report_count"),
        _of("measure_scope", "report").alias("measure_scope"),
        F.lower(_of("column_role")).alias("column_role"),
        F.lit("").alias("storage_mode"),
        F.lit("cognos").alias("tool"),
        *_stamp(),
    )


def measures(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Metric lineage rows of the second dialect; a measure of a whole model names no report and stays."""
    b = bind(df, "powerbi_measure_lineage", mapping).where("measure_id is not null")
    scope = F.lower(_of("measure_scope", F.when(F.col("report_id").isNotNull(), "report").otherwise("model")))
    return b.select(
        F.col("measure_id").alias("kpi_id"),
        _of("measure_name", F.col("measure_id")).alias("kpi_label"),
        _of("report_id").alias("report_id"),
        _of("semantic_model").alias("semantic_container"),
        _of("model_table").alias("query_subject"),
        _of("model_column").alias("query_item"),
        _of("dax_expression").alias("calculation_expression"),
        F.lit("dax").alias("expression_language"),
        _of("aggregation_type").alias("aggregation_type"),
        _of("filter_expression").alias("filter_expression"),
        _of("source_system").alias("source_system"),
        *[_of(f"source_{c}").alias(c) for c in ("database", "schema", "table", "column")],
        F.lit(0).cast("long").alias("usage_rank"),
        F.lit(0).cast("long").alias("cross_report_count"),
        F.when(scope.startswith("model"), "model").otherwise("report").alias("measure_scope"),
        F.lower(_of("column_role")).alias("column_role"),
        _of("storage_mode").alias("storage_mode"),
        F.lit("powerbi").alias("tool"),
        *_stamp(),
    )


def attach_model_measures(rows: DataFrame, inventory: DataFrame) -> DataFrame:
    """Measures of a model go to every report of it: the first keeps the id, the others get `id::report`.

    Measures that name no report and belong to no report's model are dropped; `unplaced` returns them.
    inventory: (report_id, semantic_container), the first report being the smallest id.
    """
    lacks = (F.col("tool") == "powerbi") & (F.col("report_id") == "")
    key = lambda c: F.lower(F.trim(c))
    of = inventory.where(F.trim("semantic_container") != "").select(key("semantic_container").alias("_model"), F.col("report_id").alias("_report")).distinct()
    first = of.groupBy("_model").agg(F.min("_report").alias("_first"))
    spread = rows.where(lacks & (F.col("measure_scope") == "model")).withColumn("_model", key("semantic_container")).join(of, "_model").join(first, "_model")
    own = F.when(F.col("_report") == F.col("_first"), F.col("kpi_id")).otherwise(F.concat("kpi_id", F.lit("::"), "_report"))
    spread = spread.withColumn("kpi_id", own).withColumn("report_id", F.col("_report"))
    return rows.where(~lacks).select(*rows.columns).unionByName(spread.select(*rows.columns))


def unplaced(rows: DataFrame, inventory: DataFrame) -> DataFrame:
    """Measures that no report can be found for: of a report that they don't name, or of a model without reports."""
    key = lambda c: F.lower(F.trim(c))
    lacks = rows.where("tool = 'powerbi' and report_id = ''").withColumn("_model", key("semantic_container"))
    models = inventory.where(F.trim("semantic_container") != "").select(key("semantic_container").alias("_model")).distinct()
    return lacks.where("measure_scope <> 'model'").union(lacks.where("measure_scope = 'model'").join(models, "_model", "left_anti").select(*lacks.columns)).select(*rows.columns)


#: Our column, the first catalog's field, the second's.
CATALOG_FIELDS = (
    ("system", "system", "ds_name"), ("database", "database", "db_name"), ("schema", "schema", "schema_name"), ("table", "table", "table_name"), ("column", "column", "column_name"),
    ("business_term", "business_term", "title"), ("definition", "definition", "description"), ("data_domain", "data_domain", "custom_field_domain"), ("sub_domain", "sub_domain", "custom_field_sub_domain"),
    ("data_owner", "data_owner", "data_owner"), ("data_steward", "data_steward", "steward"), ("data_type", "data_type", "type_name"), ("foreign_key", "foreign_key", "fk_target"), ("certification_status", "certification_status", "endorsement"),
)


def fqn(*parts: str) -> Column:
    """Dotted name that keeps empty parts."""
    return F.concat_ws(".", *[F.coalesce(F.col(f"`{p}`"), F.lit("")) for p in parts])


def columns(df: DataFrame, catalog: str = "collibra", mapping: dict[str, str] | None = None) -> DataFrame:
    """Catalog columns of either catalog; rows without table or column are dropped."""
    second = catalog == "alation"
    b = bind(df, "alation_metadata" if second else "collibra_metadata", mapping)
    pick = lambda a, z: F.col(z if second else a)
    out = b.select(
        *[F.coalesce(pick(a, z), F.lit("")).alias(ours) for ours, a, z in CATALOG_FIELDS],
        S.sensitivity(pick("classification", "sensitivity_label")).alias("classification"),
        S.as_bool(pick("pii_flag", "pii")).alias("pii_flag"),
        S.as_bool(pick("nullable", "is_nullable"), True).alias("nullable"),
        S.as_bool(pick("primary_key", "is_pk")).alias("primary_key"),
        S.as_bool(pick("system_of_record", "source_of_record")).alias("system_of_record"),
        S.as_float(pick("quality_score", "data_health_score")).alias("quality_score"),
        S.lifecycle(pick("lifecycle_status", "lifecycle_stage")).alias("lifecycle_status"),
        (F.lit("") if second else _of("sunset_date")).alias("sunset_date"),
        (F.lit("") if second else _of("successor_system")).alias("successor_system"),
        S.as_int(pick("row_count", "row_estimate")).alias("row_count"),
        F.lit(catalog).alias("catalog"),
        *_stamp(),
    ).where("`table` <> '' and `column` <> ''")
    return out.withColumn("table_fqn", fqn("system", "database", "schema", "table")).withColumn("column_fqn", fqn("system", "database", "schema", "table", "column"))


def lineage(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Catalog lineage: column edges if both ends name a column, else table edges."""
    b = bind(df, "catalog_lineage", mapping).where("src_table is not null and tgt_table is not null")
    level = F.lower(_of("level", F.when(F.col("src_column").isNotNull() & F.col("tgt_column").isNotNull(), "column").otherwise("table")))
    ends = ("system", "database", "schema", "table")
    cols = [f"{side}_{c}" for side in ("src", "tgt") for c in (*ends, "column")]
    out = b.select(*[_of(c).alias(c) for c in cols], F.when(level.startswith("col"), "column").otherwise("table").alias("level"), _of("transformation").alias("transformation"))
    name = lambda side: F.when(F.col("level") == "column", fqn(*[f"{side}_{c}" for c in (*ends, "column")])).otherwise(fqn(*[f"{side}_{c}" for c in ends]))
    return out.withColumn("src_fqn", name("src")).withColumn("tgt_fqn", name("tgt"))


def glossary(df: DataFrame, ordinal: str | None = None, mapping: dict[str, str] | None = None) -> DataFrame:
    """Glossary terms; a term without an id gets BT- and the number of its source row (`ordinal`, else by term)."""
    given = df if ordinal is None else df.withColumn("generation_id", F.col(ordinal).cast("string"))
    b = bind(given, "business_glossary", mapping).where("term is not null")
    number = F.col("generation_id").cast("long") if ordinal else F.row_number().over(Window.orderBy("term"))  # terms of one glossary
    return b.select(
        F.coalesce("term_id", F.concat(F.lit("BT-"), F.lpad(number.cast("string"), 4, "0"))).alias("term_id"),
        "term",
        *[_of(c).alias(c) for c in ("definition", "domain", "sub_domain", "steward", "status")],
    )
