"""The graph of an estate: columns with their terms, tables, domains, metrics' nodes with edges and quarantine."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrigraph.estate import grain as G
from metrigraph.functions import scalars as S
from metrigraph.functions.expressions import parse_distinct
from metrigraph.operators import resolve as R
from metrigraph.operators.relational import majority
from metrigraph.sources.validate import Bundle
from metrigraph.storage import together

CREDIT = {"approved": 1.0, "draft": 0.5, "retired": 0.0, "none": 0.0, "column-only": 1.0}


@dataclass(frozen=True)
class Graph:
    """reports, columns, tables, domains, kpis, edges, quarantine, kpi_reports (kpi_id, report_id), backbone.

    Nodes of equal values and edges are one calculation: nodes (kpi_id, report_ids, calc), calculations (calc, kpi_id of
    the first, n of them, values), and kpis is both joined. resolved: (kpi_id, confidence) of each lineage row.
    """

    reports: DataFrame
    columns: DataFrame
    tables: DataFrame
    domains: DataFrame
    glossary: DataFrame
    kpis: DataFrame
    edges: DataFrame
    quarantine: DataFrame
    kpi_reports: DataFrame
    backbone: list[str]
    backbone_source: str
    nodes: DataFrame
    calculations: DataFrame
    resolved: DataFrame


def first_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key that comes first in the order."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(order, *[F.col(f"`{c}`") for c in rest if c != order])).alias("r")).select(key, *[F.col(f"r.`{c}`") for c in rest]).select(*[F.col(f"`{c}`") for c in df.columns])


def terms(glossary: DataFrame) -> DataFrame:
    """One term per token key, the last by id: (term_key, term_id, term, definition, domain, steward, status, status_class)."""
    rows = glossary.select(S.token_key(F.col("term")).alias("term_key"), "term_id", "term", "definition", "domain", "steward", "status", S.glossary_status(F.col("status")).alias("status_class"))
    return rows.groupBy("term_key").agg(F.max_by(F.struct("term_id", "term", "definition", "domain", "steward", "status", "status_class"), "term_id").alias("t")).select("term_key", "t.*")


def link_terms(columns: DataFrame, glossary: DataFrame) -> DataFrame:
    """columns with the glossary applied: its definition and steward win, the column's own stay beside them."""
    t = terms(glossary).select("term_key", F.lit(True).alias("in_glossary"), "term_id", F.col("definition").alias("t_definition"), F.col("steward").alias("t_steward"), F.col("status_class").alias("t_class"))
    out = columns.withColumn("term_key", F.when(F.col("business_term") != "", S.token_key(F.col("business_term")))).join(t, "term_key", "left")
    linked, known = F.col("business_term") != "", F.coalesce("in_glossary", F.lit(False))
    defined, steward = F.coalesce("t_definition", F.lit("")), F.coalesce("t_steward", F.lit(""))
    return out.select(
        *[c for c in columns.columns if c not in ("definition", "data_steward")],
        F.coalesce("term_id", F.lit("")).alias("term_id"),
        F.when(~linked, "").when(known, F.col("t_class")).otherwise("column-only").alias("term_status"),
        F.when(linked & (defined != ""), defined).otherwise(F.col("definition")).alias("definition"),
        F.when(linked & (steward != ""), steward).otherwise(F.col("data_steward")).alias("steward"),
        F.col("data_steward").alias("column_steward"),
        steward.alias("glossary_steward"),
        F.when(linked & (defined != ""), "glossary").when(F.col("definition") != "", "column extract").otherwise("none").alias("definition_source"),
        (linked & (steward != "") & (F.col("data_steward") != "") & (F.col("data_steward") != steward)).alias("steward_disagreement"),
    )


def definition_credit(status: Column, term: Column, definition: Column) -> Column:
    """How much a column's definition counts, by the state of its term; 0 without term or definition."""
    of = F.coalesce(*[F.when(status == k, F.lit(v)) for k, v in CREDIT.items()], F.lit(1.0))
    return F.when((term != "") & (definition != ""), of).otherwise(0.0)


def glossary_summary(glossary: DataFrame) -> DataFrame:
    """(status_class, terms)."""
    return terms(glossary).groupBy("status_class").agg(F.count("*").alias("terms"))


def table_nodes(columns: DataFrame) -> DataFrame:
    """One row a table: record flag, lifecycle, majority owner and steward, counts of columns and measures.

    columns: typed catalog columns; of differing values the first by column name stands.
    """
    measure = G.is_measure_like(F.col("column"), F.col("data_type"), F.col("primary_key"), F.col("foreign_key"))
    sunset = F.col("lifecycle_status") == "sunset"
    some = lambda c: F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(sunset & (F.col(c) != ""), F.col("column")))
    out = columns.groupBy("table_fqn").agg(
        F.min("system").alias("system"),
        F.min("table").alias("table_name"),
        F.bool_or("system_of_record").alias("sor_flag"),
        F.when(F.bool_or(sunset), "sunset").otherwise("active").alias("lifecycle_status"),
        F.coalesce(some("sunset_date"), F.lit("")).alias("sunset_date"),
        F.coalesce(some("successor_system"), F.lit("")).alias("successor_system"),
        F.min_by("data_domain", "column").alias("domain"),
        F.min_by("sub_domain", "column").alias("sub_domain"),
        F.min_by("row_count", "column").alias("row_count"),
        F.count("*").alias("column_count"),
        F.count_if(measure).alias("measure_count"),
        F.bool_or("primary_key").alias("has_key"),
        (F.count_distinct(F.when(F.col("data_owner") != "", F.col("data_owner"))) > 1).alias("owner_disagreement"),
        (F.count_distinct(F.when(F.col("data_steward") != "", F.col("data_steward"))) > 1).alias("steward_disagreement"),
    )
    for role, c in (("owner", "data_owner"), ("steward", "data_steward")):
        out = out.join(majority(columns.where(F.col(c) != ""), ["table_fqn"], c, role).drop("votes"), "table_fqn", "left")
    return out.na.fill("", ["owner", "steward"])


def systems(columns: DataFrame) -> DataFrame:
    """(system, lifecycle, successor): a system with any column in sunset is in sunset."""
    sunset = F.col("lifecycle_status") == "sunset"
    return columns.groupBy("system").agg(F.when(F.bool_or(sunset), "sunset").otherwise("active").alias("lifecycle"), F.coalesce(F.max(F.when(sunset, F.col("successor_system"))), F.lit("")).alias("successor"))


def domain_nodes(columns: DataFrame) -> DataFrame:
    """One row a domain: tables, columns, majority owner and steward by the catalog's own values, disagreement."""
    d = columns.where("data_domain <> ''").withColumnRenamed("data_domain", "domain")
    out = d.groupBy("domain").agg(
        F.count_distinct("table_fqn").alias("tables"),
        F.count("*").alias("columns"),
        (F.count_distinct(F.when(F.col("data_owner") != "", F.col("data_owner"))) > 1).alias("owner_disagreement"),
        (F.count_distinct(F.when(F.col("data_steward") != "", F.col("data_steward"))) > 1).alias("steward_disagreement"),
    )
    for role, c in (("owner", "data_owner"), ("steward", "data_steward")):
        out = out.join(majority(d.where(F.col(c) != ""), ["domain"], c, role).drop("votes"), "domain", "left")
    return out.na.fill("", ["owner", "steward"])


def raw_reference(*parts: str) -> Column:
    """Dotted name without its empty parts."""
    return F.concat_ws(".", *[F.nullif(F.coalesce(F.col(f"`{p}`"), F.lit("")), F.lit("")) for p in parts])


def role_of(explicit: Column, column: Column, filter_text: Column, expression: Column, parsed_filters: Column) -> Column:
    """operand or filter: as told, else filter if only the filter's text names the column, or the parsed filters do."""
    n = S.normalize_identifier
    told, c = F.lower(F.trim(explicit)), n(column)
    only = (c != "") & n(filter_text).contains(c) & ~n(expression).contains(c)
    inside = F.exists(F.coalesce(parsed_filters, F.array().cast("array<string>")), lambda f: F.element_at(F.split(f, r"\."), -1) == c)
    return F.when(told.isin("operand", "filter"), told).when(only | ((c != "") & inside), "filter").otherwise("operand")


#: What a metric's rows say of it besides what they refer to.
FORM = ("kpi_label", "tool", "aggregation_type", "calculation_expression", "filter_expression", "semantic_container", "measure_scope")


def kpi_forms(kpis: DataFrame) -> DataFrame:
    """(form, FORM, parsed): each distinct way to state a metric, keyed by its hash; a calculation is parsed once for each text."""
    forms = kpis.select(*FORM).distinct()
    return forms.join(parse_distinct(kpis, "calculation_expression", "aggregation_type"), ["calculation_expression", "aggregation_type"]).select(F.xxhash64(*FORM).alias("form"), *FORM, "parsed")


def kpi_rows(bundle: Bundle, forms: DataFrame, manual: DataFrame | None = None, keep=lambda df: df) -> DataFrame:
    """Every lineage row with its form and role, what it resolved to, and why not.

    A reference is resolved once for each distinct spelling, and no row carries more than the keys of what it says.
    """
    refs = bundle.kpis.select(*R.REF).distinct()
    found = R.extend_upstream(R.resolve(refs, bundle.columns, bundle.lineage, manual, keep), bundle.columns, bundle.lineage)
    found = keep(found.select(F.xxhash64(*R.REF).alias("ref"), "column_fqn", "er_rule", "confidence", "reason", "nearest"))
    k = bundle.kpis.select("kpi_id", "report_id", "column_role", "column", raw_reference("source_system", "database", "schema", "table", "column").alias("raw_reference"), F.xxhash64(*FORM).alias("form"), F.xxhash64(*R.REF).alias("ref"))
    k = k.join(forms.select("form", "filter_expression", "calculation_expression", F.col("parsed.filter_columns").alias("parsed_filters")), "form")
    role = role_of(F.col("column_role"), F.col("column"), F.col("filter_expression"), F.col("calculation_expression"), F.col("parsed_filters"))
    return k.select("kpi_id", "report_id", "raw_reference", "form", "ref", role.alias("role")).join(found, "ref", "left").drop("ref")


def edges_of(rows: DataFrame) -> DataFrame:
    """(kpi_id, column_fqn, role, er_rule, confidence, raw_reference): one edge a metric, column and role."""
    e = rows.where("column_fqn is not null")
    return e.groupBy("kpi_id", "column_fqn", "role").agg(F.min(F.struct("raw_reference", "er_rule", "confidence")).alias("e")).select("kpi_id", "column_fqn", "role", "e.er_rule", "e.confidence", "e.raw_reference")


def quarantine_of(rows: DataFrame) -> DataFrame:
    return rows.where("column_fqn is null").select("kpi_id", "report_id", "raw_reference", "role", "reason", "nearest")


def table_of(column_fqn: Column) -> Column:
    return F.regexp_extract(column_fqn, r"^(.*)\.[^.]*$", 1)


def kpi_nodes(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(kpi_id, report_ids, calc, form): one node a metric row group; calc is the hash of its form and its set of edges.

    The head is the first row by reference.
    """
    head = rows.groupBy("kpi_id").agg(F.min(F.struct("raw_reference", "report_id", "form")).alias("h"), F.array_sort(F.collect_set("report_id")).alias("report_ids"))
    sets = edges.groupBy("kpi_id").agg(F.bit_xor(F.xxhash64("column_fqn", "role", "raw_reference")).alias("edge_set"))  # edges of a metric differ in column or role
    out = head.join(sets, "kpi_id", "left")
    return out.select("kpi_id", F.filter("report_ids", lambda r: r != "").alias("report_ids"), F.xxhash64("h.form", F.coalesce("edge_set", F.lit(0))).alias("calc"), F.col("h.form").alias("form"))


def calculations(nodes: DataFrame, edges: DataFrame, forms: DataFrame, tables: DataFrame, chain: list[str], keep=lambda df: df) -> DataFrame:
    """One row a calc with its first metric and their number: head values, parse result, operand and filter columns, grain.

    The grain is the finest of its fact tables, else of its other tables; load steps never count. tables: (table_fqn,
    measure_count, grain). What edges say is worked out on those of the first metric, as all of a calc have the same.
    """
    one = keep(nodes.groupBy("calc", "form").agg(F.min("kpi_id").alias("kpi_id"), F.count("*").alias("n")))
    e = keep(edges.join(one.select("kpi_id", "calc"), "kpi_id"))
    cols = e.groupBy("calc").agg(F.array_sort(F.collect_set(F.when(F.col("role") == "operand", F.col("column_fqn")))).alias("operand_columns"), F.array_sort(F.collect_set(F.when(F.col("role") == "filter", F.col("column_fqn")))).alias("filter_columns"))
    at = e.where("role = 'operand'").select("calc", table_of(F.col("column_fqn")).alias("table_fqn")).distinct().join(tables.select("table_fqn", "measure_count", "grain"), "table_fqn")
    at = at.where(~G.is_no_business(F.col("grain"))).withColumn("fact", F.col("measure_count") >= 2)
    level = at.groupBy("calc").agg(F.bool_or("fact").alias("any_fact"))
    at = at.join(level, "calc").where("fact or not any_fact")
    grains = G.finest(at, ["calc"], "grain", chain)
    none = F.array().cast("array<string>")
    out = one.join(forms, "form").join(cols, "calc", "left").join(grains, "calc", "left")
    return out.select(
        "calc",
        "kpi_id",
        "n",
        F.col("kpi_label").alias("label"),
        "tool",
        F.upper(F.coalesce(F.nullif(F.col("parsed.aggregation"), F.lit("")), F.col("aggregation_type"), F.lit(""))).alias("aggregation"),
        F.col("calculation_expression").alias("expression"),
        "filter_expression",
        "semantic_container",
        "measure_scope",
        "parsed",
        F.col("parsed.status").alias("parse_status"),
        F.col("parsed.time_modifier").alias("time_modifier"),
        F.coalesce("operand_columns", none).alias("operand_columns"),
        F.coalesce("filter_columns", none).alias("filter_columns"),
        F.coalesce("grain", F.lit("unknown")).alias("grain"),
    )


def build(bundle: Bundle, declared: tuple[str, ...] = (), manual: DataFrame | None = None, keep=lambda df: df) -> Graph:
    """The whole graph. keep: stores a table that is read several times (such as a write to the shared folder)."""
    names = ("reports", "kpis", "columns", "lineage", "glossary")
    bundle = replace(bundle, **dict(zip(names, together(keep, *[getattr(bundle, n) for n in names]), strict=True)))
    reports = first_by(bundle.reports, "report_id", "report_name")
    columns, tables, forms = together(keep, link_terms(bundle.columns, bundle.glossary), table_nodes(bundle.columns), kpi_forms(bundle.kpis))
    chain, source = G.backbone(columns, tables, declared)
    tables = keep(tables.join(G.table_grains(columns, tables, chain), "table_fqn").withColumnRenamed("source", "grain_source"))
    rows = keep(kpi_rows(bundle, forms, manual, keep))
    edges = keep(edges_of(rows))
    nodes = keep(kpi_nodes(rows, edges))
    calcs = keep(calculations(nodes, edges, forms, tables, chain, keep))
    nodes = nodes.drop("form")
    kpis = nodes.join(calcs.drop("kpi_id", "n"), "calc").drop("calc")
    pairs = rows.where("report_id <> ''").select("kpi_id", "report_id").distinct()
    return Graph(reports, columns, tables, domain_nodes(bundle.columns), bundle.glossary, kpis, edges, quarantine_of(rows), pairs, chain, source, nodes, calcs, rows.select("kpi_id", "confidence"))


def stats(g: Graph, rows: DataFrame) -> DataFrame:
    """One row: rates of resolution (confidence >= 0.8) and of parsing, and counts."""
    r = rows.agg(F.count("*").alias("kpi_rows"), F.count("column_fqn").alias("resolved_rows"), F.count_if(F.col("confidence") >= R.PROBABLE).alias("confident_rows"), F.count_if(F.col("column_fqn").isNull()).alias("quarantined_rows"))
    k = g.kpis.agg(F.count("*").alias("kpis"), F.count_if(F.col("parse_status") == "PARSED").alias("parsed_kpis"))
    t = g.tables.agg(F.count("*").alias("tables"), F.count_if(G.is_no_business(F.col("grain"))).alias("load_tables"), F.count_if("steward_disagreement").alias("disputed_tables"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return r.crossJoin(k).crossJoin(t).withColumn("resolution_rate", rate("confident_rows", "kpi_rows")).withColumn("parse_rate", rate("parsed_kpis", "kpis"))  # one row each


def lineage_events(g: Graph, run_id: str, as_of: str) -> DataFrame:
    """(kpi_id, event): a COMPLETE event of the open lineage format for each metric, as JSON."""
    inputs = g.edges.select("kpi_id", F.struct(F.lit("catalog").alias("namespace"), F.col("column_fqn").alias("name"), F.lit(True).alias("resolved")).alias("i"))
    lost = g.quarantine.select("kpi_id", F.struct(F.lit("unresolved").alias("namespace"), F.col("raw_reference").alias("name"), F.lit(False).alias("resolved")).alias("i"))
    ins = inputs.union(lost).groupBy("kpi_id").agg(F.array_sort(F.collect_set("i")).alias("inputs"))
    outs = g.kpi_reports.groupBy("kpi_id").agg(F.array_sort(F.collect_set(F.struct(F.lit("reports").alias("namespace"), F.col("report_id").alias("name")))).alias("outputs"))
    event = F.struct(F.lit("COMPLETE").alias("eventType"), F.lit(as_of).alias("eventTime"), F.struct(F.lit(run_id).alias("runId")).alias("run"), F.struct(F.lit("metrics").alias("namespace"), F.col("kpi_id").alias("name")).alias("job"), "inputs", "outputs")
    return g.kpis.select("kpi_id").join(ins, "kpi_id", "left").join(outs, "kpi_id", "left").select("kpi_id", F.to_json(event).alias("event"))


def merge_starter_glossary(glossary: DataFrame, starter: DataFrame) -> DataFrame:
    """glossary and the starter's terms that it lacks, whatever their case."""
    have = glossary.select(F.lower(F.trim("term")).alias("t")).distinct()
    return glossary.unionByName(starter.withColumn("t", F.lower(F.trim("term"))).join(have, "t", "left_anti").select(*glossary.columns))


def duplicate_reports(reports: DataFrame) -> DataFrame:
    """One row: how many report rows repeat an earlier id."""
    return reports.agg((F.count("*") - F.count_distinct("report_id")).alias("duplicate_rows"))
