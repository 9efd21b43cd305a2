"""Canonical metrics: fingerprints of resolved calculations, groups with variants, stewards, cousins and conflicts."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrigraph.estate.graph import Graph, table_of, terms
from metrigraph.functions import scalars as S
from metrigraph.functions.similarity import blend, token_vector
from metrigraph.operators import demand
from metrigraph.operators.relational import majority, modal_first_seen
from metrigraph.operators.resolve import PROBABLE
from metrigraph.storage import together

# Words of time columns, conflict patterns with what they mean and ask of the model, stewards' confidence.
TIME_WORDS = ("date", "time", "period", "month", "year", "day", "week", "quarter", "fiscal", "calendar", "timestamp")
PATTERNS = {
    "THRESHOLD": ("Hard-coded threshold differs between reports", "Parameterized threshold in the semantic model"),
    "EXCLUSION": ("One definition excludes rows the other keeps", "Filter dimension so both readings exist under one metric"),
    "TIME_BASIS": ("Different time basis (calendar versus fiscal)", "Explicit time grain on the metric"),
    "DENOMINATOR": ("Same label, different denominator", "Explicit grain declaration and one certified denominator"),
    "NULL_HANDLING": ("Null handling differs and silently changes the result", "Documented null rule on the metric"),
    "AGGREGATION": ("Same measure, different aggregation", "Separate certified metrics, cross-linked"),
    "OPERANDS": ("Different source columns behind the same label", "Steward picks the authoritative definition or renames one"),
}
NULL_FUNCTIONS = "coalesce|ifnull|nvl|isnull|nullif|blank|isblank"
STEWARD_CONFIDENCE = {"glossary term": 0.95, "column term": 0.85, "fact table": 0.75, "table": 0.70, "domain": 0.60, "report owner": 0.30, "unassigned": 0.0}
AGGREGATION_PHRASE = {"SUM": "the total of", "AVG": "the average of", "COUNT": "the count of", "COUNT DISTINCT": "the distinct count of", "MAX": "the maximum of", "MIN": "the minimum of", "RATIO": "the ratio of"}
SIMILAR = 0.90
_STRINGS = "array<string>"


@dataclass(frozen=True)
class Links:
    """Conflicts without their pairs: classes (metric_id, class) of metrics of equal labels, links (a, b) of classes all
    of whose metrics pair, a <= b, and single pairs (a, b, n) that come on top (1) or are induced by lineage (-1)."""

    classes: DataFrame
    links: DataFrame
    singles: DataFrame


@dataclass(frozen=True)
class Metrics:
    """metrics (one row each), members (kpi_id, metric_id, tier, ...), confident metrics, glossary.

    The pairs that conflict and those that lineage induced are made when first asked for: metrics of one label all pair,
    so pairs grow with the square of a label's metrics. Counts come from `links`, which doesn't make them.
    """

    metrics: DataFrame
    members: DataFrame
    sure: DataFrame
    glossary: DataFrame
    keep: Callable[[DataFrame], DataFrame] = lambda df: df

    @cached_property
    def _found(self) -> tuple[DataFrame, DataFrame]:
        return conflicts(self.metrics, self.sure, self.glossary, self.keep)

    @cached_property
    def conflicts(self) -> DataFrame:
        return self.keep(self._found[0])

    @cached_property
    def induced(self) -> DataFrame:
        return self.keep(self._found[1])

    @cached_property
    def links(self) -> Links:
        return label_links(self.metrics, self.sure, self.glossary, self.keep)

    def heaviest(self, n: int, label: str = "") -> DataFrame:
        """Conflicts, among them the first n by usage of both sides, then by id, of those whose label holds a text."""
        return heaviest_conflicts(self.metrics, self.sure, self.glossary, n, label, self.keep)


def leaf(fqn: Column) -> Column:
    return F.lower(F.element_at(F.split(fqn, r"\."), -1))


def resolved_shape(kpis: DataFrame, edges: DataFrame) -> DataFrame:
    """(kpi_id, resolved): the shape with each reference named by the column it resolved to.

    A reference table.column means the edge of that table and column, else the only edge with that column; otherwise
    it keeps its own name, so that two references never become one.
    """
    refs = kpis.select("kpi_id", F.explode(F.array_distinct(F.regexp_extract_all("parsed.shape", F.lit(r"ref\(([^()]*)\)")))).alias("ref"))
    own = refs.select("kpi_id", "ref", F.when(F.size(F.split("ref", r"\.")) > 1, F.element_at(F.split("ref", r"\."), -2)).otherwise("").alias("t"), leaf(F.col("ref")).alias("c"))
    parts = F.split("column_fqn", r"\.")
    e = edges.select("kpi_id", "column_fqn", F.lower(F.element_at(parts, -2)).alias("t"), leaf(F.col("column_fqn")).alias("c"))
    raw = edges.select("kpi_id", "column_fqn", F.when(F.size(F.split("raw_reference", r"\.")) > 1, F.lower(F.element_at(F.split("raw_reference", r"\."), -2))).alias("t"), leaf(F.col("raw_reference")).alias("c"))
    pair = e.union(raw.where("t is not null")).groupBy("kpi_id", "t", "c").agg(F.min("column_fqn").alias("by_pair"))
    alone = e.groupBy("kpi_id", "c").agg(F.count_distinct("column_fqn").alias("n"), F.min("column_fqn").alias("by_leaf")).where("n = 1")
    named = own.join(pair, ["kpi_id", "t", "c"], "left").join(alone, ["kpi_id", "c"], "left").select("kpi_id", "ref", F.coalesce("by_pair", "by_leaf", "ref").alias("name"))
    names = named.groupBy("kpi_id").agg(F.map_from_entries(F.collect_list(F.struct("ref", "name"))).alias("names"))
    out = kpis.select("kpi_id", F.col("parsed.shape").alias("shape")).join(names, "kpi_id", "left")
    # Between the references of a shape stand other characters: split and extract alternate.
    pieces, found = F.split("shape", r"ref\([^()]*\)", -1), F.regexp_extract_all("shape", F.lit(r"ref\(([^()]*)\)"))
    put = F.transform(found, lambda r: F.concat(F.lit("ref("), F.coalesce(F.element_at("names", r), r), F.lit(")")))
    return out.select("kpi_id", F.array_join(F.zip_with(pieces, put, lambda p, r: F.concat(F.coalesce(p, F.lit("")), F.coalesce(r, F.lit("")))), "").alias("resolved"))


def fingerprints(kpis: DataFrame, edges: DataFrame) -> DataFrame:
    """kpis with fingerprint (aggregation, operands, shape), filter_fp (filters, time and null rules) and raw_shape.

    kpis: the graph's calculations, whose first metric's edges are those of all.
    A calculation that doesn't parse is keyed on its text and operands, apart from all that do.
    """
    k = kpis.join(resolved_shape(kpis, edges), "kpi_id", "left")
    parsed = F.col("parse_status") == "PARSED"
    operands = F.when(F.size("operand_columns") > 0, F.col("operand_columns")).otherwise(F.col("parsed.operands"))
    text = normalized_text(F.col("expression"))
    meaning = F.concat_ws("|", F.col("aggregation"), F.array_join(F.array_sort(operands), ";"), F.coalesce("resolved", F.lit("")))
    opaque = F.concat(F.lit("opaque:"), text, F.lit("|"), F.array_join("operand_columns", "|"))
    declared = F.when(F.trim("filter_expression") != "", F.concat(F.lit("declared:"), normalized_text(F.col("filter_expression"))))
    filters = F.concat_ws("&", F.array_sort(F.array_compact(F.array(F.nullif(F.col("parsed.filter_key"), F.lit("none")), declared))))
    return k.select(
        *kpis.columns,
        F.sha2(F.when(parsed, meaning).otherwise(opaque), 256).alias("fingerprint"),
        F.sha2(F.when(filters == "", "none").otherwise(filters), 256).alias("filter_fp"),
        F.when(parsed, F.coalesce("resolved", F.lit(""))).otherwise("").alias("shape"),
        F.when(parsed, F.concat_ws("|", "aggregation", "parsed.shape")).otherwise("").alias("raw_shape"),
        F.when(parsed, F.col("parsed.null_rule")).otherwise("").alias("null_rule"),
        text.alias("text"),
    )


def normalized_text(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))


def variant_label(filter_text: Column, time: Column, null_rule: Column) -> Column:
    """What sets a variant apart: its filter, time modifier or null rule; base if nothing."""
    return (
        F.when(filter_text != "", F.concat(F.lit("filtered: "), F.substring(filter_text, 1, 90)))
        .when(time != "", F.concat(F.lit("time modifier: "), time))
        .when(null_rule != "", F.concat(F.lit("null rule: "), F.substring(null_rule, 1, 80)))
        .otherwise("base")
    )


def members(printed: DataFrame) -> DataFrame:
    """(calc, metric_id, fingerprint, filter_fp, tier, variant_label): IDENTICAL with the metric's commonest filter, else VARIANT."""
    dominant = modal_first_seen(printed, ["fingerprint"], "filter_fp", "kpi_id", "dominant", "n").drop("votes")
    tier = F.when(F.col("parse_status") != "PARSED", "OPAQUE").when(F.col("filter_fp") == F.col("dominant"), "IDENTICAL").otherwise("VARIANT")
    label = variant_label(F.col("filter_expression"), F.col("time_modifier"), F.col("null_rule"))
    return printed.join(dominant, "fingerprint").select("calc", S.stable_id("MET", F.col("fingerprint")).alias("metric_id"), "fingerprint", "filter_fp", tier.alias("tier"), label.alias("variant_label"))


def _modes(df: DataFrame, value: str, out: str) -> DataFrame:
    return modal_first_seen(df.where(F.coalesce(F.col(value), F.lit("")) != ""), ["metric_id"], value, "kpi_id", out, "n").drop("votes")


def report_weights(reports: DataFrame, as_of: Column, half_life: float = 6.0) -> DataFrame:
    """(report_id, weight, ...): demand of each report, with all its terms.

    Runs of several tools are matched by quantiles; a scheduled report's half-life is at least twice its cadence.
    """
    tools = reports.select(F.coalesce(F.nullif(F.col("tool"), F.lit("")), F.lit("cognos")).alias("tool"), "report_id", F.col("run_count_12m").alias("runs"), F.col("distinct_users_12m").alias("users"), "last_run_date", "schedule_flag", "schedule_frequency", "decision_critical")
    p = demand.quantile_parity(demand.within_percentile(tools, "tool", "runs", "report_id"), "percentile", "runs", "report_id")
    several = tools.agg((F.count_distinct("tool") > 1).alias("several"))
    p = p.crossJoin(F.broadcast(several)).withColumn("adjusted", F.when(F.col("several"), F.col("parity_runs")).otherwise(F.greatest(F.col("runs"), F.lit(0))))  # one row
    half = half_life_for(F.col("schedule_flag"), F.col("schedule_frequency"), half_life)
    w = demand.usage_weight(F.col("adjusted"), F.col("users"), F.col("last_run_date"), as_of, F.col("decision_critical"), half)
    return p.select("report_id", "tool", "runs", "users", "percentile", "adjusted", half.alias("half_life"), S.recency_decay(F.col("last_run_date"), as_of, half).alias("decay"), w.alias("weight"))


def half_life_for(scheduled: Column, frequency: Column, configured: float = 6.0) -> Column:
    """Months: at least twice the cadence of a scheduled report."""
    return F.greatest(F.lit(float(configured)), 2.0 * F.when(scheduled, S.cadence_months(frequency)).otherwise(1))


def build_metrics(g: Graph, printed: DataFrame, weights: DataFrame) -> DataFrame:
    """One row a metric: labels, columns, tables, reports, modes, usage, steward.

    Everything is aggregated from rows (metric, calculation), (metric, column) and (metric, report); no member list is walked.
    """
    m = printed.withColumn("metric_id", S.stable_id("MET", F.col("fingerprint")))
    base = m.groupBy("metric_id", "fingerprint").agg(
        F.sum("n").alias("kpi_count"),
        (F.count_distinct("filter_fp") - 1).alias("variant_count"),
        F.bool_and(F.col("parse_status") != "PARSED").alias("opaque"),
        F.array_sort(F.collect_set("tool")).alias("tools"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("operand_columns")))).alias("operand_columns"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("filter_columns")))).alias("filter_columns"),
        F.array_sort(F.collect_set(F.nullif(F.col("time_modifier"), F.lit("")))).alias("time_modifiers"),
        F.array_sort(F.collect_set(F.nullif(F.col("raw_shape"), F.lit("")))).alias("raw_shapes"),
        F.array_sort(F.collect_set(F.nullif(F.col("null_rule"), F.lit("")))).alias("null_rules"),
        F.array_sort(F.collect_set("text")).alias("texts"),
        F.min_by("shape", "kpi_id").alias("shape"),
        F.min_by("expression", "kpi_id").alias("sample_expression"),
    )
    labels = m.where("label <> ''").groupBy("metric_id", "label").agg(F.sum("n").alias("n"), F.min("kpi_id").alias("first"))
    labels = labels.groupBy("metric_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", "label"))), lambda x: x["label"]).alias("labels"))
    reports = g.nodes.select("calc", F.explode("report_ids").alias("report_id")).join(m.select("calc", "metric_id"), "calc").select("metric_id", "report_id").distinct()
    r = reports.join(g.reports.select("report_id", F.nullif(F.col("business_unit"), F.lit("")).alias("bu")), "report_id", "left").join(weights.select("report_id", "weight"), "report_id", "left")
    r = r.groupBy("metric_id").agg(F.count("*").alias("report_count"), F.count_distinct("bu").alias("consumer_breadth"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("usage_weight"), F.array_sort(F.collect_set("report_id")).alias("report_ids"))
    cols = m.select("metric_id", F.explode("operand_columns").alias("column_fqn")).distinct()
    owned = cols.join(g.columns.select("column_fqn", F.col("data_domain").alias("domain"), "sub_domain"), "column_fqn")
    first = lambda c: modal_first_seen(owned.where(F.col(c) != ""), ["metric_id"], c, "column_fqn", c).drop("votes")
    out = base.join(labels, "metric_id", "left").join(r, "metric_id", "left").join(first("domain"), "metric_id", "left").join(first("sub_domain"), "metric_id", "left")
    for value in ("aggregation", "grain"):
        out = out.join(_modes(m, value, value), "metric_id", "left")
    out = out.na.fill("", ["domain", "sub_domain", "aggregation"]).na.fill("unknown", ["grain"]).na.fill(0, ["report_count", "consumer_breadth"]).na.fill(0.0, ["usage_weight"])
    out = out.withColumn("labels", F.coalesce("labels", F.array().cast(_STRINGS))).withColumn("report_ids", F.coalesce("report_ids", F.array().cast(_STRINGS)))
    out = out.withColumn("source_tables", F.array_sort(F.array_distinct(F.transform("operand_columns", table_of))))
    out = out.join(stewards(out.select("metric_id", "operand_columns", "report_ids", "domain"), g), "metric_id", "left")
    return propose_names(out).withColumn("definition", propose_definition())


def propose_names(metrics: DataFrame) -> DataFrame:
    """canonical_name: the commonest label in snake case; of metrics of one name the largest has it, the next add their
    grain, and those that still clash a number, in order of size and fingerprint."""
    label = F.coalesce(F.get("labels", 0), F.lit("unnamed metric"))
    size = [F.desc("kpi_count"), "fingerprint"]
    base = metrics.withColumn("_base", S.snake_case(label))
    base = base.withColumn("_at", F.row_number().over(Window.partitionBy("_base").orderBy(*size)))  # metrics of one name
    grained = F.when((F.col("_at") > 1) & (F.col("grain") != "unknown"), F.concat("_base", F.lit("_by_"), S.snake_case(F.col("grain")))).otherwise(F.col("_base"))
    base = base.withColumn("_name", grained)
    again = F.row_number().over(Window.partitionBy("_name").orderBy(F.col("_at") > 1, *size))
    name = F.when(again == 1, F.col("_name")).otherwise(F.concat("_base", F.lit("_"), F.when(F.col("_name") == F.col("_base"), F.lit("")).otherwise(F.concat(S.snake_case(F.col("grain")), F.lit("_"))), again.cast("string")))
    return base.withColumn("canonical_name", name).drop("_base", "_at", "_name")


def propose_definition() -> Column:
    """A draft sentence from label, aggregation, columns and grain."""
    label = S.title_case(F.coalesce(F.get("labels", 0), F.lit("unnamed metric")))
    phrase = F.coalesce(*[F.when(F.col("aggregation") == k, F.lit(v)) for k, v in AGGREGATION_PHRASE.items()], F.concat(F.lit("the "), F.coalesce(F.nullif(F.lower("aggregation"), F.lit("")), F.lit("aggregate")), F.lit(" of")))
    columns = F.array_join(F.transform(F.slice("operand_columns", 1, 3), leaf), ", ")
    source = F.when(columns == "", "its source columns").otherwise(columns)
    count = F.col("kpi_count").cast("string")
    read = F.concat(label, F.lit(" is "), phrase, F.lit(" "), source, F.lit(", evaluated at "), F.col("grain"), F.lit(" grain across "), count, F.lit(" report calculation(s)."))
    unread = F.concat(label, F.lit(" as computed by "), count, F.lit(" report calculation(s) the parser could not read; a steward must write this definition by hand."))
    return F.when(F.col("opaque"), unread).otherwise(read)


def stewards(m: DataFrame, g: Graph) -> DataFrame:
    """(metric_id, steward, steward_rule, steward_confidence, escalate_to): the first source that names one.

    In order: glossary term and column term of the operand columns, fact tables, tables (both by measures, then name),
    the domain, and as a mere suggestion the commonest owner of the reports.
    """
    cols = m.select("metric_id", F.explode("operand_columns").alias("column_fqn")).withColumn("table_fqn", table_of(F.col("column_fqn")))
    t = g.tables.select("table_fqn", "measure_count", F.col("steward").alias("t_steward"))
    c = g.columns.select("column_fqn", "glossary_steward", "business_term", F.col("steward").alias("c_steward"))
    rows = cols.join(t, "table_fqn", "left").join(c, "column_fqn", "left")
    order = F.struct((-F.coalesce("measure_count", F.lit(0))).alias("m"), "column_fqn")
    some = lambda value, holds: F.min(F.when(holds & (F.coalesce(F.col(value), F.lit("")) != ""), F.struct(order.alias("o"), F.col(value).alias("v"))))["v"]
    by = rows.groupBy("metric_id").agg(
        some("glossary_steward", F.lit(True)).alias("glossary term"),
        some("c_steward", F.coalesce(F.col("business_term"), F.lit("")) != "").alias("column term"),
        some("t_steward", F.coalesce("measure_count", F.lit(0)) >= 2).alias("fact table"),
        some("t_steward", F.lit(True)).alias("table"),
    )
    d = g.domains.select("domain", F.nullif(F.col("steward"), F.lit("")).alias("domain_steward"), F.col("owner").alias("domain_owner"))
    owners = m.select("metric_id", F.explode("report_ids").alias("report_id")).join(g.reports.select("report_id", "owner"), "report_id").where("owner <> ''")
    owner = majority(owners, ["metric_id"], "owner", "report owner").drop("votes")
    out = m.select("metric_id", "domain").join(by, "metric_id", "left").join(d, "domain", "left").withColumnRenamed("domain_steward", "domain_").join(owner, "metric_id", "left")
    steps = [(k, F.col(f"`{'domain_' if k == 'domain' else k}`")) for k in STEWARD_CONFIDENCE if k != "unassigned"]
    found = F.coalesce(*[F.when(v.isNotNull(), F.struct(v.alias("s"), F.lit(k).alias("r"), F.lit(STEWARD_CONFIDENCE[k]).alias("c"))) for k, v in steps], F.struct(F.lit("").alias("s"), F.lit("unassigned").alias("r"), F.lit(0.0).alias("c")))
    out = out.select("metric_id", found.alias("f"), F.coalesce("domain_owner", F.lit("")).alias("domain_owner"))
    return out.select("metric_id", F.col("f.s").alias("steward"), F.col("f.r").alias("steward_rule"), F.col("f.c").alias("steward_confidence"), F.when(F.col("f.r").isin("report owner", "unassigned"), F.col("domain_owner")).otherwise("").alias("escalate_to"))


def steward_state(rule: Column, steward: Column) -> Column:
    """confirmed by the catalog, suggested from elsewhere, or unassigned."""
    return F.when(F.coalesce(steward, F.lit("")) == "", "unassigned").when(rule.isin("glossary term", "column term"), "confirmed").otherwise("suggested")


def cousins(metrics: DataFrame) -> DataFrame:
    """(a, b): metrics over the same operand columns whose aggregation differs; each pair once."""
    m = metrics.where(F.size("operand_columns") > 0).select("metric_id", "aggregation", F.sha2(F.array_join("operand_columns", ";"), 256).alias("k"))
    x, y = m.select("k", F.col("metric_id").alias("a"), F.col("aggregation").alias("xa")), m.select("k", F.col("metric_id").alias("b"), F.col("aggregation").alias("ya"))
    return x.join(y, "k").where("a < b and xa <> ya").select("a", "b")


def confident(members_: DataFrame, edges: DataFrame) -> DataFrame:
    """(metric_id) of metrics with a member all of whose operand edges are at least probable."""
    low = edges.where("role = 'operand'").groupBy("kpi_id").agg(F.min("confidence").alias("low")).where(F.col("low") >= PROBABLE)
    return members_.join(low, "kpi_id", "left_semi").select("metric_id").distinct()


def leaf_operands(raw_shapes: Column, operands: Column) -> Column:
    """Operand leaves as the reports wrote them, else those of the resolved columns."""
    written = F.array_distinct(F.flatten(F.transform(raw_shapes, lambda s: F.transform(F.regexp_extract_all(s, F.lit(r"ref\(([^()]+)\)")), leaf))))
    return F.array_sort(F.when(F.size(written) > 0, written).otherwise(F.array_distinct(F.transform(operands, leaf))))


def literals(shape: Column) -> Column:
    return F.array_sort(F.regexp_extract_all(shape, F.lit(r"lit\(([^)]*)\)")))


def is_time_column(c: Column) -> Column:
    return F.arrays_overlap(S.tokens(leaf(c)), F.array(*map(F.lit, TIME_WORDS)))


def classify_pattern(a: str = "a", b: str = "b") -> Column:
    """The first pattern that explains how metrics a and b (structs with leaves, filter_columns, aggregation, shape,
    null_rules) differ."""
    x, y = F.col(a), F.col(b)
    same = x["leaves"] == y["leaves"]
    extra = F.array_union(F.array_except(x["leaves"], y["leaves"]), F.array_except(y["leaves"], x["leaves"]))
    shaped = (x["shape"] != "") & (y["shape"] != "") & (x["shape"] != y["shape"])
    unlike = literals(x["shape"]) != literals(y["shape"])
    nulls = F.lower(F.concat(x["shape"], y["shape"])).rlike(NULL_FUNCTIONS)
    ratio = (x["aggregation"] == "RATIO") | (y["aggregation"] == "RATIO")
    return (
        F.when(same & (x["aggregation"] != y["aggregation"]), "AGGREGATION")
        .when(same & shaped & unlike, "THRESHOLD")
        .when(same & shaped & nulls, "NULL_HANDLING")
        .when(same & (x["shape"] == y["shape"]) & (x["null_rules"] != y["null_rules"]), "NULL_HANDLING")
        .when((F.size(extra) > 0) & F.forall(extra, is_time_column), "TIME_BASIS")
        .when(ratio & (F.size(x["leaves"]) == F.size(y["leaves"])) & (F.size(extra) <= 2), "DENOMINATOR")
        .when(same & (x["filter_columns"] != y["filter_columns"]), "EXCLUSION")
        .when((F.size(extra) > 0) & unlike, "THRESHOLD")
        .otherwise("OPERANDS")
    )


def short_names(columns: Column, other: Column) -> Column:
    """Leaves of columns, with their table where the other side has the same leaf."""
    others = F.transform(other, leaf)
    return F.array_sort(F.transform(columns, lambda c: F.when(F.array_contains(others, leaf(c)) & (F.size(F.split(c, r"\.")) > 1), F.concat_ws(".", F.element_at(F.split(c, r"\."), -2), F.element_at(F.split(c, r"\."), -1))).otherwise(F.element_at(F.split(c, r"\."), -1))))


def describe_difference(pattern: Column, a: str = "a", b: str = "b") -> Column:
    """A sentence on how two metrics differ, by their pattern."""
    x, y = F.col(a), F.col(b)
    said = lambda v: F.when(F.size(v) > 0, F.array_join(v, ", ")).otherwise("none")
    xa, ya = F.array_except(x["operand_columns"], y["operand_columns"]), F.array_except(y["operand_columns"], x["operand_columns"])
    only = lambda mine, theirs, own, other: F.when(F.size(mine) > 0, short_names(mine, theirs)).otherwise(F.array_except(own, other))
    left, right = only(xa, ya, x["leaves"], y["leaves"]), only(ya, xa, y["leaves"], x["leaves"])
    versus = lambda head, p, q: F.concat(F.lit(head), said(p), F.lit(" versus "), said(q))
    leaves = lambda v: F.array_sort(F.transform(v, leaf))
    return (
        F.when(pattern == "THRESHOLD", versus("Same columns, different threshold: ", literals(x["shape"]), literals(y["shape"])))
        .when(pattern == "AGGREGATION", F.concat(x["aggregation"], F.lit(" versus "), y["aggregation"], F.lit(" over the same column")))
        .when(pattern == "TIME_BASIS", versus("Time basis differs: ", left, right))
        .when(pattern == "DENOMINATOR", versus("Denominator differs: ", left, right))
        .when(pattern == "EXCLUSION", versus("Filters differ: ", leaves(x["filter_columns"]), leaves(y["filter_columns"])))
        .when(pattern == "NULL_HANDLING", versus("Null handling differs: ", x["null_rules"], y["null_rules"]))
        .when((F.size(left) > 0) | (F.size(right) > 0), versus("Different source columns: ", left, right))
        .otherwise("Different arithmetic over the same columns")
    )


def shared_blocks(metrics: DataFrame, sure: DataFrame, glossary: DataFrame) -> DataFrame:
    """(metric_id, block): label keys, glossary terms and operand columns of parsed, confident metrics."""
    m = metrics.where("not opaque").join(sure, "metric_id", "left_semi")
    own = m.select("metric_id", F.explode("labels").alias("label"))
    keyed = own.select("metric_id", F.concat(F.lit("label:"), S.label_key(F.col("label"))).alias("block")).where("block <> 'label:'")
    t = terms(glossary).select("term_key", "term_id")
    termed = own.withColumn("term_key", S.token_key(F.col("label"))).join(t, "term_key").select("metric_id", F.concat(F.lit("term:"), "term_id").alias("block"))
    columns = m.select("metric_id", F.explode("operand_columns").alias("c")).select("metric_id", F.concat(F.lit("column:"), "c").alias("block"))
    return keyed.union(termed).union(columns).distinct()


def candidate_pairs(metrics: DataFrame, sure: DataFrame, glossary: DataFrame) -> DataFrame:
    """(a, b, block): pairs of parsed, confident metrics that share a label key, a glossary term or an operand column.

    A block of very many metrics makes their pairs; each pair comes once, under its first block.
    """
    e = shared_blocks(metrics, sure, glossary)
    x, y = e.select("block", F.col("metric_id").alias("a")), e.select("block", F.col("metric_id").alias("b"))
    return x.join(y, "block").where("a < b").groupBy("a", "b").agg(F.min("block").alias("block"))


def similar_pairs(pairs: DataFrame, metrics: DataFrame, keep=lambda df: df) -> DataFrame:
    """(a, b, block, similarity) of pairs whose best label similarity reaches SIMILAR. Each pair of labels is compared once."""
    own = metrics.select("metric_id", "labels")
    p = pairs.join(own.select(F.col("metric_id").alias("a"), F.col("labels").alias("la")), "a").join(own.select(F.col("metric_id").alias("b"), F.col("labels").alias("lb")), "b")
    each = p.select("a", "b", F.explode("la").alias("x"), "lb").select("a", "b", "x", F.explode("lb").alias("y"))
    # Words, keys and vectors are worked out once a label, then each pair of labels is compared once.
    words = keep(own.select(F.explode("labels").alias("l")).distinct().withColumn("key", S.label_key(F.col("l"))).withColumn("words", S.tokens(F.col("l"))).withColumn("vector", token_vector(F.col("words"))))
    side = lambda n: words.select(*[F.col(c).alias(f"{c}_{n}") for c in words.columns])
    both = each.select("x", "y").distinct().join(side("x"), F.col("x") == F.col("l_x")).join(side("y"), F.col("y") == F.col("l_y"))
    alike = F.when(F.col("key_x") == F.col("key_y"), 1.0).otherwise(blend(F.col("vector_x"), F.col("vector_y"), F.col("words_x"), F.col("words_y")))
    labels = both.select("x", "y", alike.alias("s")).where(F.col("s") >= SIMILAR)
    best = each.join(labels, ["x", "y"]).groupBy("a", "b").agg(F.max("s").alias("similarity"))
    return pairs.join(best, ["a", "b"])


def alike_metrics(pairs: DataFrame, metrics: DataFrame, keep=lambda df: df) -> DataFrame:
    """(a_id, b_id, block, similarity, x, y, induced) of those of the candidate pairs whose labels are alike; x, y: the metrics.

    Pairs that wrote the same calculation and differ only by what references resolved to are lineage-induced.
    """
    pairs = similar_pairs(keep(pairs), metrics, keep)
    side = metrics.select("metric_id", F.struct("labels", "canonical_name", "aggregation", "shape", "operand_columns", "filter_columns", "raw_shapes", "texts", "null_rules", "usage_weight", "report_ids", "steward", "sample_expression", leaf_operands(F.col("raw_shapes"), F.col("operand_columns")).alias("leaves")).alias("m"))
    both = pairs.join(side.select(F.col("metric_id").alias("a_id"), F.col("m").alias("x")), F.col("a") == F.col("a_id")).join(side.select(F.col("metric_id").alias("b_id"), F.col("m").alias("y")), F.col("b") == F.col("b_id"))
    both = both.select("a_id", "b_id", "block", "similarity", "x", "y")
    induced = F.arrays_overlap("x.raw_shapes", "y.raw_shapes") | F.arrays_overlap("x.texts", "y.texts")
    return both.withColumn("induced", F.coalesce(induced, F.lit(False)))


def conflicts(metrics: DataFrame, sure: DataFrame, glossary: DataFrame, keep=lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(conflicts, lineage_induced): like labels, different calculations."""
    both = alike_metrics(candidate_pairs(metrics, sure, glossary), metrics, keep)
    label = F.coalesce(F.get("x.labels", 0), F.col("x.canonical_name"))
    lost = both.where("induced").select(F.col("a_id").alias("metric_id_a"), F.col("b_id").alias("metric_id_b"), label.alias("label"), "similarity", (F.col("x.usage_weight") + F.col("y.usage_weight")).alias("usage_at_stake"))
    return described(both), lost


def described(both: DataFrame) -> DataFrame:
    """Conflicts of alike metrics with their pattern, sides and what differs."""
    both = both.withColumn("pattern", classify_pattern("x", "y"))
    label = F.coalesce(F.get("x.labels", 0), F.col("x.canonical_name"))
    decision = F.coalesce(*[F.when(F.col("pattern") == k, F.lit(v[1])) for k, v in PATTERNS.items()])
    return both.where("not induced").select(
        S.stable_id("CONF", F.col("a_id"), F.col("b_id")).alias("conflict_id"),
        label.alias("label"),
        F.col("a_id").alias("metric_id_a"),
        F.col("b_id").alias("metric_id_b"),
        F.col("x.usage_weight").alias("usage_weight_a"),
        F.col("y.usage_weight").alias("usage_weight_b"),
        "pattern",
        describe_difference(F.col("pattern"), "x", "y").alias("difference_summary"),
        F.slice("x.report_ids", 1, 10).alias("reports_a"),
        F.slice("y.report_ids", 1, 10).alias("reports_b"),
        F.col("x.sample_expression").alias("expression_a"),
        F.col("y.sample_expression").alias("expression_b"),
        F.coalesce(F.nullif(F.col("x.steward"), F.lit("")), F.col("y.steward"), F.lit("")).alias("steward"),
        "similarity",
        decision.alias("semantic_model_decision"),
        F.lit("OPEN").alias("resolution_status"),
        F.split("block", ":")[0].alias("block"),
    )


def heaviest_conflicts(metrics: DataFrame, sure: DataFrame, glossary: DataFrame, n: int, label: str = "", keep=lambda df: df) -> DataFrame:
    """Conflicts, among them the first n by usage of both sides, then by id, of those whose label holds a text.

    Conflicts of the heaviest metrics of each block tell a usage that n conflicts reach; then only pairs that reach it are
    made, ties too. Where a block's metrics are of one usage, that is all of them.
    """
    holds = lambda c: F.contains(F.lower(c), F.lit(label.lower()))
    own = metrics.select("metric_id", F.col("usage_weight").alias("u"), holds(F.coalesce(F.get("labels", 0), F.col("canonical_name"))).alias("holds"))
    by = Window.partitionBy("block")
    e = shared_blocks(metrics, sure, glossary).join(own, "metric_id").withColumn("at", F.row_number().over(by.orderBy(F.desc("u"), "metric_id")))
    e = keep(e.withColumn("some", F.bool_or("holds").over(by)).withColumn("top", F.max("u").over(by)).where("some").drop("some"))

    def among(rows: DataFrame, reach=lambda u: F.lit(True)) -> DataFrame:
        """Alike metrics of pairs of the rows whose usage reaches."""
        x, y = (rows.where(reach(F.col("u") + F.col("top"))).select("block", F.col("metric_id").alias(k), F.col("u").alias(f"u{k}"), F.col("holds").alias(f"holds_{k}")) for k in "ab")
        pairs = x.join(y, "block").where(F.expr("a < b and holds_a") & reach(F.col("ua") + F.col("ub")))
        return alike_metrics(pairs.groupBy("a", "b").agg(F.min("block").alias("block")), metrics, keep)

    rank = 2 * math.isqrt(n) + 2
    while True:
        found = among(e.where(F.col("at") <= rank))
        first = found.where("not induced").select((F.col("x.usage_weight") + F.col("y.usage_weight")).alias("u")).orderBy(F.desc("u")).limit(n).agg(F.count("u").alias("n"), F.min("u").alias("u")).first()
        if first["n"] >= n:
            return described(among(e, lambda u: u >= F.lit(first["u"])))
        if not e.where(F.col("at") > rank).head(1):
            return described(found)
        rank *= 4


def label_links(metrics: DataFrame, sure: DataFrame, glossary: DataFrame, keep=lambda df: df) -> Links:
    """The pairs of `conflicts` by classes of equal labels, whatever their order: similarity and blocks of labels and terms are a class's."""
    m = metrics.where("not opaque").join(sure, "metric_id", "left_semi").withColumn("labels", F.array_sort("labels")).where(F.size("labels") > 0)
    m = keep(m.select("metric_id", F.array_join("labels", "\x1f").alias("class"), "labels", "operand_columns", "raw_shapes", "texts"))
    of = keep(m.select(F.col("class").alias("metric_id"), "labels").distinct())
    label = of.select(F.col("metric_id").alias("class"), F.explode("labels").alias("label"))
    keyed = label.select("class", F.concat(F.lit("label:"), S.label_key(F.col("label"))).alias("block")).where("block <> 'label:'")
    termed = label.withColumn("term_key", S.token_key(F.col("label"))).join(terms(glossary).select("term_key", "term_id"), "term_key").select("class", F.concat(F.lit("term:"), "term_id").alias("block"))
    e = keyed.union(termed).distinct()
    meet = e.select("block", F.col("class").alias("a")).join(e.select("block", F.col("class").alias("b")), "block").where("a <= b").groupBy("a", "b").agg(F.min("block").alias("block"))
    links = keep(similar_pairs(keep(meet), of, keep).select("a", "b"))
    own = m.select("metric_id", "class")
    side = lambda n: own.select(F.col("metric_id").alias(n), F.col("class").alias(f"c{n}"))
    pairs = lambda rows: _ordered(rows).join(side("a"), "a").join(side("b"), "b").select("a", "b", F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb"))
    linked = links.select(F.col("a").alias("ca"), F.col("b").alias("cb"))
    by_column = keep(pairs(m.select("metric_id", F.explode("operand_columns").alias("k"))).join(linked, ["ca", "cb"], "left_anti"))
    alike = similar_pairs(keep(by_column.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()), of, keep).select(F.col("a").alias("ca"), F.col("b").alias("cb"))
    more = keep(by_column.join(alike, ["ca", "cb"]).select("a", "b"))
    wrote = m.select("metric_id", F.explode(F.concat(F.transform("raw_shapes", lambda x: F.concat(F.lit("shape:"), x)), F.transform("texts", lambda x: F.concat(F.lit("text:"), x)))).alias("k"))
    induced = keep(pairs(wrote))
    less = induced.join(linked, ["ca", "cb"], "left_semi").select("a", "b", F.lit(-1).alias("n"))
    return Links(own, links, keep(more.join(induced, ["a", "b"], "left_anti").withColumn("n", F.lit(1)).union(less)))


def _ordered(rows: DataFrame) -> DataFrame:
    """(a, b), a < b, of metrics that share a key k."""
    return rows.select("k", F.col("metric_id").alias("a")).join(rows.select("k", F.col("metric_id").alias("b")), "k").where("a < b").select("a", "b").distinct()


def link_counts(x: Links) -> DataFrame:
    """(metric_id, n_links): conflicts of each metric that has any, none of whose pairs is made."""
    size = x.classes.groupBy("class").agg(F.count("*").alias("size"))
    ends = x.links.select(F.col("a").alias("class"), F.col("b").alias("other")).union(x.links.where("a <> b").select("b", "a"))
    near = ends.join(size.withColumnRenamed("class", "other"), "other").groupBy("class").agg((F.sum("size") - F.count_if(F.col("class") == F.col("other"))).alias("n"))
    single = x.singles.select(F.explode(F.array("a", "b")).alias("metric_id"), "n")
    rows = x.classes.join(near, "class").select("metric_id", "n").union(single)
    return rows.groupBy("metric_id").agg(F.sum("n").alias("n_links")).where("n_links > 0")


def tally(x: Links, marks: DataFrame) -> DataFrame:
    """(a, b, n): conflicts whose metric of smaller id has mark a and whose other one has mark b; marks: (metric_id, mark).

    A link's metrics meet in one task as ids with marks, in order: what precedes a metric is counted, not paired.
    """
    own = x.classes.join(marks, "metric_id")
    left = x.links.join(own.withColumnRenamed("class", "a"), "a").select("a", "b", "metric_id", "mark", F.lit(0).alias("side"))
    right = x.links.where("a <> b").join(own.withColumnRenamed("class", "b"), "b").select("a", "b", "metric_id", "mark", F.lit(1).alias("side"))

    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("metric_id")
        code, names = pd.factorize(rows["mark"])
        side, same = rows["side"].to_numpy(), key[0] == key[1]
        out = []
        for k in range(len(names)):
            mine = code == k
            before = np.cumsum(mine) - mine if same else np.where(side == 0, np.cumsum(mine & (side == 1)), np.cumsum(mine & (side == 0)))
            n = np.bincount(code, weights=before, minlength=len(names)).astype(np.int64)
            out += [(names[k], names[j], int(n[j])) for j in np.flatnonzero(n)]
        return pd.DataFrame(out, columns=["a", "b", "n"])

    linked = left.union(right).groupBy("a", "b").applyInPandas(count, "a string, b string, n long")
    mark = lambda n: marks.select(F.col("metric_id").alias(n), F.col("mark").alias(f"m{n}"))
    single = x.singles.join(mark("a"), "a").join(mark("b"), "b").select("ma", "mb", F.col("n").cast("long"))
    return linked.union(single).groupBy("a", "b").agg(F.sum("n").alias("n")).where("n <> 0")


def canonicalize(g: Graph, as_of: Column, keep=lambda df: df) -> Metrics:
    """Groups the graph's metric nodes by fingerprint and finds how they conflict."""
    printed = keep(fingerprints(g.calculations, g.edges.join(g.calculations.select("kpi_id"), "kpi_id", "left_semi")))
    own = g.nodes.select("kpi_id", "calc").join(members(printed), "calc").drop("calc")
    metrics, own = together(keep, build_metrics(g, printed, report_weights(g.reports, as_of)), own)
    return Metrics(metrics, own, keep(confident(own, g.edges)), g.glossary, keep)


def glossary_delta(metrics: DataFrame, glossary: DataFrame) -> DataFrame:
    """(kind, metric_id, term_id, detail): metrics without a term, terms that contradict the calculation, terms in use
    that aren't approved, terms without a steward."""
    t = terms(glossary).select("term_key", "term_id", F.col("definition").alias("t_definition"), F.col("steward").alias("t_steward"), "status_class")
    m = metrics.select("metric_id", "aggregation", "canonical_name", F.coalesce(F.get("labels", 0), F.col("canonical_name")).alias("label")).withColumn("term_key", S.token_key(F.col("label")))
    j = m.join(t, "term_key", "left")
    lacks = F.col("term_id").isNull()
    one = lambda kind, holds, detail: F.when(holds, F.struct(F.lit(kind).alias("kind"), detail.alias("detail")))
    found = F.array(
        one("propose", lacks, F.col("label")),
        one("contradiction", ~lacks & contradicts(F.col("t_definition"), F.col("aggregation")), F.col("aggregation")),
        one("status", ~lacks & F.col("status_class").isin("draft", "retired"), F.col("status_class")),
        one("unassigned", ~lacks & (F.coalesce("t_steward", F.lit("")) == ""), F.col("label")),
    )
    return j.select("metric_id", "term_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select("f.kind", "metric_id", "term_id", "f.detail")


def contradicts(definition: Column, aggregation: Column) -> Column:
    """Whether a definition names an aggregation, and not the one that is computed."""
    words = {"SUM": "total|sum", "AVG": "average|mean", "COUNT": "count|number of", "MAX": "maximum|highest", "MIN": "minimum|lowest", "RATIO": "ratio|rate|share", "MEDIAN": "median"}
    text = F.lower(F.coalesce(definition, F.lit("")))
    names = F.filter(F.array(*[F.when(text.rlike(rf"\b({w})\b"), F.lit(k)) for k, w in words.items()]), lambda x: x.isNotNull())
    own = F.when(aggregation == "COUNT DISTINCT", "COUNT").otherwise(aggregation)
    return (F.size(names) > 0) & ~F.array_contains(names, own)
