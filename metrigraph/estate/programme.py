"""Effort, value, attribution, dependencies and waves of candidates."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrigraph.estate.candidates import Candidates
from metrigraph.estate.graph import Graph
from metrigraph.estate.metrics import Metrics, link_counts
from metrigraph.functions import scalars as S
from metrigraph.operators.scoring import effort_size, npv

# Points per unit of each driver, weeks of stages 1-6 by size, capacity of a wave.
RATES = {"metric_count": 1.0, "source_systems": 4.0, "open_conflicts": 1.5, "pii_attributes": 1.0, "attributes_without_definition": 0.5, "quarantined_lineage_rows": 0.5, "opaque_metrics": 2.0, "cross_tool_spread": 6.0, "report_complexity": 10.0, "grain_ambiguity": 12.0, "readiness_gap": 8.0}
STAGE_WEEKS = {"XS": (1, 1, 1, 1, 1, 1), "S": (1, 1, 2, 1, 2, 2), "M": (2, 2, 3, 2, 3, 3), "L": (2, 3, 4, 3, 4, 5), "XL": (3, 4, 6, 4, 6, 7)}
PRODUCTS, WEEKS, POINTS, WAVES = 3, 12, 120.0, 12


@dataclass(frozen=True)
class RateCard:
    """Illustrative rates; a card that was approved names who and from when."""

    version: str = "va-1.0-illustrative"
    hours: dict = field(default_factory=lambda: {"low": 24.0, "medium": 60.0, "high": 120.0})
    edges: tuple[float, float] = (0.34, 0.67)
    rate: float = 95.0
    licence: dict = field(default_factory=lambda: {"cognos": 1200.0, "powerbi": 420.0})
    package: float = 15000.0
    conflict_hours: float = 6.0
    periods: int = 12
    mis_decision: dict = field(default_factory=lambda: {"regulatory": 50000.0, "financial": 20000.0})
    realised: dict = field(default_factory=lambda: {"retire": 1.0, "merge": 1.0, "migrate": 0.5, "keep": 0.0})
    point: float = 1800.0
    approved_by: str = ""
    effective_from: str = ""


def approve(card: RateCard, approver: str, effective_from: str) -> RateCard:
    if not approver.strip():
        raise ValueError("an approval names its approver")
    return replace(card, version=f"{card.version}+{approver}", approved_by=approver, effective_from=effective_from)


def complexity_band(score: Column, card: RateCard = RateCard()) -> Column:
    return F.when(score < card.edges[0], "low").when(score < card.edges[1], "medium").otherwise("high")


def _of(table: dict, key: Column, default: float = 0.0) -> Column:
    return F.coalesce(*[F.when(F.lower(key) == k, F.lit(v)) for k, v in table.items()], F.lit(default))


def effort_drivers(c: Candidates, m: Metrics, g: Graph) -> DataFrame:
    """One row a candidate with the eleven drivers of effort. readiness, where known, is a share of heads; else 0."""
    own = c.members.join(m.metrics.select("metric_id", "opaque", "tools"), "metric_id").groupBy("candidate_id").agg(F.count("*").alias("metric_count"), F.count_if("opaque").alias("opaque_metrics"), (F.size(F.array_distinct(F.flatten(F.collect_set("tools")))) > 1).cast("int").alias("cross_tool_spread"))
    sys = c.sources.where("system <> ''").groupBy("candidate_id").agg(F.count_distinct("system").alias("source_systems"))
    opened = c.touched.groupBy("candidate_id").agg(F.sum("n").alias("open_conflicts"))  # all are open when found
    att = c.attributes.groupBy("candidate_id").agg(F.count_if("pii_flag").alias("pii_attributes"), F.count_if((F.col("role") == "operand") & (F.col("definition") == "")).alias("attributes_without_definition"))
    lost = c.members.join(m.members.select("kpi_id", "metric_id"), "metric_id").join(g.quarantine.select("kpi_id"), "kpi_id").groupBy("candidate_id").agg(F.count("*").alias("quarantined_lineage_rows"))
    rep = c.reports.where("covered = all").groupBy("candidate_id").agg(F.avg("complexity_score").alias("report_complexity"))
    x = c.heads.select("candidate_id", "grain_ambiguity")
    for df in (own, sys, opened, att, lost, rep):
        x = x.join(df, "candidate_id", "left")
    return x.na.fill(0).na.fill(0.0).withColumn("readiness_gap", F.lit(1.0))


def estimate_effort(drivers: DataFrame) -> DataFrame:
    """(candidate_id, points, size, weeks by stage, total_weeks)."""
    points = sum((F.col(n) * r for n, r in RATES.items()), F.lit(0.0))
    x = drivers.withColumn("points", F.round(points, 6)).withColumn("size", effort_size(F.col("points")))
    stretch = {0: 2.0 * F.col("readiness_gap"), 2: 0.5 * F.greatest(F.lit(0), F.col("source_systems") - 1) + 0.1 * F.col("quarantined_lineage_rows"), 4: 0.1 * F.col("attributes_without_definition"), 5: F.col("open_conflicts") / 3.0 + 0.5 * F.col("opaque_metrics")}
    weeks = [F.coalesce(*[F.when(F.col("size") == s, F.lit(float(w[i]))) for s, w in STAGE_WEEKS.items()]) + stretch.get(i, F.lit(0.0)) for i in range(6)]
    out = x.select("candidate_id", "points", "size", *[w.alias(f"stage_{i + 1}") for i, w in enumerate(weeks)])
    return out.withColumn("total_weeks", sum((F.col(f"stage_{i}") for i in range(1, 7)), F.lit(0.0)))


def is_hold(reports: DataFrame) -> DataFrame:
    return reports.withColumn("hold", S.is_hold(F.col("report_name"), F.col("decision_critical"))).withColumn("regulatory", S.is_hold(F.col("report_name"), F.lit(False)))


def is_retirable(covered: Column, hold: Column, disposition: Column) -> Column:
    return covered & ~hold & F.lower(disposition).isin("retire", "merge", "migrate")


def retirement_action(covered: Column, hold: Column, disposition: Column) -> Column:
    """What happens to a report: by coverage, hold and disposition."""
    return F.when(hold, "hold: re-point, never retire").when(~covered, "partial: re-point what is covered").when(F.lower(disposition) == "keep", "keep: re-point").otherwise(F.lower(disposition))


def attribute_reports(reports: DataFrame, scores: DataFrame) -> DataFrame:
    """(report_id, candidate_id): one primary candidate of each fully covered report: the best composite, then the smaller id."""
    r = reports.where("covered = all").select("report_id", "candidate_id").join(scores.select("candidate_id", "composite"), "candidate_id")
    return r.groupBy("report_id").agg(F.min(F.struct((-F.col("composite")).alias("s"), "candidate_id")).alias("b")).select("report_id", F.col("b.candidate_id").alias("candidate_id"))


def attribute_conflicts(c: Candidates, scores: DataFrame) -> DataFrame:
    """(candidate_id, own): conflicts whose primary candidate it is: of those that a conflict touches the best, then the smaller id."""
    sides = c.conflicts.groupBy("a", "b").agg(F.sum("n").alias("n")).withColumn("of", F.array_union("a", "b"))
    best = sides.select("a", "b", "n", F.explode("of").alias("candidate_id")).join(scores.select("candidate_id", "composite"), "candidate_id").groupBy("a", "b").agg(F.min(F.struct((-F.col("composite")).alias("s"), "candidate_id")).alias("w"), F.max("n").alias("n"))
    return best.groupBy(F.col("w.candidate_id").alias("candidate_id")).agg(F.sum("n").alias("own"))


def package_impact(reports: DataFrame, inventory: DataFrame, attribution: DataFrame) -> DataFrame:
    """(candidate_id, package, reports, whole): packages of a candidate's retirable reports; whole if every report of the
    package is retirable and attributed to the candidate."""
    r = is_hold(reports).where(is_retirable(F.col("covered") == F.col("all"), F.col("hold"), F.col("disposition")))
    own = r.join(attribution, ["report_id", "candidate_id"], "left_semi").where("semantic_container <> ''").groupBy("candidate_id", F.col("semantic_container").alias("package")).agg(F.count("*").alias("n"))
    size = inventory.where("semantic_container <> ''").groupBy(F.col("semantic_container").alias("package")).agg(F.count_distinct("report_id").alias("reports"))
    return own.join(size, "package").select("candidate_id", "package", "reports", (F.col("n") == F.col("reports")).alias("whole"))


def value(c: Candidates, m: Metrics, g: Graph, scores: DataFrame, effort: DataFrame, card: RateCard = RateCard()) -> DataFrame:
    """One row a candidate: five benefits (all of them, and the share attributed to it), build cost, payback, NPV."""
    mine = attribute_reports(c.reports, scores).withColumn("primary", F.lit(True))
    r = is_hold(c.reports).withColumn("goes", is_retirable(F.col("covered") == F.col("all"), F.col("hold"), F.col("disposition"))).join(mine, ["report_id", "candidate_id"], "left").withColumn("primary", F.coalesce("primary", F.lit(False)))
    share = _of(card.realised, F.col("disposition"))
    upkeep = _of(card.hours, complexity_band(F.col("complexity_score"), card)) * card.rate * share
    licence = _of(card.licence, F.col("tool")) * share
    read = m.metrics.join(link_counts(m.links), "metric_id", "left_semi").select(F.explode("report_ids").alias("report_id")).distinct().withColumn("conflicted", F.lit(True))
    r = r.join(read, "report_id", "left")
    exposed = F.coalesce("conflicted", F.lit(False)) & F.col("hold") & (F.col("covered") == F.col("all"))
    risk = F.when(F.col("regulatory"), card.mis_decision["regulatory"]).otherwise(card.mis_decision["financial"])
    total = lambda v, holds, name: [F.coalesce(F.sum(F.when(holds, v)), F.lit(0.0)).alias(name), F.coalesce(F.sum(F.when(holds & F.col("primary"), v)), F.lit(0.0)).alias(f"{name}_own")]
    rep = r.groupBy("candidate_id").agg(*total(upkeep, F.col("goes"), "upkeep"), *total(licence, F.col("goes"), "licence"), *total(risk, exposed, "mis_decision"))
    whole = package_impact(c.reports, g.reports, c.reports.select("report_id", "candidate_id")).where("whole").groupBy("candidate_id").agg((F.count("*") * card.package).alias("package"))
    own = package_impact(c.reports, g.reports, attribute_reports(c.reports, scores)).where("whole").groupBy("candidate_id").agg((F.count("*") * card.package).alias("package_own"))
    each = card.conflict_hours * card.periods * card.rate
    con = c.touched.groupBy("candidate_id").agg(F.sum("n").alias("n")).join(attribute_conflicts(c, scores), "candidate_id", "left").select("candidate_id", (F.col("n") * each).alias("conflict"), (F.coalesce("own", F.lit(0)) * each).alias("conflict_own"))
    x = c.heads.select("candidate_id")
    for df in (rep, whole, own, con, effort.select("candidate_id", "points", "size")):
        x = x.join(df, "candidate_id", "left")
    x = x.na.fill(0.0).na.fill(0)
    parts = ("upkeep", "licence", "package", "conflict", "mis_decision")
    x = x.withColumn("gross", sum((F.col(p) for p in parts), F.lit(0.0))).withColumn("attributed", sum((F.col(f"{p}_own") for p in parts), F.lit(0.0))).withColumn("build_cost", F.col("points") * card.point)
    return x.withColumn("payback_months", F.when((F.col("attributed") > 0) & (F.col("build_cost") > 0), 12.0 * F.col("build_cost") / F.col("attributed"))).withColumn("npv", npv(F.col("attributed"), F.col("build_cost")))


def value_totals(values: DataFrame) -> DataFrame:
    """One row: the portfolio's sums, of which only attributed benefits don't count twice."""
    return values.agg(F.sum("gross").alias("gross"), F.sum("attributed").alias("attributed"), F.sum("build_cost").alias("build_cost"), (F.sum("gross") - F.sum("attributed")).alias("double_counted"))


def value_sentence(attributed: Column, cost: Column, payback: Column) -> Column:
    return F.concat(F.lit("Releases "), F.format_number(attributed, 0), F.lit(" a year for "), F.format_number(cost, 0), F.when(payback.isNull(), ", payback undefined").otherwise(F.concat(F.lit(", paid back in "), F.format_number(payback, 1), F.lit(" months"))))


def dependencies(c: Candidates, m: Metrics, scores: DataFrame) -> DataFrame:
    """(candidate_id, type, target, status, detail): parents and parts, entity masters of shared tables, successors of
    systems in sunset, stewards with open conflicts."""
    status = scores.select(F.col("candidate_id").alias("target"), "status")
    h = c.heads.select("candidate_id", "origin", "parent_candidate_id", "depends_on")
    told = h.select("candidate_id", F.explode(F.array_distinct(F.filter(F.concat(F.array("parent_candidate_id"), "depends_on"), lambda x: x != ""))).alias("target")).where("candidate_id <> target")
    parts = told.join(status, "target", "left").select("candidate_id", F.lit("candidate").alias("type"), "target", F.coalesce("status", F.lit("MISSING")).alias("status"), F.lit("parent or part").alias("detail"))
    masters = c.sources.join(h.where("origin = 'entity_master'").select("candidate_id"), "candidate_id", "left_semi").groupBy("table_fqn").agg(F.min("candidate_id").alias("target"))
    use = c.sources.join(h.where("origin <> 'entity_master'").select("candidate_id"), "candidate_id", "left_semi").select("candidate_id", "table_fqn").join(masters, "table_fqn").join(told, ["candidate_id", "target"], "left_anti")
    hubs = use.join(status, "target", "left").select("candidate_id", F.lit("entity_master"), "target", F.coalesce("status", F.lit("MISSING")), F.concat(F.lit("joins on "), "table_fqn"))
    dying = c.sources.where("lifecycle_status = 'sunset'").groupBy("candidate_id", "system").agg(F.max("successor_system").alias("successor"))
    succ = dying.select("candidate_id", F.lit("successor_system"), F.when(F.col("successor") != "", F.col("successor")).otherwise(F.col("system")), F.when(F.col("successor") != "", "OPEN").otherwise("BLOCKING"), F.concat("system", F.lit(" is in sunset")))
    stew = c.touched.groupBy("candidate_id", F.coalesce(F.nullif(F.col("steward"), F.lit("")), F.lit("UNASSIGNED")).alias("s")).agg(F.sum("n").alias("n")).select("candidate_id", F.lit("steward_adjudication"), "s", F.lit("OPEN"), F.concat(F.col("n").cast("string"), F.lit(" open conflict(s)")))
    return parts.union(hubs).union(succ).union(stew)


def dependents_of(rows: DataFrame) -> DataFrame:
    """(target, dependents): who waits for a candidate."""
    return rows.where("type in ('candidate', 'entity_master')").groupBy("target").agg(F.array_sort(F.collect_set("candidate_id")).alias("dependents"))


@dataclass(frozen=True)
class Product:
    candidate_id: str
    status: str
    points: float
    benefit: float
    composite: float
    after: tuple[str, ...] = ()


def plan_waves(products: list[Product], include_exploratory: bool = True, capacity: int = PRODUCTS, points: float = POINTS, waves: int = WAVES) -> tuple[dict[str, int], dict[str, str]]:
    """(candidate -> wave, candidate -> why it isn't scheduled) of a programme's products: greedy by benefit a point.

    A product starts after all that it depends on; what depends on an unscheduled product isn't scheduled; a wave holds
    `capacity` products and `points`, which its first product may exceed. Products of one programme: tens, on the driver.
    """
    by = {p.candidate_id: p for p in products}
    after = {p.candidate_id: [t for t in p.after if t in by] for p in products}
    out = {p.candidate_id: "Blocked by a gate" for p in products if p.status == "Blocked"}
    if not include_exploratory:
        out |= {p.candidate_id: "Exploratory: a consumer or lineage isn't confirmed" for p in products if p.status == "Exploratory"}
    while new := {c: "depends on unscheduled " + ", ".join(sorted(t for t in ts if t in out)) for c, ts in after.items() if c not in out and any(t in out for t in ts)}:
        out |= new
    left, placed = set(by) - set(out), {}
    for wave in range(1, waves + 1):
        ready = sorted((by[c] for c in left if all(t in placed for t in after[c])), key=lambda p: (-round(p.benefit / p.points if p.points else p.benefit, 6), -p.composite, p.candidate_id))
        if not left or not ready:
            break
        used, now = 0.0, []
        for p in ready:
            if len(now) < capacity and (not now or used + p.points <= points):
                now.append(p.candidate_id)
                used += p.points
        placed |= dict.fromkeys(now, wave)
        left -= set(now)
    stuck = {c for c in left if any(t not in placed for t in after[c])}
    return placed, out | {c: "dependency cycle" if c in stuck else f"beyond {waves} waves" for c in left}


def retirement_map(reports: DataFrame, attribution: DataFrame) -> DataFrame:
    """(candidate_id, full, partial, retirable, held, users, attributed): what a candidate retires."""
    mine = attribution.withColumn("own", F.lit(True))
    r = is_hold(reports).join(mine, ["report_id", "candidate_id"], "left")
    full = F.col("covered") == F.col("all")
    goes = is_retirable(full, F.col("hold"), F.col("disposition"))
    return r.groupBy("candidate_id").agg(F.count_if(full).alias("full"), F.count_if(~full).alias("partial"), F.count_if(goes).alias("retirable"), F.count_if(full & F.col("hold")).alias("held"), F.coalesce(F.sum(F.when(goes, F.col("users"))), F.lit(0)).alias("users"), F.count_if(goes & F.col("own").isNotNull()).alias("attributed"))


def estate_retirement(reports: DataFrame) -> DataFrame:
    """(disposition, reports, held): fully covered reports of all candidates, each once."""
    r = is_hold(reports).where("covered = all").select("report_id", "disposition", "hold").distinct()
    return r.groupBy("disposition").agg(F.count("*").alias("reports"), F.count_if("hold").alias("held"))


def conflict_heat(conflicts: DataFrame) -> DataFrame:
    """(label, metrics, conflicts, usage_at_stake, patterns, open) by label, whatever its case."""
    x = conflicts.select(F.lower("label").alias("label"), "conflict_id", "metric_id_a", "metric_id_b", (F.col("usage_weight_a") + F.col("usage_weight_b")).alias("u"), "pattern", "resolution_status")
    return x.groupBy("label").agg(F.size(F.array_distinct(F.flatten(F.collect_set(F.array("metric_id_a", "metric_id_b"))))).alias("metrics"), F.count("*").alias("conflicts"), F.max("u").alias("usage_at_stake"), F.array_sort(F.collect_set("pattern")).alias("patterns"), F.count_if(F.col("resolution_status") == "OPEN").alias("open"))


def mixes(heads: DataFrame, scores: DataFrame) -> DataFrame:
    """(mix, value, n) by archetype, tier, status and domain."""
    x = heads.select("candidate_id", "domain").join(scores, "candidate_id")
    rows = F.array(*[F.struct(F.lit(k).alias("mix"), F.col(k).alias("value")) for k in ("archetype", "tier", "status", "domain")])
    return x.select(F.explode(rows).alias("r")).select("r.*").groupBy("mix", "value").agg(F.count("*").alias("n"))
