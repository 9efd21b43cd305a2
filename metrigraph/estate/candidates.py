"""Candidates: metrics that belong in one product, from communities, grains, hub tables and consumers; and what belongs
to each: sources, consumers, reports, attributes, owner, steward, gaps. Satellites are joins on (candidate_id, metric_id)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrigraph.estate import grain as G
from metrigraph.estate.graph import Graph, definition_credit, table_of
from metrigraph.estate.metrics import Metrics, steward_state, tally
from metrigraph.functions import scalars as S
from metrigraph.operators import community
from metrigraph.operators.relational import majority, modal_first_seen
from metrigraph.operators.resolve import PROBABLE
from metrigraph.storage import keep, together

# Least similarity, bonus of a common domain, cap, resolutions, hubs, composites, words that name no subject.
MIN_SIMILARITY, DOMAIN_BONUS, SIMILARITY_CAP = 0.25, 0.20, 1.2
RESOLUTION, SWEEP, HUB_COMMUNITIES = 1.0, (0.7, 1.0, 1.3), 3
COMPOSITE_PARTS, COMPOSITE_USERS, COMPOSITE_SHARE, COMPOSITE_TOP, COMPOSITE_METRICS = 2, 3, 0.20, 4, 12
GENERIC = ("amount", "balance", "count", "total", "average", "rate", "ratio", "value", "number", "days", "minutes", "seconds", "hours", "score", "index", "share", "per", "of", "and", "the", "by", "in", "flag", "volume", "position", "legacy")


@dataclass(frozen=True)
class Candidates:
    """heads (one row each), members (candidate_id, metric_id) and satellites by candidate_id; conflicts counted when asked for."""

    heads: DataFrame
    members: DataFrame
    sources: DataFrame
    consumers: DataFrame
    reports: DataFrame
    attributes: DataFrame
    metrics: Metrics
    keep: Callable[[DataFrame], DataFrame] = keep

    @cached_property
    def conflicts(self) -> DataFrame:
        return self.keep(conflicts_of(self.members, self.metrics))

    @property
    def touched(self) -> DataFrame:
        """(candidate_id, steward, inside, n): conflicts that touch a candidate, counted; inside if both sides are its metrics."""
        return self.conflicts.select(F.explode(F.array_union("a", "b")).alias("candidate_id"), "steward", "a", "b", "n").select("candidate_id", "steward", (F.array_contains("a", F.col("candidate_id")) & F.array_contains("b", F.col("candidate_id"))).alias("inside"), "n")


def bipartite(m: Metrics, edges: DataFrame) -> DataFrame:
    """(metric_id, table_fqn): tables of a metric's operand columns that resolved at least probably."""
    e = edges.where((F.col("role") == "operand") & (F.col("confidence") >= PROBABLE)).select("kpi_id", table_of(F.col("column_fqn")).alias("table_fqn")).distinct()
    return m.members.select("kpi_id", "metric_id").join(e, "kpi_id").select("metric_id", "table_fqn").distinct()


def data_gaps(m: Metrics, both: DataFrame) -> DataFrame:
    """(metric_id) of metrics without a resolved table."""
    return m.metrics.select("metric_id").join(both, "metric_id", "left_anti")


def project(both: DataFrame, domains: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """(a, b, weight): Jaccard of the metrics' tables without the excluded ones, raised for a common domain.

    domains: (metric_id, domain). Pairs come from shared tables; sizes are joined, no set travels.
    """
    e = both if excluded is None else both.join(excluded.select("table_fqn"), "table_fqn", "left_anti")
    sizes = e.groupBy("metric_id").agg(F.count("*").alias("n")).join(domains, "metric_id", "left")
    x, y = e.select("table_fqn", F.col("metric_id").alias("a")), e.select("table_fqn", F.col("metric_id").alias("b"))
    shared = x.join(y, "table_fqn").where("a < b").groupBy("a", "b").agg(F.count("*").alias("k"))
    s = shared.join(sizes.select(F.col("metric_id").alias("a"), F.col("n").alias("na"), F.col("domain").alias("da")), "a").join(sizes.select(F.col("metric_id").alias("b"), F.col("n").alias("nb"), F.col("domain").alias("db")), "b")
    same = (F.coalesce("da", F.lit("")) != "") & (F.col("da") == F.col("db"))
    weight = F.col("k") / (F.col("na") + F.col("nb") - F.col("k")) + F.when(same, DOMAIN_BONUS).otherwise(0.0)
    return s.select("a", "b", F.least(weight, F.lit(SIMILARITY_CAP)).alias("weight")).where(F.col("weight") >= MIN_SIMILARITY)


def conformed(both: DataFrame, tables: DataFrame) -> DataFrame:
    """(table_fqn): tables in use that have a key and fewer than two measures."""
    return tables.where("has_key and measure_count < 2").select("table_fqn").join(both, "table_fqn", "left_semi")


def hubs(both: DataFrame, communities: DataFrame, shared: DataFrame, least: int = HUB_COMMUNITIES) -> DataFrame:
    """(table_fqn, communities): conformed tables that reach at least so many communities (node, community)."""
    reach = both.join(shared.select("table_fqn"), "table_fqn", "left_semi").join(communities.select(F.col("node").alias("metric_id"), "community"), "metric_id")
    return reach.groupBy("table_fqn").agg(F.count_distinct("community").alias("communities")).where(F.col("communities") >= least)


def detect(both: DataFrame, edges: DataFrame, excluded: DataFrame | None = None, resolution: float = RESOLUTION, keep=keep) -> DataFrame:
    """(node, community) of all metrics with a table that isn't excluded; one without neighbours is its own community."""
    nodes = both if excluded is None else both.join(excluded.select("table_fqn"), "table_fqn", "left_anti")
    found = community.communities(edges, "a", "b", "weight", keep, resolution=resolution)
    alone = nodes.select(F.col("metric_id").alias("node")).distinct().join(found, "node", "left_anti")
    return found.union(alone.select("node", F.concat(F.lit("S-"), "node")))


def split_by_grain(communities: DataFrame, metrics: DataFrame, run_id: str) -> tuple[DataFrame, DataFrame]:
    """(heads, members): one candidate for each grain of a community; the heaviest is the parent of the others."""
    m = communities.select(F.col("node").alias("metric_id"), "community").join(metrics.select("metric_id", "grain", "usage_weight"), "metric_id")
    groups = m.groupBy("community", "grain").agg(F.sum("usage_weight").alias("usage"), F.array_sort(F.collect_set("metric_id")).alias("ids"))
    rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc(F.round("usage", 9)), "grain"))
    parent = F.first("candidate_id").over(Window.partitionBy("community").orderBy("rank"))
    heads = groups.withColumn("rank", rank).withColumn("candidate_id", S.stable_id("CAND", F.lit(run_id), F.col("community"), F.col("grain"), F.array_join("ids", ";")))
    heads = heads.withColumn("parent_candidate_id", F.when(F.col("rank") > 1, parent).otherwise(""))
    heads = heads.select("candidate_id", F.when(F.col("rank") == 1, "community").otherwise("grain_child").alias("origin"), "community", "grain", "parent_candidate_id", F.when(F.col("rank") > 1, F.array("parent_candidate_id")).otherwise(F.array().cast("array<string>")).alias("depends_on"), "ids", F.lit("").alias("name_hint"), F.lit(0).cast("long").alias("reuse"))
    return heads.drop("ids"), heads.select("candidate_id", F.explode("ids").alias("metric_id"))


def entity_masters(hub: DataFrame, both: DataFrame, tables: DataFrame, run_id: str) -> tuple[DataFrame, DataFrame]:
    """(heads, members): one candidate for each hub table, at the table's grain."""
    m = both.join(hub, "table_fqn").groupBy("table_fqn", "communities").agg(F.array_sort(F.collect_set("metric_id")).alias("ids")).join(tables.select("table_fqn", "table_name", F.col("grain")), "table_fqn")
    name = F.concat(F.lit("EM-"), "table_name")
    heads = m.select(S.stable_id("CAND", F.lit(run_id), name, F.col("grain"), F.array_join("ids", ";")).alias("candidate_id"), F.lit("entity_master").alias("origin"), name.alias("community"), "grain", F.lit("").alias("parent_candidate_id"), F.array().cast("array<string>").alias("depends_on"), "ids", F.concat("grain", F.lit(" master")).alias("name_hint"), F.col("communities").alias("reuse"))
    return heads.drop("ids"), heads.select("candidate_id", F.explode("ids").alias("metric_id"))


def composites(heads: DataFrame, members: DataFrame, consumers: DataFrame, metrics: DataFrame, run_id: str, keep=lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(heads, members): one candidate for each business unit that leads the use of several candidates.

    It takes the heaviest COMPOSITE_TOP of them and of their metrics the heaviest COMPOSITE_METRICS.
    """
    base = heads.where("origin in ('community', 'grain_child')").select("candidate_id", "grain")
    c = consumers.join(base, "candidate_id")
    by = Window.partitionBy("candidate_id")
    c = c.withColumn("all", F.greatest(F.sum("users").over(by), F.lit(1))).withColumn("at", F.row_number().over(by.orderBy(F.desc("users"), "business_unit")))
    leads = c.where((F.col("at") <= 2) & (F.col("users") >= COMPOSITE_USERS) & (F.col("users") / F.col("all") >= COMPOSITE_SHARE)).select("business_unit", "candidate_id", "grain")
    leads = keep(leads)
    several = leads.groupBy("business_unit").agg(F.count("*").alias("n")).where(F.col("n") >= COMPOSITE_PARTS)
    weight = members.join(metrics.select("metric_id", "usage_weight"), "metric_id").groupBy("candidate_id").agg(F.sum("usage_weight").alias("usage"))
    parts = leads.join(several, "business_unit").join(weight, "candidate_id")
    parts = parts.withColumn("at", F.row_number().over(Window.partitionBy("business_unit").orderBy(F.desc(F.round("usage", 9)), "candidate_id"))).where(F.col("at") <= COMPOSITE_TOP)
    pool = parts.select("business_unit", "candidate_id").join(members, "candidate_id").select("business_unit", "metric_id").distinct().join(metrics.select("metric_id", "usage_weight"), "metric_id")
    pool = pool.withColumn("at", F.row_number().over(Window.partitionBy("business_unit").orderBy(F.desc(F.round("usage_weight", 9)), "metric_id"))).where(F.col("at") <= COMPOSITE_METRICS)
    ids = pool.groupBy("business_unit").agg(F.array_sort(F.collect_set("metric_id")).alias("ids"))
    of = parts.groupBy("business_unit").agg(F.array_sort(F.collect_set("candidate_id")).alias("depends_on"))
    grain = modal_first_seen(parts, ["business_unit"], "grain", "at", "grain").drop("votes")
    name = F.concat(F.lit("COMP-"), "business_unit")
    out = keep(ids.join(of, "business_unit").join(grain, "business_unit").select(S.stable_id("CAND", F.lit(run_id), name, F.col("grain"), F.array_join("ids", ";")).alias("candidate_id"), F.lit("composite").alias("origin"), name.alias("community"), "grain", F.lit("").alias("parent_candidate_id"), "depends_on", "ids", F.concat("business_unit", F.lit(" view")).alias("name_hint"), F.lit(0).cast("long").alias("reuse")))
    return out.drop("ids"), out.select("candidate_id", F.explode("ids").alias("metric_id"))


def sources_of(members: DataFrame, metrics: DataFrame, tables: DataFrame) -> DataFrame:
    """(candidate_id, table_fqn, metrics, share_of_metrics, system, ...): operand tables by the share of metrics that read them."""
    n = members.groupBy("candidate_id").agg(F.count("*").alias("n"))
    t = members.join(metrics.select("metric_id", F.explode("source_tables").alias("table_fqn")), "metric_id").groupBy("candidate_id", "table_fqn").agg(F.count_distinct("metric_id").alias("metrics"))
    return t.join(n, "candidate_id").join(tables, "table_fqn").select("candidate_id", "table_fqn", "metrics", (F.col("metrics") / F.col("n")).alias("share_of_metrics"), "system", "sor_flag", "lifecycle_status", "sunset_date", "successor_system", "domain", "owner", "steward", "measure_count", "row_count", "has_key")


def report_coverage(members: DataFrame, metrics: DataFrame, reports: DataFrame) -> DataFrame:
    """(candidate_id, report_id, coverage, ...): share of a report's metrics that a candidate carries."""
    r = metrics.select("metric_id", F.explode("report_ids").alias("report_id"))
    total = r.groupBy("report_id").agg(F.count("*").alias("all"))
    own = members.join(r, "metric_id").groupBy("candidate_id", "report_id").agg(F.count("*").alias("covered"))
    return own.join(total, "report_id").join(reports, "report_id").select("candidate_id", "report_id", "covered", "all", (F.col("covered") / F.col("all")).alias("coverage"), "report_name", "disposition", F.col("distinct_users_12m").alias("users"), "last_run_date", "business_unit", "owner", "schedule_flag", "schedule_frequency", "decision_critical", "complexity_score", "tool", "semantic_container")


def cadence(frequency: Column) -> Column:
    return F.coalesce(F.nullif(F.initcap(F.trim(frequency)), F.lit("")), F.lit("Ad hoc"))


def business_unit() -> Column:
    return F.coalesce(F.nullif(F.col("business_unit"), F.lit("")), F.lit("Unassigned"))


def users_of(members: DataFrame, metrics: DataFrame, reports: DataFrame) -> DataFrame:
    """(candidate_id, business_unit, users): what consumers_of says of users, alone."""
    own = members.join(metrics.select("metric_id", F.explode("report_ids").alias("report_id")), "metric_id").select("candidate_id", "report_id").distinct()
    r = own.join(reports.select("report_id", business_unit().alias("business_unit"), "distinct_users_12m"), "report_id")
    return r.groupBy("candidate_id", "business_unit").agg(F.sum("distinct_users_12m").alias("users"))


def consumers_of(reports: DataFrame, weights: DataFrame) -> DataFrame:
    """(candidate_id, business_unit, users, report_count, scheduled_share, cadence, top_reports)."""
    r = reports.withColumn("business_unit", business_unit()).join(weights.select("report_id", "weight"), "report_id", "left")
    keys = ["candidate_id", "business_unit"]
    out = r.groupBy(*keys).agg(F.sum("users").alias("users"), F.count("*").alias("report_count"), F.avg(F.col("schedule_flag").cast("int")).alias("scheduled_share"))
    mode = modal_first_seen(r.where("schedule_flag").withColumn("c", cadence(F.col("schedule_frequency"))), keys, "c", "report_id", "cadence").drop("votes")
    ranked = r.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.round(F.coalesce("weight", F.lit(0.0)), 9)), "report_id"))).where("at <= 5")
    top = ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "report_id"))), lambda x: x["report_id"]).alias("top_reports"))
    return out.join(mode, keys, "left").join(top, keys).na.fill("Ad hoc", ["cadence"])


def attributes_of(members: DataFrame, metrics: DataFrame, columns: DataFrame, edges: DataFrame) -> DataFrame:
    """(candidate_id, column_fqn, role, confidence, ...): a column is an operand if any metric of the candidate has it as one."""
    m = members.join(metrics.select("metric_id", "operand_columns", "filter_columns"), "metric_id")
    both = m.select("candidate_id", F.lit("operand").alias("role"), F.explode("operand_columns").alias("column_fqn")).union(m.select("candidate_id", F.lit("filter"), F.explode("filter_columns")))
    one = both.groupBy("candidate_id", "column_fqn").agg(F.max("role").alias("role"))
    sure = edges.groupBy("column_fqn").agg(F.max("confidence").alias("confidence"))
    c = columns.select("column_fqn", "table_fqn", F.col("column").alias("name"), "data_type", "definition", "business_term", F.col("classification").alias("sensitivity"), "pii_flag", "steward", "nullable", "certification_status", "quality_score", "term_status", "term_id")
    return one.join(c, "column_fqn").join(sure, "column_fqn", "left").na.fill(0.0, ["confidence"]).withColumn("credit", definition_credit(F.col("term_status"), F.col("business_term"), F.col("definition")))


def conflicts_of(members: DataFrame, m: Metrics) -> DataFrame:
    """(a, b, steward, n): conflicts counted by the candidates of either side and by the steward who decides."""
    of = m.metrics.select("metric_id", "steward").join(members.groupBy("metric_id").agg(F.array_sort(F.collect_set("candidate_id")).alias("ids")), "metric_id", "left")
    mark = F.to_json(F.struct(F.coalesce("ids", F.array().cast("array<string>")).alias("ids"), F.coalesce("steward", F.lit("")).alias("steward")))
    read = lambda c: F.from_json(c, "ids array<string>, steward string")
    x = tally(m.links, of.select("metric_id", mark.alias("mark"))).select(read("a").alias("x"), read("b").alias("y"), "n")
    return x.groupBy(F.col("x.ids").alias("a"), F.col("y.ids").alias("b"), F.coalesce(F.nullif(F.col("x.steward"), F.lit("")), F.col("y.steward"), F.lit("")).alias("steward")).agg(F.sum("n").alias("n"))


def owner_and_steward(members: DataFrame, metrics: DataFrame, sources: DataFrame, domains: DataFrame) -> DataFrame:
    """(candidate_id, owner, steward): the dominant domain's owner, else the tables' majority; stewards that the catalog
    confirms count twice, tables' once, suggestions only if nothing else is there."""
    m = members.join(metrics.select("metric_id", "domain", "steward", "steward_rule"), "metric_id")
    dominant = majority(m.where("domain <> ''"), ["candidate_id"], "domain", "domain").drop("votes").join(domains.select("domain", F.nullif(F.col("owner"), F.lit("")).alias("domain_owner")), "domain", "left")
    owners = majority(sources.where("owner <> ''"), ["candidate_id"], "owner", "table_owner").drop("votes")
    state = steward_state(F.col("steward_rule"), F.col("steward"))
    votes = sources.where("steward <> ''").select("candidate_id", "steward").union(m.where(state == "confirmed").select("candidate_id", F.explode(F.array("steward", "steward"))))
    sure = majority(votes, ["candidate_id"], "steward", "sure").drop("votes")
    maybe = majority(m.where(state == "suggested"), ["candidate_id"], "steward", "maybe").drop("votes")
    out = members.select("candidate_id").distinct()
    for df in (dominant, owners, sure, maybe):
        out = out.join(df, "candidate_id", "left")
    return out.select("candidate_id", F.coalesce("domain", F.lit("")).alias("domain"), F.coalesce("domain_owner", "table_owner", F.lit("")).alias("owner"), F.coalesce("sure", "maybe", F.lit("")).alias("steward"))


def propose_names(members: DataFrame, metrics: DataFrame, heads: DataFrame, domains: DataFrame) -> DataFrame:
    """(candidate_id, proposed_name): subjects of the four heaviest metrics' labels, a noun, and the grain."""
    m = members.join(metrics.select("metric_id", "usage_weight", "aggregation", F.coalesce(F.get("labels", 0), F.col("canonical_name")).alias("label")), "metric_id")
    m = m.withColumn("at", F.row_number().over(Window.partitionBy("candidate_id").orderBy(F.desc(F.round("usage_weight", 9)), "metric_id"))).where("at <= 4")
    words = m.select("candidate_id", "at", F.posexplode(F.split(F.lower(F.regexp_replace("label", "_", " ")), r"\s+")).alias("pos", "w")).where((F.length("w") >= 3) & ~F.col("w").isin(*GENERIC))
    first = words.groupBy("candidate_id", "w").agg(F.min(F.struct("at", "pos")).alias("first"))
    heads_of = first.groupBy("candidate_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("first", "w"))), lambda x: x["w"]), 1, 2).alias("subjects"))
    noun = m.groupBy("candidate_id").agg(F.when(F.bool_or(F.col("aggregation").isin("SUM", "AVG")), "position").otherwise("activity").alias("noun"))
    out = heads.join(noun, "candidate_id").join(heads_of, "candidate_id", "left").join(domains.select("candidate_id", "domain"), "candidate_id", "left")
    head = F.coalesce(F.nullif(F.array_join("subjects", " and "), F.lit("")), F.nullif(F.lower("domain"), F.lit("")), F.lit("metrics"))
    title = S.title_case(F.concat(head, F.lit(" "), "noun"))
    name = F.when(F.col("grain") != "unknown", F.concat(title, F.lit(" by "), F.lower("grain"))).otherwise(title)
    return out.select("candidate_id", F.when(F.col("name_hint") != "", F.col("name_hint")).otherwise(name).alias("proposed_name"))


def gaps(c: Candidates, m: Metrics, quarantine: DataFrame) -> DataFrame:
    """(candidate_id, gap, n): what a candidate lacks, counted: definitions, stewards, readable calculations, resolved
    lineage, sure lineage, approved terms, confirmed stewards."""
    a = c.attributes
    count = lambda df, name: df.groupBy("candidate_id").agg(F.count("*").alias("n")).select("candidate_id", F.lit(name).alias("gap"), "n")
    own = c.members.join(m.metrics.select("metric_id", "opaque", "steward", "steward_rule"), "metric_id")
    lost = c.members.join(m.members.select("kpi_id", "metric_id"), "metric_id").join(quarantine.select("kpi_id", "raw_reference", "reason"), "kpi_id")
    parts = [
        count(a.where("role = 'operand' and definition = ''"), "definition"),
        count(a.where("steward = ''"), "steward"),
        count(own.where("opaque"), "opaque"),
        count(lost, "unresolved"),
        count(a.where((F.col("confidence") > 0) & (F.col("confidence") < PROBABLE)), "probable"),
        count(a.where("term_status = 'draft'").select("candidate_id", "business_term").distinct(), "draft term"),
        count(a.where("term_status = 'retired'").select("candidate_id", "business_term").distinct(), "retired term"),
        count(own.where(steward_state(F.col("steward_rule"), F.col("steward")) == "suggested"), "suggested steward"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def head_values(heads: DataFrame, members: DataFrame, sources: DataFrame, m: Metrics, g: Graph) -> DataFrame:
    """heads with domain, owner, steward, proposed name, ambiguity of grain and number of metrics."""
    roles = owner_and_steward(members, m.metrics, sources, g.domains)
    names = propose_names(members, m.metrics, heads, roles)
    ambiguous = G.ambiguity(members.join(m.metrics.select("metric_id", "grain"), "metric_id"), "candidate_id", "grain").withColumnRenamed("ambiguity", "grain_ambiguity")
    n = members.groupBy("candidate_id").agg(F.count("*").alias("metric_count"))
    return heads.join(roles, "candidate_id").join(names, "candidate_id").join(ambiguous, "candidate_id").join(n, "candidate_id")


def assemble(heads: DataFrame, members: DataFrame, m: Metrics, g: Graph, weights: DataFrame, keep=keep) -> Candidates:
    """Satellites and head values of given candidates."""
    members = keep(members)
    sources, reports, attributes = together(keep, sources_of(members, m.metrics, g.tables), report_coverage(members, m.metrics, g.reports), attributes_of(members, m.metrics, g.columns, g.edges))
    out = head_values(heads, members, sources, m, g)
    return Candidates(keep(out), members, sources, consumers_of(reports, weights), reports, attributes, m, keep)


def generate(m: Metrics, g: Graph, weights: DataFrame, run_id: str, resolution: float = RESOLUTION, keep=keep) -> Candidates:
    """Generated candidates with all that belongs to them."""
    heads, members = generate_members(m, g, run_id, resolution, keep)
    return assemble(heads, members, m, g, weights, keep)


def generated_heads(m: Metrics, g: Graph, run_id: str, resolution: float = RESOLUTION, keep=keep) -> DataFrame:
    """The heads of generate, without the satellites that they don't read."""
    heads, members = generate_members(m, g, run_id, resolution, keep)
    members = keep(members)
    return head_values(keep(heads), members, keep(sources_of(members, m.metrics, g.tables)), m, g)


def generate_members(m: Metrics, g: Graph, run_id: str, resolution: float = RESOLUTION, keep=keep) -> tuple[DataFrame, DataFrame]:
    """(heads, members): communities without shared dimensions show which tables are hubs; without hubs they are the candidates.

    Hubs become entity masters, and units that lead the use of several candidates get composites.
    """
    both = keep(bipartite(m, g.edges))
    domains = m.metrics.select("metric_id", "domain")
    shared = conformed(both, g.tables)
    first = detect(both, project(both, domains, shared), shared, resolution, keep)
    hub = keep(hubs(both, first, shared))
    found = keep(detect(both, project(both, domains, hub), hub, resolution, keep))
    heads, members = split_by_grain(found, m.metrics, run_id)
    more_heads, more = entity_masters(hub, both, g.tables, run_id)
    heads, members = keep(heads.unionByName(more_heads)), keep(members.union(more))
    comp_heads, comp = composites(heads, members, users_of(members, m.metrics, g.reports), m.metrics, run_id, keep)
    return heads.unionByName(comp_heads), members.union(comp)


def sweep(both: DataFrame, edges: DataFrame, excluded: DataFrame | None = None, keep=keep) -> DataFrame:
    """(resolution, communities, largest, singletons) for each resolution of SWEEP."""
    out = None
    for r in SWEEP:
        sizes = detect(both, edges, excluded, r, keep).groupBy("community").agg(F.count("*").alias("n"))
        one = sizes.agg(F.count("*").alias("communities"), F.max("n").alias("largest"), F.count_if(F.col("n") == 1).alias("singletons")).select(F.lit(r).alias("resolution"), "communities", "largest", "singletons")
        out = one if out is None else out.union(one)
    return out


def usage_coverage(ranked: DataFrame, members: DataFrame, metrics: DataFrame, top: int = 20) -> DataFrame:
    """One row: weight of the metrics in the first `top` candidates (candidate_id, rank) over all weight."""
    inside = ranked.where(F.col("rank") <= top).join(members, "candidate_id").select("metric_id").distinct()
    total = metrics.agg(F.sum("usage_weight").alias("all"))
    own = metrics.join(inside, "metric_id", "left_semi").agg(F.coalesce(F.sum("usage_weight"), F.lit(0.0)).alias("own"))
    return own.crossJoin(total).select((F.when(F.col("all") > 0, F.col("own") / F.col("all")).otherwise(0.0)).alias("coverage"))  # one row each


def coverage_gate(coverage: float | None, retuned: bool = False, floor: float = 0.50) -> str:
    """pass, fail, not_assessed, or passed after retune."""
    if coverage is None:
        return "not_assessed"
    return "fail" if coverage < floor else "passed after retune" if retuned else "pass"


def retune(run, coverage_of, resolutions: tuple[float, ...] = SWEEP, floor: float = 0.50):
    """(result, resolution, coverage, tried): clusters again at other resolutions while coverage is below the floor.

    run(resolution) gives a result, coverage_of(result) its coverage; the best is kept and no setting changes.
    """
    tried = []
    for r in dict.fromkeys((RESOLUTION, *resolutions)):
        result = run(r)
        tried.append((coverage_of(result), -abs(r - RESOLUTION), r, result))
        if tried[0][0] >= floor:
            break
    best = max(tried, key=lambda x: x[:2])
    return best[3], best[2], best[0], [(r, c) for c, _, r, _ in tried]
