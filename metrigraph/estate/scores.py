"""Archetypes, tiers, thirteen features with evidence, dimensions, gates and status of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrigraph.estate.candidates import Candidates
from metrigraph.estate.graph import Graph
from metrigraph.estate.metrics import Metrics
from metrigraph.functions import scalars as S
from metrigraph.operators.relational import majority
from metrigraph.operators.resolve import PROBABLE

# Archetypes in order with the score that wins, hints, weights of dimensions and features, gates.
ARCHETYPES = {"Entity Master": 0.55, "Reference Data": 0.60, "Event Stream": 0.60, "Metric / KPI": 0.55, "Feature Store": 0.45, "Insight / Recommendation": 0.45}
TERM_HINTS, REPORT_HINTS = "feature|model|score|propensity|prediction|risk score", "model|propensity|predict|score|forecast|churn"
RANK_HINTS = r"rank\(|rank_|row_number|topn|percentile|ntile|dense_rank"
REFERENCE_ROWS = 10_000
DIMENSIONS = {"demand": 0.35, "consolidation": 0.30, "feasibility": 0.25, "risk": -0.10}
FEATURES = {
    "demand": {"usage_weight": 0.50, "consumer_breadth": 0.30, "cadence": 0.20},
    "consolidation": {"reports_retirable": 0.50, "variants_collapsed": 0.30, "conflicts_surfaced": 0.20},
    "feasibility": {"lineage_completeness": 0.35, "definition_coverage": 0.25, "source_health": 0.25, "calculation_determinism": 0.15},
    "risk": {"sensitivity": 0.40, "grain_ambiguity": 0.30, "conflict_load": 0.30},
}
RELATIVE = {"usage_weight": "usage_weight", "consumer_breadth": "consumer_breadth", "reports_retirable": "reports_retirable", "variants_collapsed": "variants_collapsed", "conflicts_surfaced": "conflicts_all"}
DISPOSITION_WEIGHT = {"retire": 1.0, "merge": 0.8, "keep": 0.5, "migrate": 0.3}
CERTIFICATION = {"certified": 1.0, "endorsed": 1.0, "approved": 1.0, "promoted": 0.8, "candidate": 0.5, "proposed": 0.5, "draft": 0.3, "deprecated": 0.0}
NO_CERTIFICATION, TRUST_CERTIFIED, TRUST_QUALITY = 0.4, 0.6, 0.4
GATE_USERS, GATE_LINEAGE, GATE_AMBIGUITY = 2, 0.60, 0.30


def _of(table: dict, key: Column, default: float) -> Column:
    return F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in table.items()], F.lit(default))


def _share(holds: Column) -> Column:
    return F.coalesce(F.avg(F.when(holds, 1.0).otherwise(0.0)), F.lit(0.0))


def archetype_scores(c: Candidates, m: Metrics) -> DataFrame:
    """(candidate_id, entity, reference, event, metric, feature, insight): six scores from shares over metrics, tables,
    attributes and reports. Each input is aggregated once."""
    own = c.members.join(m.metrics.select("metric_id", "aggregation", "shape", "sample_expression"), "metric_id")
    agg = F.coalesce(F.nullif(F.col("aggregation"), F.lit("")), F.lit("NONE"))
    mix = own.groupBy("candidate_id").agg(
        F.count("*").alias("metrics"),
        _share(agg == "COUNT DISTINCT").alias("distinct"),
        _share(agg.isin("COUNT", "AVG")).alias("counted"),
        _share(agg.isin("SUM", "AVG", "MAX", "MIN", "RATIO")).alias("aggregated"),
        _share(F.col("shape").contains("case(")).alias("cases"),
        _share(F.lower("sample_expression").rlike(RANK_HINTS)).alias("ranks"),
    )
    src = c.sources.groupBy("candidate_id").agg(
        F.bool_or(F.col("has_key") & (F.col("measure_count") < 2)).alias("hub_key"),
        _share((F.col("row_count") > 0) & (F.col("row_count") <= REFERENCE_ROWS)).alias("small"),
        _share(F.col("measure_count") == 0).alias("bare"),
        F.count_if(F.col("measure_count") >= 2).alias("facts"),
    )
    hint = F.lower("business_term").rlike(TERM_HINTS) | F.lower("definition").rlike(TERM_HINTS)
    att = c.attributes.groupBy("candidate_id").agg(
        F.count_if(F.col("role") == "operand").alias("operands"),
        F.bool_or(F.lower("data_type").contains("timestamp") | F.col("name").endswith("_ts")).alias("stamped"),
        F.count_if(hint).alias("terms"),
    )
    rep = c.reports.groupBy("candidate_id").agg(F.count_if(F.lower("report_name").rlike(REPORT_HINTS)).alias("predictive"))
    x = c.heads.select("candidate_id", "origin", "grain", "reuse").join(mix, "candidate_id", "left").join(src, "candidate_id", "left").join(att, "candidate_id", "left").join(rep, "candidate_id", "left")
    x = x.na.fill(0).na.fill(0.0).na.fill(False)
    one = lambda b, v: F.when(b, v).otherwise(0.0)
    entity = F.when(F.col("origin") == "entity_master", 0.95).otherwise(F.least(F.lit(0.99), one(F.col("hub_key"), 0.35) + 0.45 * F.col("distinct") + one(F.col("reuse") >= 3, 0.25)))
    reference = F.when(F.col("facts").isNull() | (F.col("small") + F.col("bare") + F.col("facts") == 0) & ~F.col("hub_key"), 0.0).otherwise(F.least(F.lit(0.99), 0.4 * F.col("small") + 0.3 * F.col("bare") + one(F.col("operands") == 0, 0.3)))
    event = F.least(F.lit(0.99), one(F.col("grain").isin("Event", "Transaction"), 0.55) + one(F.col("stamped"), 0.2) + 0.25 * F.col("counted"))
    base = F.when(F.col("metrics") < 3, 0.25).otherwise(0.6) + F.when(F.col("facts").between(1, 2), 0.2).when(F.col("facts") > 2, 0.1).otherwise(0.0)
    metric = F.greatest(F.lit(0.0), F.least(F.lit(0.95), base + 0.15 * F.col("aggregated") - one(F.col("grain") == "unknown", 0.15)))
    feature = F.least(F.lit(0.95), F.least(F.lit(0.5), 0.12 * F.col("terms")) + F.least(F.lit(0.45), 0.1 * F.col("predictive")))
    insight = F.least(F.lit(0.95), 0.55 * F.col("cases") + 0.45 * F.col("ranks"))
    return x.select("candidate_id", "origin", entity.alias("entity"), reference.alias("reference"), event.alias("event"), metric.alias("metric"), feature.alias("feature"), insight.alias("insight"))


def classify(scores: DataFrame) -> DataFrame:
    """(candidate_id, archetype, confidence, runner_up): the first archetype in order whose score suffices, else the best.

    Confidence is the margin over the best other; below 0.6 that one is shown too. Entity masters are theirs with 0.9.
    """
    names = list(ARCHETYPES)
    cols = [F.col(c) for c in ("entity", "reference", "event", "metric", "feature", "insight")]
    all_ = F.array(*[F.struct(v.alias("v"), F.lit(-i).alias("o"), F.lit(n).alias("n")) for i, (n, v) in enumerate(zip(names, cols, strict=True))])
    first = F.coalesce(*[F.when(v >= ARCHETYPES[n], F.lit(n)) for n, v in zip(names, cols, strict=True)], F.array_max(all_)["n"])
    x = scores.withColumn("all", all_).withColumn("won", first)
    x = x.withColumn("mine", F.filter("all", lambda s: s["n"] == F.col("won"))[0]["v"]).withColumn("next", F.array_max(F.filter("all", lambda s: s["n"] != F.col("won"))))
    master = F.col("origin") == "entity_master"
    margin = F.when(master, 0.9).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("mine") - F.col("next.v"))))
    x = x.withColumn("confidence", margin)
    return x.select("candidate_id", F.when(master, "Entity Master").otherwise(F.col("won")).alias("archetype"), "confidence", F.when(F.col("confidence") < 0.6, F.col("next.n")).otherwise("").alias("runner_up"))


def tiers(c: Candidates) -> DataFrame:
    """(candidate_id, tier, confidence): by origin, consumers, dependencies and number of source systems."""
    s = c.sources.where("system <> ''").groupBy("candidate_id").agg(F.count_distinct("system").alias("systems"))
    u = c.consumers.groupBy("candidate_id").agg(F.count("*").alias("units"))
    x = c.heads.select("candidate_id", "origin", "depends_on", "parent_candidate_id").join(s, "candidate_id", "left").join(u, "candidate_id", "left").na.fill(0, ["systems", "units"])
    pair = lambda t, v: F.struct(F.lit(t).alias("tier"), v.alias("confidence"))
    tier = (
        F.when(F.col("origin") == "composite", pair("Consumer-aligned", F.lit(0.9)))
        .when((F.col("units") == 1) & (F.size("depends_on") >= 2), pair("Consumer-aligned", F.lit(0.75)))
        .when(F.col("systems") <= 1, pair("Source-aligned", F.when(F.col("systems") == 1, 0.9).otherwise(0.5)))
        .when(F.col("parent_candidate_id") != "", pair("Aggregate", F.lit(0.8)))
        .otherwise(pair("Aggregate", F.least(F.lit(0.95), 0.55 + 0.1 * F.col("systems"))))
    )
    return x.select("candidate_id", tier.alias("t")).select("candidate_id", "t.*")


def retirable_weight(disposition: Column, keep_counts: bool = True) -> Column:
    low = F.lower(F.coalesce(F.nullif(disposition, F.lit("")), F.lit("keep")))
    return F.when((low == "keep") & F.lit(not keep_counts), 0.0).otherwise(_of(DISPOSITION_WEIGHT, low, 0.5))


def source_trust(c: Candidates, columns: DataFrame) -> DataFrame:
    """(candidate_id, table_fqn, certification, certified, columns, quality, trust) over the columns used of each source,
    or all of it if none is."""
    used = c.attributes.select("candidate_id", "column_fqn").withColumn("used", F.lit(True))
    rows = c.sources.select("candidate_id", "table_fqn").join(columns.select("table_fqn", "column_fqn", F.lower("certification_status").alias("cert"), "quality_score"), "table_fqn").join(used, ["candidate_id", "column_fqn"], "left")
    keys = ["candidate_id", "table_fqn"]
    some = rows.groupBy(*keys).agg(F.count("used").alias("n"))
    rows = rows.join(some, keys).where("used or n = 0")
    mode = majority(rows, keys, "cert", "certification").drop("votes")
    agg = rows.groupBy(*keys).agg(F.count("*").alias("columns"), F.count_if(_of(CERTIFICATION, F.col("cert"), NO_CERTIFICATION) >= 0.8).alias("certified"), F.coalesce(F.avg(F.when(F.col("quality_score") != 0, S.quality_unit(F.col("quality_score")))), F.lit(0.0)).alias("quality"))
    return agg.join(mode, keys).withColumn("trust", TRUST_CERTIFIED * _of(CERTIFICATION, F.col("certification"), NO_CERTIFICATION) + TRUST_QUALITY * F.col("quality"))


def raw_features(c: Candidates, m: Metrics, g: Graph, weights: DataFrame) -> DataFrame:
    """One row a candidate: the values of all features before normalisation, and conflicts_all. Absent input scores low."""
    r = c.reports.join(weights.select("report_id", "weight"), "report_id", "left")
    rep = r.groupBy("candidate_id").agg(
        F.coalesce(F.sum("weight"), F.lit(0.0)).alias("usage_weight"),
        F.avg(F.col("schedule_flag").cast("int")).alias("cadence"),
        F.coalesce(F.sum(F.when(F.col("covered") == F.col("all"), retirable_weight(F.col("disposition")))), F.lit(0.0)).alias("reports_retirable"),
    )
    con = c.consumers.where("business_unit <> ''").groupBy("candidate_id").agg(F.count("*").cast("double").alias("consumer_breadth"), F.count_if(F.col("users") >= GATE_USERS).alias("qualifying"))
    own = c.members.join(m.metrics.select("metric_id", "kpi_count"), "metric_id").groupBy("candidate_id").agg(F.sum(F.greatest(F.col("kpi_count") - 1, F.lit(0))).cast("double").alias("variants_collapsed"), F.count("*").alias("metrics"))
    con2 = c.touched.groupBy("candidate_id").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).cast("double").alias("conflicts_surfaced"), F.sum("n").cast("double").alias("conflicts_all"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("spanning"))
    kpi = c.members.join(m.members.select("kpi_id", "metric_id"), "metric_id").select("candidate_id", "kpi_id").distinct()
    edge = g.edges.where("role = 'operand'").groupBy("kpi_id").agg(F.count_if(F.col("confidence") >= PROBABLE).alias("sure"), F.count("*").alias("edges"))
    lost = g.quarantine.where("role = 'operand'").groupBy("kpi_id").agg(F.count("*").alias("lost"))
    k = kpi.join(edge, "kpi_id", "left").join(lost, "kpi_id", "left").join(g.kpis.select("kpi_id", "parse_status"), "kpi_id", "left").na.fill(0, ["sure", "edges", "lost"])
    kp = k.groupBy("candidate_id").agg((F.sum("edges") + F.sum("lost")).alias("refs"), F.sum("sure").alias("sure"), _share(F.col("parse_status") == "PARSED").alias("calculation_determinism"))
    kp = kp.select("candidate_id", F.when(F.col("refs") > 0, F.col("sure") / F.col("refs")).otherwise(0.0).alias("lineage_completeness"), "calculation_determinism")
    rank = _of(S.SENSITIVITY_RANK, F.lower(F.coalesce(F.nullif(F.col("sensitivity"), F.lit("")), F.lit("internal"))), 0.35)
    att = c.attributes.groupBy("candidate_id").agg(
        F.avg(F.when(F.col("role") == "operand", F.col("credit"))).alias("definition_coverage"),
        F.greatest(F.max(rank), F.when(F.bool_or("pii_flag"), 0.7).otherwise(0.0)).alias("sensitivity"),
    )
    dead = (F.col("lifecycle_status") == "sunset") & (F.col("successor_system") == "")
    other = _share(~F.col("sor_flag"))
    src = c.sources.groupBy("candidate_id").agg(F.count_if(dead).alias("dead"), F.when(F.bool_or(dead), 0.0).when(F.bool_and("sor_flag"), 1.0).otherwise(F.greatest(F.lit(0.5), 1 - 0.5 * other)).alias("source_health"))
    x = c.heads.select("candidate_id", "grain_ambiguity")
    for df in (rep, con, own, con2, kp, att, src):
        x = x.join(df, "candidate_id", "left")
    x = x.na.fill(1.0, ["sensitivity"]).na.fill(0.0).na.fill(0)
    return x.withColumn("conflict_load", F.least(F.lit(1.0), F.col("spanning") / F.greatest(F.col("metrics"), F.lit(1))))


def features(raw: DataFrame) -> DataFrame:
    """(candidate_id, dimension, feature, value, normalized, weight, contribution, reference, reference_id) in long form.

    Run-relative features are logarithmic shares of the run's maximum, which names the candidate that set it; the
    maxima are one row.
    """
    best = raw.agg(*[F.max(F.struct(F.col(of).cast("double").alias("v"), F.col("candidate_id").alias("id"))).alias(f"_{f}") for f, of in RELATIVE.items()])
    x = raw.crossJoin(F.broadcast(best))
    rows = []
    for dim, fs in FEATURES.items():
        for f, w in fs.items():
            value = F.col(f).cast("double")
            most = F.when(F.col(f"_{f}.v") > 0, F.col(f"_{f}.v")).otherwise(1.0) if f in RELATIVE else F.lit(0.0)
            ref = F.when(F.col(f"_{f}.v") > 0, F.col(f"_{f}.id")).otherwise("") if f in RELATIVE else F.lit("")
            unit = S.log_ratio(value, most) if f in RELATIVE else F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
            rows.append(F.struct(F.lit(dim).alias("dimension"), F.lit(f).alias("feature"), value.alias("value"), unit.alias("normalized"), F.lit(w).alias("weight"), (100.0 * unit * w).alias("contribution"), most.alias("reference"), ref.alias("reference_id")))
    return x.select("candidate_id", F.explode(F.array(*rows)).alias("f")).select("candidate_id", "f.*")


def dimension_scores(long: DataFrame) -> DataFrame:
    """(candidate_id, demand, consolidation, feasibility, risk, composite)."""
    score = lambda d: (100.0 * F.sum(F.when(F.col("dimension") == d, F.col("normalized") * F.col("weight"))) / F.sum(F.when(F.col("dimension") == d, F.col("weight")))).alias(d)
    out = long.groupBy("candidate_id").agg(*[score(d) for d in DIMENSIONS])
    composite = sum((F.lit(w) * F.col(d) for d, w in DIMENSIONS.items()), F.lit(0.0))
    return out.withColumn("composite", composite).withColumn("band", S.composite_band(F.col("composite")))


def gates(raw: DataFrame, strict: bool = False, confirmed: Column | None = None) -> DataFrame:
    """(candidate_id, g1, g2, g3, g4, status). strict: a consumer must be confirmed besides."""
    g1 = F.col("qualifying") > 0
    if strict:
        g1 = g1 & F.coalesce(confirmed, F.lit(False))
    x = raw.select("candidate_id", g1.alias("g1"), (F.col("lineage_completeness") >= GATE_LINEAGE).alias("g2"), (F.col("grain_ambiguity") <= GATE_AMBIGUITY).alias("g3"), (F.col("dead") == 0).alias("g4"))
    return x.withColumn("status", F.when(~F.col("g4"), "Blocked").when(~(F.col("g1") & F.col("g2") & F.col("g3")), "Exploratory").otherwise("Proposed"))


def evidence(c: Candidates, m: Metrics, weights: DataFrame) -> DataFrame:
    """(candidate_id, feature, kind, evidence_id, contribution): rows behind the additive features; those without any
    get a negative row, so that every feature has evidence. Conflicts are counted by the steward who decides them."""
    r = c.reports.join(weights.select("report_id", "weight"), "report_id", "left")
    row = lambda df, f, kind, i, v: df.select("candidate_id", F.lit(f).alias("feature"), F.lit(kind).alias("kind"), i.alias("evidence_id"), v.cast("double").alias("contribution"))
    own = c.members.join(m.metrics.select("metric_id", "kpi_count", "opaque"), "metric_id")
    met = c.touched.groupBy("candidate_id", "steward", "inside").agg(F.sum("n").alias("n"))
    rows = row(r, "usage_weight", "report", F.col("report_id"), F.coalesce("weight", F.lit(0.0)))
    for part in (
        row(c.consumers.where("business_unit <> ''"), "consumer_breadth", "business_unit", F.col("business_unit"), F.lit(1.0)),
        row(r.where("schedule_flag"), "cadence", "report", F.col("report_id"), F.lit(None)),
        row(r.where("covered = all"), "reports_retirable", "report", F.col("report_id"), retirable_weight(F.col("disposition"))),
        row(own.where("kpi_count > 1"), "variants_collapsed", "metric", F.col("metric_id"), F.col("kpi_count") - 1),
        row(met.where("inside"), "conflicts_surfaced", "conflicts", F.col("steward"), F.col("n")),
        row(met.where("not inside"), "conflict_load", "conflicts", F.col("steward"), F.lit(None)),
        row(c.attributes.where("role = 'operand'"), "lineage_completeness", "column", F.col("column_fqn"), F.lit(None)),
        row(c.attributes.where("role = 'operand'"), "definition_coverage", "column", F.col("column_fqn"), F.col("credit")),
        row(c.sources, "source_health", "table", F.col("table_fqn"), F.lit(None)),
        row(own.where("opaque"), "calculation_determinism", "metric", F.col("metric_id"), F.lit(None)),
        row(c.attributes.where("pii_flag"), "sensitivity", "column", F.col("column_fqn"), F.lit(None)),
    ):
        rows = rows.union(part)
    every = c.heads.select("candidate_id").crossJoin(F.broadcast(rows.sparkSession.createDataFrame([(f,) for fs in FEATURES.values() for f in fs], "feature string")))  # thirteen features
    none = every.join(rows.select("candidate_id", "feature").distinct(), ["candidate_id", "feature"], "left_anti")
    return rows.union(none.select("candidate_id", "feature", F.lit("none"), F.lit(""), F.lit(0.0)))


def missing_evidence(long: DataFrame, rows: DataFrame) -> DataFrame:
    """(candidate_id, feature) of features without a row of evidence: must be empty before anything is published."""
    return long.select("candidate_id", "feature").join(rows.select("candidate_id", "feature").distinct(), ["candidate_id", "feature"], "left_anti")


def evidence_summary(rows: DataFrame) -> DataFrame:
    """(candidate_id, feature, rows, negatives, contribution)."""
    return rows.groupBy("candidate_id", "feature").agg(F.count("*").alias("rows"), F.count_if(F.col("kind") == "none").alias("negatives"), F.coalesce(F.sum("contribution"), F.lit(0.0)).alias("contribution"))


def score(c: Candidates, m: Metrics, g: Graph, weights: DataFrame, keep=lambda df: df) -> DataFrame:
    """One row a candidate: archetype, tier, dimensions, composite, band, gates, status."""
    raw = keep(raw_features(c, m, g, weights))
    kinds = classify(archetype_scores(c, m)).withColumnRenamed("confidence", "archetype_confidence")
    level = tiers(c).withColumnRenamed("confidence", "tier_confidence")
    return kinds.join(level, "candidate_id").join(dimension_scores(features(raw)), "candidate_id").join(gates(raw), "candidate_id")
