"""Every label of a metric finds its conflicts, and every report of a metric that conflicts is exposed."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_conflicts import FIELDS, metric

from metrigraph.estate import candidates, metrics, programme
from metrigraph.storage import keep

ROWS = [
    metric(1, ["Alpha", "Bravo", "Charlie", "Net Revenue"], "d.t.c1", "x1"),
    metric(2, ["Delta", "Echo", "Foxtrot", "Golf", "Revenue, Net"], "d.t.c2", "x2"),
    metric(3, ["Hotel", "India", "Juliet", "Turnover"], "d.t.c3", "x3"),
    metric(4, ["Turnover"], "d.t.c4", "x4"),
    metric(5, ["Kilo", "Lima", "Mike", "Monthly Recurring Subscription Income Europe"], "d.t.one", "x5"),  # only the column unites it with the next
    metric(6, ["November", "Oscar", "Papa", "Monthly Recurring Subscription Incomee Europe"], "d.t.one", "x6"),
    metric(7, ["Turnover", "Juliet", "India", "Hotel"], "d.t.c7", "x7"),  # the labels of metric 3 in another order
    metric(8, ["Quebec"], "d.t.c8", "x8"),
]
PAIRS = [("M01", "M02"), ("M03", "M04"), ("M03", "M07"), ("M04", "M07"), ("M05", "M06")]


@pytest.fixture(scope="module")
def made(spark):
    rows = keep(spark.createDataFrame(ROWS, FIELDS))
    glossary = spark.createDataFrame([("T1", "Quebec", "", "", "", "")], "term_id string, term string, definition string, domain string, steward string, status string")
    return metrics.Metrics(rows, rows.select("metric_id"), rows.select("metric_id"), glossary, keep)


def test_labels_after_the_third_pair_metrics(made):
    assert sorted((r["metric_id_a"], r["metric_id_b"]) for r in made.conflicts.collect()) == PAIRS


def test_counts_see_labels_after_the_third(made):
    assert {r["metric_id"]: r["n_links"] for r in metrics.link_counts(made.links).collect()} == Counter(x for p in PAIRS for x in p)
    found = metrics.tally(made.links, made.metrics.select("metric_id", F.col("metric_id").alias("mark")))
    assert sorted((r["a"], r["b"]) for r in found.collect()) == PAIRS


def test_labels_in_another_order_are_one_class(made):
    of = {r["metric_id"]: r["class"] for r in made.links.classes.collect()}
    assert of["M03"] == of["M07"] and len(set(of.values())) == len(ROWS) - 1


def test_value_exposes_every_report_of_a_conflict(spark, made):
    ids = [f"R{i:02}" for i in range(12)]
    rows = keep(made.metrics.withColumn("report_ids", F.when(F.col("metric_id") == "M01", F.array(*map(F.lit, ids))).otherwise(F.array().cast("array<string>"))))
    m = metrics.Metrics(rows, made.members, made.sure, made.glossary, keep)
    fields = "candidate_id string, report_id string, covered long, all long, report_name string, disposition string, decision_critical boolean, complexity_score double, tool string, semantic_container string"
    reports = spark.createDataFrame([("C", i, 1, 1, "Filing", "Keep", True, 0.1, "cognos", "") for i in ids], fields)
    members = spark.createDataFrame([("C", r[0]) for r in ROWS], "candidate_id string, metric_id string")
    c = candidates.Candidates(members.select("candidate_id").distinct(), members, None, None, reports, None, m, keep)
    g = type("G", (), {"reports": reports})
    x = programme.value(c, m, g, spark.createDataFrame([("C", 1.0)], "candidate_id string, composite double"), spark.createDataFrame([("C", 1.0, "S")], "candidate_id string, points double, size string")).first()
    assert x["mis_decision"] == len(ids) * programme.RateCard().mis_decision["regulatory"]
    assert x["conflict"] > 0
