"""Conflicts counted by classes of labels against the pairs themselves."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from metrigraph.estate import candidates, metrics, programme
from metrigraph.storage import keep


def metric(i, labels, column, shape="x", text=None, steward=""):
    return (f"M{i:02}", labels, [column], [f"SUM|{shape}"] if shape else [], [text or f"t{i}"], "SUM", f"s{i}", [], [], 1.0, [f"R{i}"], steward, "e", f"n{i}", False)


FIELDS = "metric_id string, labels array<string>, operand_columns array<string>, raw_shapes array<string>, texts array<string>, aggregation string, shape string, filter_columns array<string>, null_rules array<string>, usage_weight double, report_ids array<string>, steward string, sample_expression string, canonical_name string, opaque boolean"
ROWS = [
    *[metric(i, ["Net Revenue"], f"d.t.c{i}", f"x{i}", steward="Ada" if i % 3 else "") for i in range(6)],
    *[metric(i, ["Revenue, Net", "Income"], f"d.t.c{i}", f"x{i}", steward="Ben" if i % 2 else "") for i in range(6, 9)],
    metric(9, ["Net Revenue"], "d.t.c9", "x1"),  # wrote what metric 1 wrote
    metric(10, ["Net Revenue"], "d.t.c10", "x10", "t2"),
    metric(11, ["Customer Accounts Opened Amount"], "d.t.one", "x11"),  # near in label, of another key: only the column unites them
    metric(12, ["Customer Accounts Opened Amounts Y"], "d.t.one", "x12"),
    metric(13, ["Customer Accounts Opened Amounts Y"], "d.t.other", "x13"),
    metric(14, [], "d.t.c1", "x14"),
    metric(15, ["Turnover"], "d.t.c15", "x15"),
]


@pytest.fixture(scope="module")
def made(spark):
    rows = keep(spark.createDataFrame(ROWS, FIELDS))
    glossary = spark.createDataFrame([("T1", "Turnover", "", "", "", "")], "term_id string, term string, definition string, domain string, steward string, status string")
    return metrics.Metrics(rows, rows.select("metric_id"), rows.select("metric_id"), glossary, keep)


def test_counts_are_those_of_the_pairs(made):
    pairs = [(r["metric_id_a"], r["metric_id_b"]) for r in made.conflicts.collect()]
    assert len(pairs) > 30 and ("M01", "M09") not in pairs and ("M02", "M10") not in pairs
    want = Counter(x for p in pairs for x in p)
    assert {r["metric_id"]: r["n_links"] for r in metrics.link_counts(made.links).collect()} == want
    marks = {r[0]: str(int(r[0][1:]) % 3) for r in ROWS}
    found = metrics.tally(made.links, made.metrics.select("metric_id", (F.substring("metric_id", 2, 2).cast("int") % 3).cast("string").alias("mark")))
    assert {(r["a"], r["b"]): r["n"] for r in found.collect()} == Counter((marks[a], marks[b]) for a, b in pairs)


def test_candidates_count_conflicts_once_each(spark, made):
    own = {"A": {f"M{i:02}" for i in range(5)}, "B": {f"M{i:02}" for i in range(3, 12)}, "All": {r[0] for r in ROWS}}
    members = spark.createDataFrame([(c, x) for c, s in own.items() for x in s], "candidate_id string, metric_id string")
    c = candidates.Candidates(None, members, None, None, None, None, made, keep)
    want, best = Counter(), Counter()
    for r in made.conflicts.select("metric_id_a", "metric_id_b", "steward").collect():
        a, b, s = r
        for k, v in own.items():
            if a in v or b in v:
                want[(k, s, a in v and b in v)] += 1
        best[next(k for k in ("B", "A", "All") if a in own[k] or b in own[k])] += 1
    got = c.touched.groupBy("candidate_id", "steward", "inside").agg(F.sum("n").alias("n")).collect()
    assert {tuple(r)[:3]: r["n"] for r in got} == want
    scores = spark.createDataFrame([("A", 2.0), ("B", 3.0), ("All", 1.0)], "candidate_id string, composite double")
    assert {r["candidate_id"]: r["own"] for r in programme.attribute_conflicts(c, scores).collect()} == best


def test_pairs_are_made_only_when_asked_for(made):
    fresh = metrics.Metrics(made.metrics, made.members, made.sure, made.glossary, keep)
    metrics.link_counts(fresh.links).collect()
    assert "conflicts" not in vars(fresh) and "_found" not in vars(fresh)


def test_query_of_conflicts_makes_no_pairs(made, monkeypatch):
    from metrigraph.plans import estate_bank

    fresh = metrics.Metrics(made.metrics, made.members, made.sure, made.glossary, keep)
    monkeypatch.setattr(estate_bank, "_built", lambda spark, sf: (None, fresh))
    got = estate_bank.queries()["metric_conflicts"](None, "").collect()
    assert "conflicts" not in vars(fresh) and "_found" not in vars(fresh)
    want = Counter(x for r in made.conflicts.collect() for x in (r["metric_id_a"], r["metric_id_b"]))
    assert {r["metric_id"]: r["n_links"] for r in got} == want
    labels = {r[0]: r[1] for r in ROWS}
    assert all((x["class_id"] == y["class_id"]) == (labels[x["metric_id"]] == labels[y["metric_id"]]) for x in got for y in got)
