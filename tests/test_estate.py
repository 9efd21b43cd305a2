"""Operators of the estate on small cases that the query bank's SQL can't say."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from metrigraph.estate import candidates, exports, governance, grain, metrics, programme, scores, weights
from metrigraph.operators import ledger, relational, scoring
from metrigraph.plans import named


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_grains_by_each_rule(spark):
    cols = [("d", "customer_key", "VARCHAR", True), ("f", "customer_key", "VARCHAR", False), ("f", "orders_id", "INT", True), ("e", "event_ts", "TIMESTAMP", False), ("p", "x", "INT", False), ("n", "x", "INT", False), ("s", "batch_key", "INT", True), ("k", "meter_id", "INT", True)]
    tabs = [("d", "dim_customer", 0), ("f", "fct_orders", 3), ("e", "event_log", 0), ("p", "payment_line", 1), ("n", "dim_region_name", 0), ("s", "stg_orders", 0), ("k", "readings", 0)]
    c = spark.createDataFrame(cols, "table_fqn string, column string, data_type string, primary_key boolean")
    t = spark.createDataFrame(tabs, "table_fqn string, table_name string, measure_count int")
    got = {r["table_fqn"]: r["grain"] for r in grain.table_grains(c, t, ["Customer"]).collect()}
    assert got == {"d": "Customer", "f": "Customer", "e": "Event", "p": "Transaction", "n": "Region Name", "s": "Staging", "k": "Meter"}
    m = spark.createDataFrame([("a", "Customer"), ("a", "Customer"), ("a", "Meter"), ("a", "unknown"), ("b", "unknown"), ("c", "Staging"), ("c", "Event")], "k string, grain string")
    assert rows(grain.ambiguity(m, "k", "grain")) == [("a", 0.5), ("b", 1.0), ("c", 0.5)]
    assert rows(grain.finest(m, ["k"], "grain", ["Customer", "Meter"])) == [("a", "Meter"), ("b", "unknown"), ("c", "Event")]


BASE = {"labels": ["x"], "canonical_name": "x", "aggregation": "SUM", "shape": "", "operand_columns": [], "filter_columns": [], "null_rules": [], "leaves": []}
KIND = "struct<labels:array<string>,canonical_name:string,aggregation:string,shape:string,operand_columns:array<string>,filter_columns:array<string>,null_rules:array<string>,leaves:array<string>>"


@pytest.mark.parametrize(
    ("pattern", "a", "b"),
    [
        ("AGGREGATION", {"leaves": ["x"]}, {"leaves": ["x"], "aggregation": "AVG"}),
        ("THRESHOLD", {"leaves": ["x"], "shape": ">(x,lit(60))"}, {"leaves": ["x"], "shape": ">(x,lit(59))"}),
        ("NULL_HANDLING", {"leaves": ["x"], "shape": "coalesce(x)"}, {"leaves": ["x"], "shape": "x"}),
        ("NULL_HANDLING", {"leaves": ["x"], "null_rules": ["nvl"]}, {"leaves": ["x"]}),
        ("TIME_BASIS", {"leaves": ["order_date", "x"]}, {"leaves": ["ship_date", "x"]}),
        ("DENOMINATOR", {"leaves": ["a", "x"], "aggregation": "RATIO"}, {"leaves": ["b", "x"], "aggregation": "RATIO"}),
        ("EXCLUSION", {"leaves": ["x"], "filter_columns": ["t.s"]}, {"leaves": ["x"]}),
        ("OPERANDS", {"leaves": ["x"]}, {"leaves": ["y"]}),
    ],
)
def test_conflict_patterns(spark, pattern, a, b):
    df = spark.createDataFrame([(BASE | a, BASE | b)], f"a {KIND}, b {KIND}")
    assert df.select(metrics.classify_pattern()).first()[0] == pattern
    assert df.select(metrics.describe_difference(metrics.classify_pattern())).first()[0]


def test_names_never_clash(spark):
    m = spark.createDataFrame([(f"m{i}", ["Net Revenue"], g, n, f"fp{i}") for i, (g, n) in enumerate([("Customer", 9), ("Meter", 5), ("Meter", 4), ("unknown", 3), ("unknown", 2)])], "metric_id string, labels array<string>, grain string, kpi_count int, fingerprint string")
    names = [r["canonical_name"] for r in metrics.propose_names(m).orderBy("metric_id").collect()]
    assert names[0] == "net_revenue" and names[1] == "net_revenue_by_meter" and len(set(names)) == 5


def test_contradictions(spark):
    df = spark.createDataFrame([("the average price", "SUM", True), ("total of all", "SUM", False), ("whatever", "SUM", False), ("the number of customers", "COUNT DISTINCT", False)], "d string, a string, want boolean")
    assert df.where(metrics.contradicts(F.col("d"), F.col("a")) != F.col("want")).count() == 0


def test_archetypes(spark):
    s = spark.createDataFrame([("a", "community", 0.2, 0.1, 0.7, 0.9, 0.0, 0.0), ("b", "entity_master", 0.95, 0.0, 0.0, 0.0, 0.0, 0.0), ("c", "community", 0.1, 0.2, 0.1, 0.3, 0.1, 0.1)], "candidate_id string, origin string, entity double, reference double, event double, metric double, feature double, insight double")
    got = {r["candidate_id"]: (r["archetype"], round(r["confidence"], 3), r["runner_up"]) for r in scores.classify(s).collect()}
    assert got == {"a": ("Event Stream", 0.0, "Metric / KPI"), "b": ("Entity Master", 0.9, ""), "c": ("Metric / KPI", 0.1, "Reference Data")}


def test_waves():
    p = programme.Product
    items = [p("a", "Proposed", 100, 1000, 50), p("b", "Proposed", 30, 900, 40, ("a",)), p("c", "Blocked", 5, 10, 1), p("d", "Proposed", 5, 10, 1, ("c",)), p("e", "Exploratory", 200, 100, 9), p("f", "Proposed", 10, 500, 3), p("g", "Proposed", 5, 1, 1, ("h",)), p("h", "Proposed", 5, 1, 1, ("g",))]
    placed, out = programme.plan_waves(items)
    assert placed["f"] == placed["a"] == 1 and placed["b"] == 2 and placed["e"] == 3  # e exceeds any wave, so it opens its own
    assert set(out) == {"c", "d", "g", "h"} and "unscheduled c" in out["d"] and "cycle" in out["g"]
    assert "e" in programme.plan_waves(items, include_exploratory=False)[1]


def test_state_machine_and_ledger(spark, tmp_path):
    assert governance.next_status("Proposed", "Accept") == "Accepted" and governance.next_status("Blocked", "Split") is None
    for bad in (lambda: governance.next_status("Blocked", "Accept"), lambda: governance.validate_reason("Reject", ""), lambda: governance.validate_reason("Reject", "other"), lambda: governance.validate_override("tier", "x"), lambda: governance.next_status("Blocked", "CarryForward", "Accepted"), lambda: governance.check_gates("Exploratory", ("g2",), "Accept"), lambda: governance.check_gates("Exploratory", ("g2",), "AcceptWithException", ("g2",), "why", "me", "me")):
        with pytest.raises(governance.Refused):
            bad()
    assert governance.normalize_timestamp("2024-03-01T10:00:00+02:00") == "2024-03-01T08:00:00"
    book = governance.Ledger(spark, str(tmp_path / "ledger"))
    book.append("r", "c1", "Accept", "ann", "Proposed", "2024-01-01T00:00:00Z")
    book.append("r", "c2", "Reject", "ben", "Proposed", "2024-01-02T00:00:00Z", "too_small")
    book.append("r", "c1", "Reverse", "ben", "Accepted", "2024-01-03T00:00:00Z", "new_evidence")
    assert tuple(book.verify().first()) == (None, 3)
    altered = book.rows().withColumn("note", F.when(F.col("decision_id") == 2, "changed").otherwise(F.col("note")))
    assert governance.verify(altered).first()["first_break"] == 2
    assert {r["candidate_id"]: r["new_status"] for r in governance.latest(book.rows()).collect()} == {"c1": "Rejected", "c2": "Rejected"}


def test_runs_match_one_to_one(spark):
    now = spark.createDataFrame([("n1", "L1", ["a", "b"]), ("n2", "L2", ["c", "d", "e"]), ("n3", "L3", ["c", "d"]), ("n4", "L4", ["z"])], "candidate_id string, lineage_id string, metric_ids array<string>")
    before = spark.createDataFrame([("p1", "L1", ["q"]), ("p2", "L9", ["c", "d", "e"]), ("p3", "L8", ["y"])], "candidate_id string, lineage_id string, metric_ids array<string>")
    got = governance.match_runs(now, before)
    assert {(r["current_id"], r["previous_id"], r["kind"]) for r in got.collect()} == {("n1", "p1", "lineage"), ("n2", "p2", "similar"), ("n3", None, "added"), ("n4", None, "added"), (None, "p3", "removed")}
    reviewed = spark.createDataFrame([("p1", "Accepted"), ("p2", "Accepted")], "candidate_id string, status string")
    current = spark.createDataFrame([("n1", "Proposed"), ("n2", "Blocked")], "candidate_id string, status string")
    assert {(r["candidate_id"], r["status"], r["carried"]) for r in governance.carry_forward(got, reviewed, current).collect()} == {("n1", "Accepted", True), ("n2", "Blocked", False)}


def test_reestimation(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 1, (120, 4))
    y = (2 * x[:, 0] + x[:, 1] - 1.5 * x[:, 3] + 0.3 * rng.normal(size=120) > 0.8).astype(int)
    df = spark.createDataFrame([(int(a), *map(float, v)) for a, v in zip(y, x, strict=True)], "accepted int, demand double, consolidation double, feasibility double, risk double")
    got = weights.reestimate(df, dict(scores.DIMENSIONS))
    assert got.status in ("proposed", "no better") and got.coefficients[0] > 0 > got.coefficients[3] and not got.contradictions
    assert got.weights["risk"] < 0 and sum(v for k, v in got.weights.items() if k != "risk") == pytest.approx(0.9)
    assert weights.reestimate(df.limit(20), dict(scores.DIMENSIONS)).status == "insufficient"
    assert weights.tie_groups([9.0, 8.5, 7.9, 7.5, 5.0]) == [0, 0, 1, 1, 2]


def test_ranks_and_tau(spark):
    rng = random.Random(1)
    a, b = list(range(60)), list(range(60))
    rng.shuffle(b)
    df = spark.createDataFrame([(f"k{i:02}", x, y) for i, (x, y) in enumerate(zip(a, b, strict=True))], "k string, a int, b int")
    want = sum(np.sign((a[i] - a[j]) * (b[i] - b[j])) for i, j in itertools.combinations(range(60), 2)) / 1770
    assert relational.kendall_tau(df, "a", "b", "k").first()[0] == pytest.approx(want)
    assert [r["k"] for r in scoring.rank_all(df, F.col("b"), "k").orderBy("rank").collect()] == [f"k{i:02}" for i in sorted(range(60), key=lambda i: -b[i])]
    assert [scoring.upper_median(spark.createDataFrame([(x,) for x in range(n)], "v int"), "v").first()[0] for n in (1, 4, 5)] == [0, 2, 2]


def test_long_chain(spark):
    df = spark.createDataFrame([("c", i) for i in range(3000)], "chain string, i int").repartition(4)
    sealed = ledger.seal(df, "chain", ["i"], F.col("i").cast("string"))
    assert ledger.verify(sealed, "chain", "position").first()["first_break"] is None and sealed.count() == 3000


def test_router(spark):
    t = {
        "candidate": spark.createDataFrame([("C-1", "Net Revenue position", "Finance", "g", "o", "s"), ("C-2", "Meter activity", "Grid Assets", "g", "o", "s")], "candidate_id string, proposed_name string, domain string, grain string, owner string, steward string"),
        "score": spark.createDataFrame([("C-1", "Metric / KPI", "Aggregate", "Proposed", 70.0, 1.0, 1.0, 1.0, 1.0, True, True, True, True), ("C-2", "Event Stream", "Aggregate", "Blocked", 80.0, 1.0, 1.0, 1.0, 1.0, True, True, True, False)], "candidate_id string, archetype string, tier string, status string, composite double, demand double, consolidation double, feasibility double, risk double, g1 boolean, g2 boolean, g3 boolean, g4 boolean"),
        "quarantine": spark.createDataFrame([("NO_CATALOG_TABLE",)], "reason string"),
        "inventory": spark.createDataFrame([("R1", "n", "Grid Operations", "o", 5, 1, dt.date(2020, 1, 1)), ("R2", "n", "Sales", "o", 9, 1, None)], "report_id string, report_name string, business_unit string, owner string, run_count_12m int, distinct_users_12m int, last_run_date date"),
        "consumer": spark.createDataFrame([("C-2", "Sales", 4, 2, 0.5, "Daily")], "candidate_id string, business_unit string, users int, report_count int, scheduled_share double, cadence string"),
    }
    ask = lambda q: named.ask(spark, t, q, dt.date(2024, 1, 1))
    assert [r["candidate_id"] for r in ask("top 5 candidates").rows.collect()] == ["C-2", "C-1"]
    assert ask("list proposed candidates of finance").queries[0][1] == {"domain": "Finance", "status": "Proposed", "limit": 20}
    assert ask("which are blocked?").rows.first()["candidate_id"] == "C-2"
    assert ask("who uses meter activity").queries == (("candidate_consumers", {"candidate_id": "C-2"}),)
    assert [r["report_id"] for r in ask("zombie reports").rows.collect()] == ["R2", "R1"] and ask("what lineage gaps?").intent == "gaps"
    assert named.citation_rate([ask("what lineage gaps?"), ask("who uses C-2"), named.Answer("x", (), None)]) == pytest.approx(2 / 3)
    with pytest.raises(KeyError):
        named.run(spark, t, "drop table")
    with pytest.raises(KeyError):
        named.run(spark, t, "gap_list", sql="1")
    assert named.run(spark, t, "candidate_ranking", domain="' OR 1=1 --").count() == 0
    assert named.limit_of("top 500") == 100 and named.label_of('definitions of "net revenue"') == "net revenue"


def test_documents(spark):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "n int, text string")
    doc = exports.Document("T").heading("H").points(["x"]).table(df, ["n"], most=1)
    assert "| 1 | a\\|b |" in exports.markdown(doc) and "The first 1 rows." in exports.markdown(doc)
    assert "<td>a|b</td>" in exports.to_html(doc)
    assert exports.to_yaml({"a": [1, {"b": "yes", "c": []}], "d e": None, "t": "x: y"}) == 'a:\n  - 1\n  - b: "yes"\n    c: []\n"d e": null\nt: "x: y"\n'
    assert exports.to_json({"d": dt.date(2024, 1, 2), "s": {2, 1}}, 0).replace("\n", "") == '{"d": "2024-01-02","s": [1,2]}'


def test_coverage_gate_and_retune():
    assert candidates.coverage_gate(None) == "not_assessed" and candidates.coverage_gate(0.4) == "fail" and candidates.coverage_gate(0.6, True) == "passed after retune"
    assert candidates.retune(lambda r: r, lambda r: {1.0: 0.3, 0.7: 0.6, 1.3: 0.2}[r])[1] == 0.7
    assert candidates.retune(lambda r: r, lambda r: 0.9)[3] == [(1.0, 0.9)]
