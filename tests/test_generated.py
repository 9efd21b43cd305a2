"""Communities are found once from edges that are read once; users of candidates are those of their consumers."""

from pyspark.sql import functions as F

from metrigraph.estate import candidates
from metrigraph.operators import community


def test_communities_read_edges_once_and_are_stored(spark):
    rows = [(f"n{c:03}.{i}", f"n{c:03}.{j}", 1.0 if (i < 3) == (j < 3) else 0.1) for c in range(150) for i in range(6) for j in range(i + 1, 6)]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for x in batches:
            seen.add(len(x))
            yield x

    edges = spark.createDataFrame(rows, "a string, b string, w double").mapInPandas(count, "a string, b string, w double")
    found = community.communities(edges, "a", "b", "w")
    got = dict(tuple(r) for r in found.collect())
    assert found.count() == len(got) == 900 and seen.value == len(rows)
    total = sum(2 * w for _, _, w in rows)
    for c in range(150):
        own = community.louvain([r for r in rows if r[0].startswith(f"n{c:03}.")], total=total)
        low = {k: min(n for n in own if own[n] == k) for k in own.values()}
        assert {n: got[n] for n in own} == {n: low[k] for n, k in own.items()}


def test_users_are_those_of_consumers(spark):
    members = spark.createDataFrame([("A", "M1"), ("A", "M2"), ("B", "M2"), ("C", "M3")], "candidate_id string, metric_id string")
    metrics = spark.createDataFrame([("M1", ["R1", "R2"]), ("M2", ["R2", "R3", "R9"]), ("M3", [])], "metric_id string, report_ids array<string>")
    fields = "report_id string, distinct_users_12m long, business_unit string"
    reports = spark.createDataFrame([("R1", 5, "X"), ("R2", 7, ""), ("R3", 0, "X"), ("R4", 9, "Y")], fields)
    for c in ("report_name", "disposition", "last_run_date", "owner", "schedule_frequency", "decision_critical", "complexity_score", "tool", "semantic_container"):
        reports = reports.withColumn(c, F.lit(""))
    reports = reports.withColumn("schedule_flag", F.lit(True))
    want = candidates.consumers_of(candidates.report_coverage(members, metrics, reports), spark.createDataFrame([("R1", 1.0)], "report_id string, weight double")).select("candidate_id", "business_unit", "users")
    got = candidates.users_of(members, metrics, reports)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) == [("A", "Unassigned", 7), ("A", "X", 5), ("B", "Unassigned", 7), ("B", "X", 0)]
