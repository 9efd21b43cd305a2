"""Few links are joined in one task: a round's exchanges cost the driver tasks and metrics whatever the number of links."""

import numpy as np
import pytest

from metrigraph.llm import _graph


def want(links):
    low = {}
    for node in {x for link in links for x in link if None not in link and link[0] != link[1]}:
        low[node] = node
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a in low and b in low and low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    return low


RNG = np.random.default_rng(3)
LINKS = [*((i, i + 1) for i in range(100, 160)), *((7, i) for i in range(1_000, 1_080)), *map(tuple, RNG.integers(2_000, 2_200, (150, 2)).tolist()), (5, 5), (None, 6), (9, None), (1 << 62, 3), (-4, 3), (-4, 3)]


@pytest.mark.parametrize("at_once", [1 << 19, 100, 2])
def test_components_however_many_are_joined_at_once(spark, monkeypatch, at_once):
    """All in one task, in one task after each has joined its own, and in rounds."""
    monkeypatch.setattr(_graph, "AT_ONCE", at_once)
    edges = spark.createDataFrame(LINKS, "a long, b long").repartition(3)
    rows = _graph.components(edges, "a", "b").collect()
    assert len(rows) == len({r["node"] for r in rows})
    assert {r["node"]: r["component"] for r in rows} == want(LINKS)


def test_no_links(spark):
    assert _graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_few_links_take_few_tasks(spark):
    """With 50 shuffle partitions, rounds took over 50 tasks an exchange."""
    edges = spark.createDataFrame(LINKS, "a long, b long").coalesce(1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    settings = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    sc = spark.sparkContext
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        sc.setJobGroup("few_links", "components")
        _graph.components(edges, "a", "b").collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    tracker = sc.statusTracker()
    stages = {i for j in tracker.getJobIdsForGroup("few_links") for i in tracker.getJobInfo(j).stageIds}
    tasks = sum(s.numTasks for s in map(tracker.getStageInfo, stages) if s)
    assert 0 < tasks < 50
