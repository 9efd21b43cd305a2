"""The graph's work by distinct calculations, and its rows dealt to all tasks."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from metrigraph.estate import graph
from metrigraph.plans import estate
from metrigraph.storage import keep

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def built(spark):
    return graph.build(estate.bundle(spark, SF), keep=keep)


def test_a_file_of_one_row_group_is_dealt_to_all_tasks(spark):
    rows = estate.raw(spark, SF, "kpis")
    per = rows.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(per) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sum(r["count"] for r in per) == spark.read.parquet(f"{SF}/lineitem.parquet").count()


def test_every_node_has_one_calculation(built):
    nodes, calcs = built.nodes.count(), built.calculations.count()
    assert built.kpis.count() == nodes == built.nodes.select("kpi_id").distinct().count()
    assert calcs < nodes and built.calculations.agg(F.sum("n")).first()[0] == nodes


def test_nodes_of_a_calculation_have_equal_edges(built):
    e = built.edges.groupBy("kpi_id").agg(F.to_json(F.array_sort(F.collect_set(F.struct("column_fqn", "role", "raw_reference")))).alias("e"))
    per = built.nodes.join(e, "kpi_id", "left").groupBy("calc").agg(F.count_distinct(F.coalesce("e", F.lit(""))).alias("k"))
    assert per.where("k > 1").count() == 0
    own = built.edges.where("role = 'operand'").groupBy("kpi_id").agg(F.array_sort(F.collect_set("column_fqn")).alias("own"))
    off = built.kpis.join(own, "kpi_id", "left").where("coalesce(own, array()) <> operand_columns")
    assert off.count() == 0
