"""Vectors are stored once and read in pairs of chunks: none is dealt out to all that it may meet."""

import numpy as np
from pyspark.sql import functions as F

from metrigraph.llm import vectors


def test_no_vector_is_dealt_out(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(3000, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(5)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(axis=1) - 1
    assert {r["id"]: r["n_links"] for r in vectors.near_duplicates(df).collect()} == dict(enumerate(want.tolist()))
    nodes = df.select(F.col("vec_id").alias("node"), F.col("vec_id").cast("string").alias("key"), F.lit(1).cast("long").alias("weight"), F.col("embedding").alias("v"))
    plan = vectors.links(nodes, 8, 0.9, *vectors.rotation(u[:500], 2))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan


def test_strips_hold_all_that_is_within_the_width():
    u = np.random.default_rng(6).normal(size=2500)
    left, right = np.arange(1200), np.arange(1200, 2500)
    met = {(i, j) for a, b in vectors._strips(u, left, right, 0.3) for i in a for j in b}
    assert {(i, j) for i in left for j in right if abs(u[i] - u[j]) <= 0.3} <= met
