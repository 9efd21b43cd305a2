"""Tables between steps: written to the folder that driver and executors share, and read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, which is set here only if unset.

    A master on this machine alone may do without the setting; elsewhere each executor would write to its own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file:///tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: lineage ends there, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def together(keep: Callable[[DataFrame], DataFrame], *dfs: DataFrame) -> list[DataFrame]:
    """keep of each table, all at the same time, for tables that don't read each other: small steps plan and wait more than they work."""
    with ThreadPoolExecutor(len(dfs)) as pool:
        return list(pool.map(keep, dfs))


def drop(df: DataFrame) -> None:
    """Deletes the folder of a table from keep() that nothing reads any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.kept_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, near the wanted ones."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
