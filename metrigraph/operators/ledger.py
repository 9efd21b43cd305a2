"""Append-only, hash-chained ledgers: sealing and verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = ""


def seal(df: DataFrame, chain: str, order: list[str], body: Column) -> DataFrame:
    """(chain, position, *order, body, prev_hash, row_hash): each row's hash is over the one before and its body.

    A chain is sequential by nature: its rows pass one task in order, which keeps the last hash only.
    """
    rows = df.select(chain, *order, body.alias("body")).repartition(chain).sortWithinPartitions(chain, *order, "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, place, last = object(), 0, GENESIS
        for batch in batches:
            positions, before, hashes = [], [], []
            for key, text in zip(batch[chain].to_pylist(), batch["body"].to_pylist(), strict=True):
                if key != of:
                    of, place, last = key, 0, GENESIS
                positions.append(place)
                before.append(last)
                last = hashlib.sha256(f"{last}|{text}".encode()).hexdigest()
                hashes.append(last)
                place += 1
            yield pa.RecordBatch.from_arrays([batch[chain], pa.array(positions, pa.int32()), *[batch[c] for c in order], batch["body"], pa.array(before, pa.string()), pa.array(hashes, pa.string())], [chain, "position", *order, "body", "prev_hash", "row_hash"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, ", ".join([f"`{chain}` {kinds[chain]}", "position int", *[f"`{c}` {kinds[c]}" for c in order], "body string", "prev_hash string", "row_hash string"]))


def verify(ledger: DataFrame, chain: str, order: str) -> DataFrame:
    """(chain, first_break): the first row whose link or hash doesn't hold, null for a sound chain."""
    before = F.coalesce(F.lag("row_hash").over(Window.partitionBy(chain).orderBy(order)), F.lit(GENESIS))
    broken = (F.col("prev_hash") != before) | (F.col("row_hash") != F.sha2(F.concat_ws("|", F.col("prev_hash"), F.col("body")), 256))
    return ledger.withColumn("_broken", broken).groupBy(chain).agg(F.min(F.when(F.col("_broken"), F.col(order))).alias("first_break"), F.count("*").alias("n_rows"))
