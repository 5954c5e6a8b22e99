"""Tables that a stream keeps up to date, one commit per micro-batch.

A table folder holds ``delta/batch_id=N`` (the rows of a batch), ``base/version=N``
(one row per key, all batches up to N merged) and ``commits/batch_id=N`` (a small
JSON row: which base is read, and what the sink wants to remember). A batch is
done when its commit is written, so a batch that is run again after a failure
either replaces its own delta or, if its commit is there, does nothing. Every
``every`` batches the deltas are merged by key into a new base; what that base
covers is deleted after the commit.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemspark.session import folder_exists, remove_folder

#: How two values of a key become one: added up, or the one of the newest batch.
SUM, NEWEST = "sum", "newest"


def last_commit(spark: SparkSession, path: str) -> dict | None:
    """The newest commit: ``batch_id``, ``base`` (-1: none) and the sink's ``notes``."""
    if not folder_exists(spark, f"{path}/commits"):
        return None
    rows = spark.read.schema("base long, notes string").json(f"{path}/commits").orderBy(F.col("batch_id").desc()).limit(1).collect()
    return {"batch_id": rows[0]["batch_id"], "base": rows[0]["base"], "notes": json.loads(rows[0]["notes"])} if rows else None


def commit(spark: SparkSession, path: str, batch_id: int, base: int, notes: dict) -> None:
    row = spark.createDataFrame([(base, json.dumps(notes))], "base long, notes string").coalesce(1)
    row.write.mode("overwrite").json(f"{path}/commits/batch_id={batch_id}")


def _merged(rows: DataFrame, keys: Sequence[str], values: dict[str, str]) -> DataFrame:
    newest = [c for c, how in values.items() if how == NEWEST]
    aggs = [F.sum(c).cast(rows.schema[c].dataType).alias(c) for c, how in values.items() if how == SUM]
    if newest:
        aggs.append(F.max_by(F.struct(*newest), F.col("batch_id")).alias("_newest"))
    got = rows.groupBy(*keys).agg(*aggs, F.max("batch_id").alias("batch_id"))
    return got.select(*keys, *[F.col(f"_newest.{c}").alias(c) if how == NEWEST else F.col(c) for c, how in values.items()], "batch_id")


def _rows(spark: SparkSession, path: str, base: int, up_to: int) -> DataFrame:
    """The base and the deltas after it, with the batch each row is from."""
    deltas = spark.read.parquet(f"{path}/delta").filter((F.col("batch_id") > base) & (F.col("batch_id") <= up_to))
    if base < 0:
        return deltas.withColumn("batch_id", F.col("batch_id").cast("long"))
    whole = spark.read.parquet(f"{path}/base/version={base}")
    return whole.unionByName(deltas.withColumn("batch_id", F.col("batch_id").cast("long")))


def merge_batch(
    spark: SparkSession, path: str, rows: DataFrame, batch_id: int, keys: Sequence[str], values: dict[str, str], notes: dict, every: int = 10
) -> None:
    """Commit the rows of a batch; ``values`` tells how the values of a key are merged."""
    before = last_commit(spark, path)
    if before and before["batch_id"] >= batch_id:
        return
    base = before["base"] if before else -1
    rows.select(*keys, *values).write.mode("overwrite").parquet(f"{path}/delta/batch_id={batch_id}")
    compact = batch_id - base >= every
    if compact:
        _merged(_rows(spark, path, base, batch_id), keys, values).write.mode("overwrite").parquet(f"{path}/base/version={batch_id}")
    commit(spark, path, batch_id, batch_id if compact else base, notes)
    if compact:
        # the newest delta stays, so that the folder keeps its schema
        for old in range(max(base, 0), batch_id):
            remove_folder(spark, f"{path}/delta/batch_id={old}")
            remove_folder(spark, f"{path}/commits/batch_id={old}")
        if base >= 0:
            remove_folder(spark, f"{path}/base/version={base}")


def latest(spark: SparkSession, path: str, keys: Sequence[str], values: dict[str, str]) -> DataFrame:
    """One row per key as of the newest commit; a batch that is not committed is not seen."""
    at = last_commit(spark, path)
    if at is None:
        raise ValueError(f"no batch of {path} is committed")
    return _merged(_rows(spark, path, at["base"], at["batch_id"]), keys, values).drop("batch_id")


def upsert(
    path: str, keys: Sequence[str], values: dict[str, str], of: Callable[[DataFrame], DataFrame] = lambda batch: batch, every: int = 10
) -> Callable[[DataFrame, int], None]:
    """Sink: the rows that ``of`` makes of a batch are merged into the table by key."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        merge_batch(batch.sparkSession, path, of(batch), batch_id, keys, values, {}, every)

    return handle
