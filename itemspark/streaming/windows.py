"""Failure counts per window with late rows and broken lines accounted for.

Every line of the log ends in one of three places: the counts (rows in time),
the late rows, whose windows are recounted from all rows kept, or the
quarantine. So good and bad lines add up to the input, and the counts equal a
batch count over all good rows whatever the order of files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemspark.functions import classes
from itemspark.session import folder_exists
from itemspark.streaming import tables

FAILURE_SCHEMA = (
    "ts timestamp, model string, standard string, difficulty string, type string, reason string, raw_len bigint, raw_preview string"
)
_KEYS, _VALUES = ["window_start", "class"], {"n": tables.SUM}


def read_lines(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """New failure log files as a stream; a line that cannot be read keeps its text in ``bad_line``, other rows have null there."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    return parsed(lines)


def parsed(lines: DataFrame) -> DataFrame:
    """Log lines (``value``) as failure rows; blank lines are none."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad_line"}
    row = F.from_json("value", FAILURE_SCHEMA + ", bad_line string", options)
    rows = lines.filter(F.trim("value") != "").select(row.alias("r"), "value")
    names = [f.split()[0] for f in FAILURE_SCHEMA.split(", ")]
    broken = F.col("r").isNull() | F.col("r.bad_line").isNotNull() | F.col("r.ts").isNull()
    return rows.select(*[F.col(f"r.{c}").alias(c) for c in names], F.when(broken, F.col("value")).alias("bad_line"))


def _window_us(us: Column, size_us: int) -> Column:
    return F.floor(us / size_us) * size_us


def _start(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def counted_windows(path: str, size_s: int = 3600, delay_s: int = 3600, every: int = 10) -> Callable[[DataFrame, int], None]:
    """Sink for rows with ``ts``, ``reason`` and, where lines can be broken, ``bad_line``.

    The watermark is the largest time of earlier batches less ``delay_s``, kept
    in the commits. A row is late when its window ended before it: it goes to
    ``path``/late, and its window is counted again from ``path``/rows (only the
    folders of touched windows are read) and replaced as a whole.
    """
    size = size_s * 1_000_000

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = tables.last_commit(spark, f"{path}/counts")
        if before and before["batch_id"] >= batch_id:
            return
        newest = before["notes"]["newest"] if before else None
        good = batch
        if "bad_line" in batch.columns:
            batch.filter("bad_line IS NOT NULL").select("bad_line").write.mode("overwrite").parquet(f"{path}/quarantine/batch_id={batch_id}")
            good = batch.filter("bad_line IS NULL").drop("bad_line")
        us = F.unix_micros(F.col("ts").cast("timestamp"))
        # rows are kept by window, so that a recount reads the windows it needs
        kept = good.filter("ts IS NOT NULL").withColumn("window_us", _window_us(us, size)).withColumn("class", classes.failure_class(F.col("reason")))
        kept.write.mode("overwrite").partitionBy("window_us").parquet(f"{path}/rows/batch_id={batch_id}")
        rows = spark.read.schema(kept.schema).parquet(f"{path}/rows/batch_id={batch_id}")
        mark = None if newest is None else newest - delay_s * 1_000_000
        is_late = F.lit(False) if mark is None else F.col("window_us") + size <= mark
        late = rows.filter(is_late)
        late.write.mode("overwrite").parquet(f"{path}/late/batch_id={batch_id}")
        if mark is not None:
            touched = late.select("window_us").distinct()
            every_row = spark.read.schema(kept.schema.add("batch_id", "long")).parquet(f"{path}/rows").filter(F.col("batch_id") <= batch_id)
            again = every_row.join(touched, "window_us", "left_semi").groupBy("window_us", "class").agg(F.count(F.lit(1)).alias("n"))
            again.write.mode("overwrite").parquet(f"{path}/recounts/batch_id={batch_id}")
        counts = rows.filter(~is_late).groupBy(_start(F.col("window_us")).alias("window_start"), "class").agg(F.count(F.lit(1)).alias("n"))
        own = rows.agg(F.max(us)).first()[0]
        notes = {"newest": max((x for x in (newest, own) if x is not None), default=None)}
        tables.merge_batch(spark, f"{path}/counts", counts, batch_id, _KEYS, _VALUES, notes, every)

    return handle


def window_counts(spark: SparkSession, path: str) -> DataFrame:
    """``window_start``, ``class``, ``n``: counts of rows in time, replaced by the newest recount of a window that had late ones."""
    counts = tables.latest(spark, f"{path}/counts", _KEYS, _VALUES)
    if not folder_exists(spark, f"{path}/recounts"):
        return counts
    done = tables.last_commit(spark, f"{path}/counts")["batch_id"]
    again = spark.read.schema("window_us long, class string, n long, batch_id long").parquet(f"{path}/recounts").filter(F.col("batch_id") <= done)
    newest = again.groupBy(F.col("window_us").alias("_w")).agg(F.max("batch_id").alias("_b"))
    last = again.join(newest, (F.col("window_us") == F.col("_w")) & (F.col("batch_id") == F.col("_b")))
    last = last.select(_start(F.col("window_us")).alias("window_start"), "class", "n")
    kept = counts.join(last.select(F.col("window_start").alias("_start")).distinct(), F.col("window_start") == F.col("_start"), "left_anti")
    return kept.unionByName(last)


def quarantined(spark: SparkSession, path: str) -> DataFrame:
    """Lines that could not be read."""
    return spark.read.schema("bad_line string, batch_id long").parquet(f"{path}/quarantine")
