"""Failure monitoring and validation on streams.

Writers roll files: a file stream reads new files, not lines appended to a file
it has seen. Every sink below writes one folder per micro-batch, so a batch that
is run again after a failure replaces its own output. Counts with late rows are
in ``windows``, alerts from keyed state in ``keyed``, tables kept up to date by
key in ``tables``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from itemspark.functions import classes
from itemspark.operators.validate import quality_issues, validate_schema
from itemspark.streaming import tables, windows

def read_failures(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """New failure log files as a stream, good lines only; ``windows.read_lines`` also has the others."""
    return windows.read_lines(spark, path, max_files).filter("bad_line IS NULL").drop("bad_line")


def read_table_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet file or folder as a stream."""
    return spark.readStream.schema(schema).parquet(path[:-1] + f"[{path[-1]}]")


def dealt(stream: DataFrame, n_bytes: int, per_task: int = 16 << 20) -> DataFrame:
    """Deal the rows of a stream to as many tasks as its input of ``n_bytes`` needs: at least one per core, about ``per_task`` bytes each.

    Texts grow where items are made of them, and a sink that writes twice reads each kept part as a whole.
    """
    cores = stream.sparkSession.sparkContext.defaultParallelism
    return stream.repartition(max(cores, -(-n_bytes // per_task)))


def start(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update", available_now: bool = True
) -> StreamingQuery:
    """Run ``handle`` on every micro-batch; by default until the present input is used up."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def append_batches(path: str) -> Callable[[DataFrame, int], None]:
    """Sink: the rows of a batch under ``path``/batch_id=N."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return handle


def latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Newest state of every key written by an update-mode query."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    newest = F.max_by(F.struct(*rest), F.col("batch_id")).alias("v")
    return rows.groupBy(*keys).agg(newest).select(*keys, "v.*")


# ---- counts -----------------------------------------------------------------
def failure_windows(stream: DataFrame, size: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Failures per event-time window and error class; rows later than ``delay`` go to a batch recount."""
    classed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("class", classes.failure_class(F.col("reason")))
    counts = classed.withWatermark("ts", delay).groupBy(F.window("ts", size), "class").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "class", "n")


def failure_reasons(stream: DataFrame) -> DataFrame:
    """Running counts per (standard, difficulty, reason), the state behind repeated failures."""
    return stream.groupBy("standard", "difficulty", "reason").agg(F.count(F.lit(1)).alias("n"))


def repeated_keys(reason_counts: DataFrame, at_least: int = 3) -> DataFrame:
    """Keys failing often, with their main reason, from the running counts."""
    main = F.min(F.struct((-F.col("n")).alias("neg"), F.col("reason").alias("reason")))
    got = reason_counts.groupBy("standard", "difficulty").agg(F.sum("n").alias("n_failures"), main.alias("m"))
    return got.filter(F.col("n_failures") >= at_least).select("standard", "difficulty", "n_failures", F.col("m.reason").alias("top_reason"))


def rate_limit_windows(stream: DataFrame, keys: Sequence[str], at_least: int = 3, size: str = "60 seconds", step: str = "10 seconds", delay: str = "10 minutes") -> DataFrame:
    """Sliding windows with too many events of a key: the trailing window, looked at every ``step``."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    counts = timed.groupBy(F.window("ts", size, step), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= at_least).select(F.col("window.end").cast("timestamp_ntz").alias("window_end"), *keys, "n")


# ---- alerts with state ------------------------------------------------------
def threshold_alerts(path: str, keys: Sequence[str] = ("model",), at_least: int = 5) -> Callable[[DataFrame, int], None]:
    """Sink: report a key once ``at_least`` new rows have come in since its last report.

    The sink form of ``keyed.threshold_alerts``, for sessions without its state
    store: pending counts are a table (``tables``) to which a batch adds the
    changes of its own keys. Alerts go to ``path``/alerts.
    """
    keys, values = list(keys), {"pending": tables.SUM}

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark, state = batch.sparkSession, f"{path}/state"
        before = tables.last_commit(spark, state)
        if before and before["batch_id"] >= batch_id:
            return
        new = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_new"))
        if before:
            old = tables.latest(spark, state, keys, values).select(*[F.col(c).alias(f"_{c}") for c in keys], F.col("pending").alias("held"))
            same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
            new = new.join(old, same, "left").select(*keys, "n_new", F.coalesce("held", F.lit(0)).alias("held"))
        else:
            new = new.withColumn("held", F.lit(0).cast("long"))
        due = F.col("held") + F.col("n_new") >= at_least
        alerts = new.filter(due).select(*keys, (F.col("held") + F.col("n_new")).alias("n_since_report"))
        alerts.write.mode("overwrite").parquet(f"{path}/alerts/batch_id={batch_id}")
        changes = new.select(*keys, F.when(due, -F.col("held")).otherwise(F.col("n_new")).alias("pending"))
        tables.merge_batch(spark, state, changes, batch_id, keys, values, {})

    return handle


# ---- progress ---------------------------------------------------------------
ROUND_KEYS, ROUND_VALUES = ["model", "grade", "round"], {"n_valid": tables.SUM, "pass_count": tables.SUM}


def round_counts(rows: DataFrame, passing: float = 0.85) -> DataFrame:
    """Pass counts per (model, grade, round)."""
    return rows.groupBy(*ROUND_KEYS).agg(F.count("score").alias("n_valid"), F.count_if(F.col("score") >= passing).alias("pass_count"))


def round_table(path: str, passing: float = 0.85, every: int = 10) -> Callable[[DataFrame, int], None]:
    """Sink: pass counts of new rows are added to the table at ``path``; no state is kept by the stream."""
    return tables.upsert(path, ROUND_KEYS, ROUND_VALUES, lambda batch: round_counts(batch, passing), every)


def progress(counts: DataFrame) -> DataFrame:
    """Latest round and best rate so far of every run, from the running counts."""
    from itemspark.operators.aggs import percent

    rated = counts.withColumn("pass_rate", percent("pass_count", "n_valid")).filter("pass_rate is not null")
    best = F.min(F.struct((-F.col("pass_rate")).alias("neg"), "round"))
    got = rated.groupBy("model", "grade").agg(F.max("round").alias("round"), F.max_by("pass_rate", "round").alias("pass_rate"), best.alias("b"))
    return got.select("model", "grade", "round", "pass_rate", (-F.col("b.neg")).alias("best_pass_rate"), F.col("b.round").alias("best_round"))


# ---- validation -------------------------------------------------------------
def validated(path: str, extra: Sequence[tuple[str, Column]] = ()) -> Callable[[DataFrame, int], None]:
    """Sink: valid items with their issues to ``path``/items, rejects with the reason to ``path``/rejects."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        checked = quality_issues(validate_schema(batch, extra), known_reject="reject_reason").persist()
        checked.filter("reject_reason is null").drop("reject_reason").write.mode("overwrite").parquet(f"{path}/items/batch_id={batch_id}")
        checked.filter("reject_reason is not null").write.mode("overwrite").parquet(f"{path}/rejects/batch_id={batch_id}")
        checked.unpersist()

    return handle
