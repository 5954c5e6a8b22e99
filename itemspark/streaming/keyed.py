"""Alerts from keyed state: each key holds what it needs, and lets go of it.

The processors run under ``transformWithStateInPandas`` with the RocksDB state
store. Rows are added up per task before they are shuffled to their key where
only counts matter, so a hot key arrives as a few rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from itemspark.session import ship

ship(__name__)

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start_files(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Run to Parquet files, each row once; the state store that keyed state needs is set for this query only."""
    conf = stream.sparkSession.conf
    before = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, _ROCKS)
    try:
        writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        conf.unset(_PROVIDER) if before is None else conf.set(_PROVIDER, before)


def alerts_of(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """What a query of :func:`start_files` has written; empty where it wrote nothing yet."""
    return spark.read.schema(like.schema).parquet(path)


def _counted(keys: list[str]):
    """Rows per key of a batch of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sums = pa.Table.from_batches([batch]).group_by(keys, use_threads=False).aggregate([([], "count_all")])
                yield from sums.select([*keys, "count_all"]).rename_columns([*keys, "n"]).to_batches()

    return run


def _named(keys: Sequence[str], key: tuple) -> dict:
    return dict(zip(keys, key, strict=True))


def _types(df: DataFrame, columns: Sequence[str]) -> T.StructType:
    return T.StructType([df.schema[c] for c in columns])


# ---- one counter per key ----------------------------------------------------
class _Threshold(StatefulProcessor):
    """Rows since the last report; the state of a key is gone once it is reported."""

    def __init__(self, keys: list[str], at_least: int):
        self.keys, self.at_least = keys, at_least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pending = handle.getValueState("pending", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n = sum(int(part["n"].sum()) for part in rows) + (self.pending.get()[0] if self.pending.exists() else 0)
        if n < self.at_least:
            self.pending.update((n,))
            return
        self.pending.clear()
        yield pd.DataFrame([{**_named(self.keys, key), "n_since_report": n}], dtype=object)

    def close(self) -> None:
        pass


def threshold_alerts(stream: DataFrame, keys: Sequence[str] = ("model",), at_least: int = 5) -> DataFrame:
    """A row per key and report: ``n_since_report`` rows have come in since the last one, ``at_least`` or more."""
    keys = list(keys)
    counted = stream.select(*keys).mapInArrow(_counted(keys), T.StructType([*_types(stream, keys), T.StructField("n", T.LongType())]))
    out = T.StructType([*_types(stream, keys), T.StructField("n_since_report", T.LongType())])
    return counted.groupBy(*keys).transformWithStateInPandas(_Threshold(keys, at_least), out, "append", "none")


# ---- repeated failures among new rows ---------------------------------------
class _Repeated(StatefulProcessor):
    """Rows per time slot and reason since the last report, forgotten ``within`` after the key's newest row."""

    def __init__(self, keys: list[str], reason: str, at_least: int, slots: int, slot_us: int):
        self.keys, self.reason, self.at_least, self.slots, self.slot_us = keys, reason, at_least, slots, slot_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "slot long, reason string", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        counts = {k: v[0] for k, v in self.seen.iterator()}
        old = set(counts)
        for part in rows:
            for slot, reason, n in part[["slot", self.reason, "n"]].itertuples(index=False):
                at = (int(slot), reason if isinstance(reason, str) else None)
                counts[at] = counts.get(at, 0) + int(n)
        newest = max(slot for slot, _ in counts)
        counts = {at: n for at, n in counts.items() if at[0] > newest - self.slots}
        total = sum(counts.values())
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if total >= self.at_least:
            self.seen.clear()
            by_reason: dict[str | None, int] = {}
            for (_, reason), n in counts.items():
                by_reason[reason] = by_reason.get(reason, 0) + n
            top = min(by_reason, key=lambda r: (-by_reason[r], r is None, r or ""))
            yield pd.DataFrame([{**_named(self.keys, key), "n_failures": total, "top_reason": top}], dtype=object)
            return
        for at in old - set(counts):
            self.seen.removeKey(at)
        for at, n in counts.items():
            self.seen.updateValue(at, (n,))
        self.handle.registerTimer((newest + self.slots) * self.slot_us // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.seen.clear()
        yield from ()

    def close(self) -> None:
        pass


def repeated_keys(
    stream: DataFrame, keys: Sequence[str] = ("standard", "difficulty"), ts: str = "ts", reason: str = "reason",
    at_least: int = 3, within_s: int = 3600, slots: int = 60, delay: str = "10 minutes",
) -> DataFrame:
    """Keys that fail ``at_least`` times among their new rows, with the main reason (the first by name of equals).

    New are rows since the key's last report, no older than ``within_s`` before
    its newest row (in ``slots`` steps of event time). A key that stays quiet so
    long lets go of its state.
    """
    keys, slot_us = list(keys), within_s * 1_000_000 // slots
    at = F.col(ts).cast("timestamp")
    timed = stream.filter(F.col(ts).isNotNull()).select(*keys, reason, at.alias("at"), F.floor(F.unix_micros(at) / slot_us).alias("slot"))
    schema = T.StructType([*_types(stream, [*keys, reason]), T.StructField("at", T.TimestampType()), T.StructField("slot", T.LongType()), T.StructField("n", T.LongType())])
    counted = timed.mapInArrow(_slots(keys, reason), schema).withWatermark("at", delay)
    out = T.StructType([*_types(stream, keys), T.StructField("n_failures", T.LongType()), T.StructField("top_reason", T.StringType())])
    return counted.groupBy(*keys).transformWithStateInPandas(_Repeated(keys, reason, at_least, slots, slot_us), out, "append", "eventTime")


def _slots(keys: list[str], reason: str):
    """Rows per key, reason and slot of a batch of a task, at the time of their newest row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                by = [*keys, reason, "slot"]
                sums = pa.Table.from_batches([batch]).group_by(by, use_threads=False).aggregate([("at", "max"), ([], "count_all")])
                yield from sums.select([*keys, reason, "at_max", "slot", "count_all"]).rename_columns([*keys, reason, "at", "slot", "n"]).to_batches()

    return run


# ---- exact trailing windows -------------------------------------------------
class _Trailing(StatefulProcessor):
    """Events of a stretch of a key by time; an event is judged once the watermark has passed it.

    The stretch is two values, read and written once per call: a call of the state
    store for each event costs far more than the judgement.
    """

    def __init__(self, columns: list[str], window_us: int, at_least: int):
        self.columns, self.window_us, self.at_least = columns, window_us, at_least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.moments = handle.getValueState("moments", "us array<long>, n array<long>")  # how many events a moment has, by time
        self.open = handle.getValueState("open", "us array<long>, ids array<string>")  # those still to be judged

    def _held(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
        us, n = self.moments.get() if self.moments.exists() else ([], [])
        at, ids = self.open.get() if self.open.exists() else ([], [])
        return np.array(us, np.int64), np.array(n, np.int64), np.array(at, np.int64), list(ids)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        us, n, at, ids = self._held()
        times, ats = [us], [at]
        for part in rows:
            own, new = part["own"].to_numpy(bool), part["us"].to_numpy(np.int64)
            times.append(new)
            ats.append(new[own])
            ids += part["row_id"][own].tolist()
        every = np.concatenate(times)
        moments, place = np.unique(every, return_inverse=True)
        counts = np.zeros(len(moments), np.int64)
        np.add.at(counts, place, np.concatenate([n, np.ones(len(every) - len(n), np.int64)]))
        yield from self._judged(moments, counts, np.concatenate(ats), ids, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._judged(*self._held(), timerValues.getCurrentWatermarkInMs() * 1000)

    def _judged(self, us: np.ndarray, n: np.ndarray, at: np.ndarray, ids: list, mark: int) -> Iterator[pd.DataFrame]:
        ready = np.flatnonzero(at < mark)
        upto = np.concatenate([[0], np.cumsum(n)])
        recent = upto[np.searchsorted(us, at[ready], "right")] - upto[np.searchsorted(us, at[ready] - self.window_us, "left")]
        found = [(ids[i], int(k)) for i, k in zip(ready, recent) if k >= self.at_least]
        later, kept = np.flatnonzero(at >= mark), us >= mark - self.window_us
        self._hold(us[kept], n[kept], at[later], [ids[i] for i in later])
        if found:
            yield pd.DataFrame(found, columns=["row_id", "n_recent"])

    def _hold(self, us: np.ndarray, n: np.ndarray, at: np.ndarray, ids: list) -> None:
        """Write the stretch back, with one timer: when the earliest open event can be judged, or when the last event may be forgotten."""
        self.moments.update((us.tolist(), n.tolist())) if len(us) else self.moments.clear()
        self.open.update((at.tolist(), ids)) if ids else self.open.clear()
        due = int(at.min()) // 1000 + 1 if ids else (int(us.max()) + self.window_us) // 1000 + 2 if len(us) else None
        for timer in list(self.handle.listTimers()):
            if timer != due:
                self.handle.deleteTimer(timer)
        if due is not None:
            self.handle.registerTimer(due)

    def close(self) -> None:
        pass


def rate_limit_alerts(
    stream: DataFrame, keys: Sequence[str], row_id: str, ts: str = "ts", window_s: int = 60, at_least: int = 3, delay: str = "10 minutes"
) -> DataFrame:
    """``row_id`` (as text) and ``n_recent`` of the events that see ``at_least`` events of their key in the trailing window.

    The streaming twin of ``ranks.rate_limit_alerts``, exact for rows no later
    than ``delay``: an event is told once the watermark has passed it, so later
    events are still open. A key is cut into stretches of ten windows, whose end
    is also handed to the next one, so no task holds all of a hot key; what is
    older than a window leaves the state.
    """
    span = window_s * 1_000_000
    step = 10 * span
    at = F.col(ts).cast("timestamp")
    timed = stream.filter(F.col(ts).isNotNull()).select(*keys, F.col(row_id).cast("string").alias("row_id"), at.alias("at"), F.unix_micros(at).alias("us"))
    first, last = F.floor(F.col("us") / step), F.floor((F.col("us") + span) / step)
    dealt = timed.withWatermark("at", delay).withColumn("part", F.explode(F.sequence(first, last))).withColumn("own", F.col("part") == first)
    return dealt.groupBy(*keys, "part").transformWithStateInPandas(_Trailing([*keys], span, at_least), "row_id string, n_recent long", "append", "eventTime")
