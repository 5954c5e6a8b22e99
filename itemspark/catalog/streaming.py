"""J: the same questions asked of streams over the given tables."""

import uuid

from pyspark.sql import functions as F

from itemspark.catalog.base import query
from itemspark.catalog.validation import _REJECT, item_rows
from itemspark.fixtures import TEXT_TABLES, Data
from itemspark.session import bytes_of, shared_folder
from itemspark.streaming import keyed, streams, tables, windows


class StreamData(Data):
    """Tables as streams, so that the fixture views become streams too."""

    def table(self, name):
        path = f"{self.folder}/{name}.parquet"
        rows = streams.read_table_stream(self.spark, path, self.spark.read.parquet(path).schema)
        return streams.dealt(rows, bytes_of(self.spark, path)) if name in TEXT_TABLES else rows


def _run(d, stream, handle_for, mode="update"):
    """Use up the present input; returns the folder written to, in the shared checkpoint folder."""
    base = f"{shared_folder(d.spark)}/streams/{uuid.uuid4().hex}"
    streams.start(stream, handle_for(f"{base}/out"), f"{base}/checkpoint", mode).awaitTermination()
    return f"{base}/out"


def _stream(d):
    return StreamData(d.spark, d.folder)


_CLASS = """CASE WHEN contains(reason, '429') OR contains(lower(reason), 'rate') THEN 'rate_limit' WHEN contains(reason, 'timed out') THEN 'timeout'
  WHEN contains(reason, '503') THEN 'server' WHEN contains(reason, 'content_filter') THEN 'content_filter' ELSE 'unknown' END"""


def _keyed(d, alerts):
    """Use up the present input of a query with keyed state; what it reported."""
    base = f"{shared_folder(d.spark)}/streams/{uuid.uuid4().hex}"
    keyed.start_files(alerts, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return keyed.alerts_of(d.spark, f"{base}/out", alerts)


@query("j1_stream_failures", f"SELECT date_trunc('hour', ts) AS window_start, {_CLASS} AS class, count(*) AS n FROM [failure_log] GROUP BY ALL")
def _(d):
    out = _run(d, _stream(d).view("failure_log"), windows.counted_windows, "append")
    return windows.window_counts(d.spark, out)


@query("j2_stream_threshold_alert", "SELECT model, count(*) AS n_since_report FROM [failure_log] GROUP BY model HAVING count(*) >= 5")
def _(d):
    got = _keyed(d, keyed.threshold_alerts(_stream(d).view("failure_log")))
    return got.groupBy("model").agg(F.sum("n_since_report").alias("n_since_report"))


@query("j3_stream_repeated_keys", """
WITH s AS (SELECT standard, difficulty, reason, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS slot FROM [failure_log]),
e AS (SELECT *, max(slot) OVER (PARTITION BY standard, difficulty) AS newest FROM s),
f AS (SELECT standard, difficulty, reason, count(*) AS n FROM e WHERE slot > newest - 48 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY standard, difficulty ORDER BY n DESC, reason) AS rn FROM f)
SELECT standard, difficulty, CAST(sum(n) AS BIGINT) AS n_failures, max(CASE WHEN rn = 1 THEN reason END) AS top_reason FROM r GROUP BY standard, difficulty HAVING sum(n) >= 3""")
def _(d):
    return _keyed(d, keyed.repeated_keys(_stream(d).view("failure_log"), within_s=48 * 3600, slots=48))


@query("j4_stream_rate_limit", """
WITH c AS (SELECT event_id, ts, count(*) OVER (PARTITION BY model ORDER BY ts RANGE BETWEEN INTERVAL 1800 SECONDS PRECEDING AND CURRENT ROW) AS n_recent
           FROM [failure_log])
SELECT event_id, n_recent FROM c WHERE n_recent >= 3 AND ts < date_trunc('milliseconds', (SELECT max(ts) FROM [failure_log])) - INTERVAL 1 HOUR""")
def _(d):
    alerts = keyed.rate_limit_alerts(_stream(d).view("failure_log"), ["model"], "event_id", window_s=1800, delay="1 hour")
    return _keyed(d, alerts).select(F.col("row_id").cast("long").alias("event_id"), "n_recent")


@query("j5_stream_progress", """
WITH b AS (SELECT *, row_number() OVER (PARTITION BY model, grade ORDER BY pass_rate DESC, round) AS rb, row_number() OVER (PARTITION BY model, grade ORDER BY round DESC) AS rl FROM [rounds] WHERE n_valid > 0)
SELECT model, grade, max(round) AS round, max(CASE WHEN rl = 1 THEN pass_rate END) AS pass_rate, max(pass_rate) AS best_pass_rate, max(CASE WHEN rb = 1 THEN round END) AS best_round FROM b GROUP BY model, grade""")
def _(d):
    out = _run(d, _stream(d).view("eval_rows"), streams.round_table, "append")
    return streams.progress(tables.latest(d.spark, out, streams.ROUND_KEYS, streams.ROUND_VALUES))


@query("j6_stream_validate", f"""
SELECT ordinal, ({_REJECT}) AS reject_reason FROM [items]""")
def _(d):
    out = _run(d, item_rows(_stream(d)), streams.validated, "append")
    good = d.spark.read.parquet(f"{out}/items").select("ordinal", F.lit(None).cast("string").alias("reject_reason"))
    return good.unionByName(d.spark.read.parquet(f"{out}/rejects").select("ordinal", "reject_reason"))
