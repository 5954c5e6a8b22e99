"""Late rows, broken lines, keyed alerts and merged tables, against plain counts over the same rows."""

import json
import os
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from itemspark.operators import ranks
from itemspark.session import folder_exists
from itemspark.streaming import keyed, streams, tables, windows

START = datetime(2024, 1, 1)


def line(minute, reason="HTTP 503", model="m", key="S1", seconds=0):
    at = START + timedelta(minutes=minute, seconds=seconds)
    return {"ts": at.isoformat(timespec="milliseconds") + "Z", "model": model, "standard": key, "difficulty": "easy", "reason": reason}


def put(folder, name, *rows):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.writelines((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows)


def class_of(reason):
    return "server" if "503" in reason else "timeout"


class Log:
    """A folder of rolled files and queries that are started again for each of them."""

    def __init__(self, spark, base):
        self.spark, self.base, self.n = spark, str(base), 0

    def add(self, *rows):
        self.n += 1
        put(f"{self.base}/in", f"{self.n:03d}.jsonl", *rows)

    def windows(self):
        stream = windows.read_lines(self.spark, f"{self.base}/in")
        streams.start(stream, windows.counted_windows(f"{self.base}/out", every=2), f"{self.base}/check", "append").awaitTermination()

    def alerts(self, make, name):
        stream = make(windows.read_lines(self.spark, f"{self.base}/in"))
        keyed.start_files(stream, f"{self.base}/{name}", f"{self.base}/{name}-check").awaitTermination()
        return keyed.alerts_of(self.spark, f"{self.base}/{name}", stream).collect()


def counts_of(spark, out):
    return {(str(r.window_start), r["class"]): r.n for r in windows.window_counts(spark, out).collect()}


def test_late_rows_and_broken_lines(spark, tmp_path):
    log = Log(spark, tmp_path)
    files = [
        [line(0), line(5, "timed out"), "{broken", line(61)],
        [line(300), line(301)],
        [line(6), line(7, "timed out"), line(310), '{"ts": "no time"}'],  # two rows of a window that ended long before
        [line(8), line(62)],
        [line(400), "", line(309)],
    ]
    seen, bad = [], 0
    for rows in files:
        log.add(*rows)
        log.windows()
        seen += [r for r in rows if isinstance(r, dict)]
        bad += sum(isinstance(r, str) and r != "" for r in rows)
        want = Counter((r["ts"][:13].replace("T", " ") + ":00:00", class_of(r["reason"])) for r in seen)
        assert counts_of(spark, f"{tmp_path}/out") == want
        assert windows.quarantined(spark, f"{tmp_path}/out").count() == bad
    late = spark.read.parquet(f"{tmp_path}/out/late")
    assert sorted(r.ts.minute + 60 * r.ts.hour for r in late.collect()) == [6, 7, 8, 62]


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(START, "HTTP 503"), (START + timedelta(hours=5), "timed out")], "ts timestamp, reason string")
    handle = windows.counted_windows(str(tmp_path))
    handle(rows, 0)
    handle(rows, 1)  # the first row is late now
    want = counts_of(spark, str(tmp_path))
    handle(rows, 1)
    assert counts_of(spark, str(tmp_path)) == want and sorted(want.values()) == [2, 2]


def test_threshold_alerts_survive_a_restart(spark, tmp_path):
    log = Log(spark, tmp_path)
    make = lambda s: keyed.threshold_alerts(s, ["model"], 5)
    log.add(line(0), line(1), line(2), line(0, model="n"))
    assert log.alerts(make, "alerts") == []
    log.add(line(3), line(4), line(5))
    assert [(r.model, r.n_since_report) for r in log.alerts(make, "alerts")] == [("m", 6)]
    log.add(*[line(6)] * 4, *[line(6, model="n")] * 4, *[line(6, model=None)] * 7)
    assert sorted((r.model or "-", r.n_since_report) for r in log.alerts(make, "alerts")) == [("-", 7), ("m", 6), ("n", 5)]
    log.add(line(7))
    assert sorted((r.model or "-", r.n_since_report) for r in log.alerts(make, "alerts")) == [("-", 7), ("m", 5), ("m", 6), ("n", 5)]


def test_repeated_keys_count_new_rows_only(spark, tmp_path):
    log = Log(spark, tmp_path)
    make = lambda s: keyed.repeated_keys(s, at_least=3, within_s=3600, slots=60)
    got = lambda: sorted((r.standard, r.n_failures, r.top_reason) for r in log.alerts(make, "repeats"))
    log.add(line(0, key="far"), line(1, key="far"), line(0, key="near"), line(1, "timed out", key="near"))
    assert got() == []
    log.add(line(500, key="far"), line(501, key="far"))  # two in each of two far-apart hours
    assert got() == []
    log.add(line(502, key="near"), line(520, key="near"), line(540, "timed out", key="near"))
    assert got() == [("near", 3, "HTTP 503")]
    log.add(line(541, key="near"), line(542, key="near"))  # counted from the report on
    assert got() == [("near", 3, "HTTP 503")]
    log.add(line(543, key="far"), line(543, key="near"))
    assert got() == [("far", 3, "HTTP 503"), ("near", 3, "HTTP 503"), ("near", 3, "HTTP 503")]


def test_trailing_windows_equal_the_batch_form_on_shuffled_files(spark, tmp_path):
    draw = random.Random(4)
    rows = []
    for i in range(400):
        key = "hot" if draw.random() < 0.5 else f"k{draw.randrange(5)}"
        rows.append((i, key, START + timedelta(milliseconds=draw.randrange(1_800_000))))
    rows.append((999, "end", START + timedelta(hours=3)))  # moves the watermark past all others
    frame = spark.createDataFrame(rows, "event_id long, key string, ts timestamp")
    want = {r.event_id: r.n_recent for r in ranks.rate_limit_alerts(frame, ["key"], at_least=4).collect()}
    order = rows[:-1]
    draw.shuffle(order)
    os.makedirs(tmp_path / "in")
    for k in range(4):
        part = order[k * 100 : (k + 1) * 100] + ([rows[-1]] if k == 3 else [])
        spark.createDataFrame(part, frame.schema).coalesce(1).write.parquet(f"{tmp_path}/part{k}")
        (name,) = [f for f in os.listdir(f"{tmp_path}/part{k}") if f.endswith(".parquet")]
        os.replace(f"{tmp_path}/part{k}/{name}", f"{tmp_path}/in/{k}.parquet")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    alerts = keyed.rate_limit_alerts(stream, ["key"], "event_id", at_least=4, delay="1 hour")
    keyed.start_files(alerts, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = keyed.alerts_of(spark, f"{tmp_path}/out", alerts).collect()
    assert len(got) == len(want) > 50 and {int(r.row_id): r.n_recent for r in got} == want


# ---- merged tables ----------------------------------------------------------
def test_tables_are_merged_and_old_files_go(spark, tmp_path):
    path, keys, values = f"{tmp_path}/t", ["k"], {"n": tables.SUM, "name": tables.NEWEST}
    want, names = defaultdict(int), {}
    for batch_id in range(9):
        rows = [(f"k{i % (batch_id + 2)}" if i else None, i, f"b{batch_id}") for i in range(6)]
        frame = spark.createDataFrame(rows, "k string, n long, name string").groupBy("k").agg(F.sum("n").alias("n"), F.first("name").alias("name"))
        for _ in range(2):  # the second run of a batch finds its commit
            tables.merge_batch(spark, path, frame, batch_id, keys, values, {"at": batch_id}, every=3)
        for k, n, name in rows:
            want[k] += n
            names[k] = name
        got = {r.k: (r.n, r.name) for r in tables.latest(spark, path, keys, values).collect()}
        assert got == {k: (n, names[k]) for k, n in want.items()}
    assert tables.last_commit(spark, path) == {"batch_id": 8, "base": 8, "notes": {"at": 8}}
    assert sorted(os.listdir(f"{path}/base")) == ["version=8"] and sorted(os.listdir(f"{path}/delta")) == ["batch_id=8"]
    assert not folder_exists(spark, f"{path}/delta/batch_id=3")


def test_a_batch_without_its_commit_is_not_seen(spark, tmp_path):
    path = f"{tmp_path}/t"
    one = spark.createDataFrame([("a", 1)], "k string, n long")
    tables.merge_batch(spark, path, one, 0, ["k"], {"n": tables.SUM}, {})
    one.write.parquet(f"{path}/delta/batch_id=1")  # the batch failed before its commit
    assert [r.n for r in tables.latest(spark, path, ["k"], {"n": tables.SUM}).collect()] == [1]
    tables.merge_batch(spark, path, one, 1, ["k"], {"n": tables.SUM}, {})
    assert [r.n for r in tables.latest(spark, path, ["k"], {"n": tables.SUM}).collect()] == [2]


# ---- cooldown ---------------------------------------------------------------
def raised(times, pause):
    out, until = [], None
    for t in sorted(set(times)):
        if until is None or t >= until:
            out.append(t)
            until = t + pause
    return out


@pytest.mark.parametrize("seed", range(3))
def test_alerts_inside_a_cooldown_are_silent(spark, seed):
    draw = random.Random(seed)
    rows = []
    for i in range(300):
        key = "hot" if i % 2 else draw.choice(["a", "b", None])
        rows.append((i, key, draw.randrange(1500 if key == "hot" else 20_000)))
    frame = spark.createDataFrame([(i, k, START + timedelta(seconds=t)) for i, k, t in rows], "event_id long, key string, ts timestamp")
    got = {r.event_id for r in ranks.after_cooldown(frame, ["key"], cooldown_s=30).collect()}
    want = set()
    for key in {k for _, k, _ in rows}:
        own = [(t, i) for i, k, t in rows if k == key]
        for t in raised([t for t, _ in own], 30):
            want.add(min(i for at, i in own if at == t))
    assert got == want
