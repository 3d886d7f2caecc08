"""Streams cut into many micro-batches, with a stop and restart, equal the batch result."""

import pytest
from pyspark.sql import functions as F

from gearwatch.catalog.base import telemetry
from gearwatch.operators import series
from gearwatch.streaming import jobs, keyed, progress
from tests.test_scale_paths import same


@pytest.fixture(scope="module")
def parts(spark, sf, tmp_path_factory):
    """Readings in time order, split over six files."""
    folder = str(tmp_path_factory.mktemp("parts"))
    tel = telemetry(spark, sf).select("event_id", "machineID", "datetime", "volt", F.lit("k").alias("key"))
    for i in range(6):
        low, high = 167 * i, 167 * (i + 1)
        tel.filter((F.col("event_id") >= low) & (F.col("event_id") < high)).coalesce(1).write.mode("append").parquet(folder)
    return folder, tel.persist()


def source(spark, parts):
    folder, tel = parts
    return jobs.read_stream(spark, folder, tel.schema, "*.parquet", files_per_batch=1)


def test_stateful_features_over_batches(spark, parts, tmp_path):
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for _ in range(2):
        jobs.with_state(source(spark, parts), jobs.stateful_features(["volt"], ["datetime", "event_id"]), out, mark)
    got = spark.read.parquet(f"{out}/out/b=*")
    want = series.sensor_features(parts[1], ["volt"], ["machineID"], ["datetime", "event_id"])
    r = lambda df: df.select("event_id", *[F.round(c, 9).alias(c) for c in df.columns if c.startswith("volt_")])
    same(r(got), r(want))
    assert spark.read.parquet(f"{out}/state/b=5").groupBy("machineID").count().agg(F.max("count")).first()[0] <= 47


def test_rate_limit_over_batches(spark, parts, tmp_path):
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    jobs.with_state(source(spark, parts).select("event_id", "key", "datetime"), jobs.rate_limit_step(3, 7200.0, tie=["event_id"]), out, mark)
    want = jobs.rate_limit(parts[1].select("event_id", "key", "datetime"), 3, 7200.0, tie=["event_id"])
    same(spark.read.parquet(f"{out}/out/b=*"), want)
    assert want.filter("NOT allowed").count() > 0


def test_late_rows_are_marked(spark, parts, tmp_path):
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    jobs.with_state(source(spark, parts), jobs.count_late(0), out, mark)
    assert spark.read.parquet(f"{out}/out/b=*").count() == parts[1].count()


def test_last_readings_over_batches(spark, parts, tmp_path):
    df = source(spark, parts).select("machineID", F.unix_micros("datetime").alias("t"), "event_id", "volt")
    sink = jobs.drain(jobs.last_readings(df, 5), str(tmp_path / "s"), str(tmp_path / "c"), "update")
    newest = sink.groupBy("machineID").agg(F.max("_batch").alias("_batch"))
    got = sink.join(newest, ["machineID", "_batch"]).select("machineID", "event_id")
    same(got, series.last_n(parts[1], 5, ["machineID"], ["datetime", "event_id"]).select("machineID", "event_id"))


def test_window_metrics_over_batches(spark, parts, tmp_path):
    df = source(spark, parts).withColumn("p", F.least(F.col("volt") / 500, F.lit(1.0)))
    sink = jobs.drain(jobs.live_metrics(df, 0.1, "1 day", late="40 days"), str(tmp_path / "s"), str(tmp_path / "c"), "update")
    got = jobs.newest_update(sink, ["window_start"]).agg(F.sum("readings")).first()[0]
    assert got == parts[1].count()


def test_left_join_emits_unmatched(spark, parts, tmp_path):
    events = source(spark, parts).filter("volt > 50").select("machineID", F.col("datetime").alias("event_time"), F.col("event_id").alias("e"))
    joined = jobs.join_events(source(spark, parts).select("machineID", "datetime", "event_id"), events, 24, "1 hour", "left")
    out = jobs.drain(joined, str(tmp_path / "s"), str(tmp_path / "c"))
    assert out.filter("e IS NULL").count() > 0 and out.filter("e IS NOT NULL").count() > 0


@pytest.fixture(scope="module")
def closed(spark, sf, parts, tmp_path_factory):
    """The same files with a few rows each that belong to the file before, and a last reading long after all others."""
    folder, tel = str(tmp_path_factory.mktemp("closed")), parts[1]
    late = (F.col("event_id") % 167 > 162) & (F.col("event_id") % 2 == 0)
    rows = tel.withColumn("_file", F.floor(F.col("event_id") / 167) + F.when(late, 1).otherwise(0))
    for i in range(7):
        rows.filter(F.col("_file") == i).drop("_file").coalesce(1).write.mode("append").parquet(folder)
    end = tel.orderBy(F.desc("event_id")).limit(1).withColumns(
        {"event_id": F.lit(-1).cast("long"), "datetime": F.col("datetime") + F.expr("INTERVAL 400 DAYS"), "machineID": F.lit(-1).cast("long")})
    end.write.mode("append").parquet(folder)
    return folder, tel


def run_twice(df, tmp_path):
    """A first run over everything that is there, and one that finds nothing new after a restart."""
    out = None
    for _ in range(2):
        out = jobs.drain(df(), str(tmp_path / "s"), str(tmp_path / "c"))
    return out.filter("event_id >= 0")


def test_keyed_features_behind_the_watermark(spark, closed, tmp_path):
    sizes = {"lags": [1, 3], "means": [3, 24], "stds": [6], "slopes": [3]}
    got = run_twice(lambda: keyed.row_feature_stream(source(spark, closed), ["volt"], tie=["event_id"], late="2 days", **sizes), tmp_path)
    want = series.sensor_features(closed[1], ["volt"], ["machineID"], ["datetime", "event_id"], **sizes)
    r = lambda df: df.select("event_id", *[F.round(c, 9).alias(c) for c in want.columns if c.startswith("volt_")])
    same(r(got), r(want))


def test_keyed_rate_limit_behind_the_watermark(spark, closed, tmp_path):
    got = run_twice(lambda: keyed.rate_limit(source(spark, closed), 3, 7200.0, tie=["event_id"], late="2 days"), tmp_path)
    want = jobs.rate_limit(closed[1].select("event_id", "key", "datetime"), 3, 7200.0, tie=["event_id"])
    same(got.select("event_id", "allowed"), want.select("event_id", "allowed"))
    assert got.filter("NOT allowed AND (wait <= 0 OR wait > 7200)").count() == 0
    assert got.filter("allowed AND wait <> 0").count() == 0


def test_silent_machines_are_forgotten(spark, tmp_path):
    from datetime import datetime, timedelta

    t0, folder = datetime(2024, 1, 1), str(tmp_path / "in")
    hours = [[0, 1, 2], [3], [60, 61], [500]]
    for i, part in enumerate(hours):
        rows = [(h, 1 if h < 500 else 2, t0 + timedelta(hours=h), float(h)) for h in part] + ([(100 + i, 2, t0 + timedelta(hours=50), 0.0)] if i == 1 else [])
        spark.createDataFrame(rows, "event_id long, machineID long, datetime timestamp, volt double").coalesce(1).write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    df = jobs.read_stream(spark, folder, schema, "*.parquet", files_per_batch=1)
    out = jobs.drain(keyed.row_feature_stream(df, ["volt"], tie=["event_id"], late="1 hour", forget_after=24, lags=[1], means=[], stds=[], slopes=[]),
                     str(tmp_path / "s"), str(tmp_path / "c"))
    lag = {r["event_id"]: r["volt_lag_1h"] for r in out.filter("machineID = 1").collect()}
    assert lag == {0: None, 1: 0.0, 2: 1.0, 3: 2.0, 60: None, 61: 60.0}


def test_progress_of_every_batch_is_logged(spark, parts, tmp_path):
    seen = progress.observed(source(spark, parts), "live", readings=F.count(F.lit(1)), top=F.max("volt"))
    _, log = progress.logged(spark, str(tmp_path / "log"), lambda: jobs.drain(seen.select("event_id"), str(tmp_path / "s"), str(tmp_path / "c")))
    rows = {r["batch"]: r for r in log.collect()}
    assert [rows[b]["input_rows"] for b in range(6)] == [167] * 5 + [parts[1].count() - 5 * 167]
    import json

    assert sum(json.loads(r["metrics"])["live"]["readings"] for r in rows.values()) == parts[1].count()
    assert max(json.loads(r["metrics"])["live"]["top"] or 0 for r in rows.values()) == parts[1].agg(F.max("volt")).first()[0]


class Store:
    """What a processor has put into its list and value states, without Spark."""

    def __init__(self):
        self.rows, self.timers = [], set()

    def getListState(self, name, schema):
        return Store()

    getValueState = getListState

    def get(self):
        return self.rows

    def appendList(self, rows):
        self.rows = [*self.rows, *rows]

    def put(self, rows):
        self.rows = list(rows)

    def update(self, value):
        self.rows = value

    def clear(self):
        self.rows = []

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class Clock:
    def __init__(self, mark):
        self.mark = mark

    def getCurrentWatermarkInMs(self):
        return self.mark


class Due(Store):
    def get(self):
        return self.rows or None


def test_keys_of_a_group_share_few_state_values():
    import pandas as pd

    handle = Store()
    own = keyed.RateLimit(["key", "t", "event_id"], 2, 2, 3_600_000_000)
    own.init(handle)
    own.due = Due()
    n = 5000
    frame = pd.DataFrame({"_bucket": 1, "key": [None if i % 50 == 7 else f"k{i % 50}" for i in range(n)],
                          "t": [i * 60_000_000 for i in range(n)], "event_id": range(n)})
    list(own.handleInputRows((1,), iter([frame.iloc[::-1]]), Clock(0)))
    assert len(own.pending.get()) == 1  # one value per row before
    half = 2500 * 60_000
    out = pd.concat(list(own.handleExpiredTimer((1,), Clock(half), None)) + list(own.handleExpiredTimer((1,), Clock(n * 60_000), None)))
    seen, want = {}, {}
    for k, t, e in frame[["key", "t", "event_id"]].itertuples(index=False):
        seen[k] = [a for a in seen.get(k, []) if t - a < 3_600_000_000]
        want[e] = len(seen[k]) < 2
        if want[e]:
            seen[k].append(t)
    assert dict(zip(out["event_id"], out["allowed"])) == want and len(out) == n
