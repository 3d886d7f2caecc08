"""Streaming queries: every job reads the event table as a file stream and drains it."""

from __future__ import annotations

from pyspark.sql import functions as F

from gearwatch.catalog.base import SENSORS, TEL, TIE, machines, query, r6, scored, table, telemetry
from gearwatch.operators import series
from gearwatch.plans import training
from gearwatch.streaming import jobs, keyed, progress


def stream(spark, d):
    """The scored event table as a stream."""
    schema = table(spark, d, "events").schema
    raw = jobs.read_stream(spark, d, schema, "events.parquet", ts=("ts",))
    return as_readings(raw)


#: The event table as four files that arrive one after the other.
SLICES = 4
_SLICE = f"CAST(event_id * {SLICES} // (SELECT max(event_id) + 1 FROM events) AS BIGINT)"


def sliced(spark, d, delayed=None, repeated=None, closing=False):
    """The scored events as a stream of ``SLICES`` files in the order of time, one per micro-batch.

    ``delayed`` rows come one slice later than their time, ``repeated`` ones once more in the next slice; ``closing`` adds a
    reading of a machine of its own long after all others, which moves the watermark over the rest. Both conditions may use
    ``at``, the place of a row inside its slice (0 to 1).
    """
    events = table(spark, d, "events")
    place = F.col("event_id") * F.lit(SLICES) / (events.agg(F.max("event_id")).scalar() + 1)
    rows = events.withColumns({"_slice": F.floor(place), "at": place - F.floor(place)})
    own = rows.withColumn("_slice", F.col("_slice") + F.when(F.expr(delayed), 1).otherwise(0)) if delayed else rows
    if repeated:
        own = own.unionByName(rows.filter(repeated).withColumn("_slice", F.col("_slice") + 1))
    folder = jobs.work_folder(spark, "slices")[0]
    for k in range(SLICES + 1):
        own.filter(F.col("_slice") == k).drop("_slice", "at").coalesce(1).write.parquet(f"{folder}/s{k}")
    if closing:
        last = events.agg(*[F.max(c).alias(c) for c in events.columns]).withColumns(
            {"event_id": F.lit(-1).cast("long"), "user_id": F.lit(-1).cast("long"), "ts": F.col("ts") + F.expr("INTERVAL 400 DAYS")})
        last.select(events.columns).write.parquet(f"{folder}/s{SLICES + 1}")
    raw = jobs.read_stream(spark, f"{folder}/s*", events.schema, "*.parquet", files_per_batch=1, ts=("ts",))
    return as_readings(raw)


def as_readings(raw):
    return raw.select(
        "event_id", F.col("user_id").alias("machineID"), F.col("ts").alias("datetime"), F.col("value").alias("volt"),
        F.get_json_object("props", "$.k").cast("double").alias("rotate"), F.least(F.col("value") / 500, F.lit(1.0)).alias("p"),
        (F.col("event_type") == "signup").cast("int").alias("y"), "event_type")


#: Rows that come a slice later than their time, within the watermark of a day.
NEAR_THE_END = "at > 0.97 AND event_id % 2 = 0"


def _text(df, *cols):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in cols})


@query("j1_score_stream")
def score_stream(spark, d):
    model = training.fit(scored(spark, d), training.get_model("logistic_regression", SENSORS))
    sink, checkpoint = jobs.work_folder(spark, "j1")
    source = stream(spark, d).select("event_id", "machineID", "datetime", *SENSORS)
    jobs.with_state(source, jobs.score_batches(model, lambda b: series.cold_start(b, SENSORS)), sink, checkpoint)
    return spark.read.parquet(f"{sink}/out/b=*").select("event_id", F.round("p", 6).alias("p"))


@query("j2_live_metrics", f"""WITH {TEL} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS readings, count(*) FILTER (p > 0.6) AS high_risk,
 round(count(*) FILTER (p > 0.6) * 100.0 / count(*), 6) AS high_risk_pct, round((1 - avg(p)) * 100, 6) AS health FROM tel GROUP BY 1""")
def live_metrics(spark, d):
    sink, checkpoint = jobs.work_folder(spark, "j2")
    out = jobs.drain(jobs.live_metrics(stream(spark, d), 0.6), sink, checkpoint, "update")
    return r6(_text(jobs.newest_update(out, ["window_start"]), "window_start").drop("machines"))


@query("j3_last_readings", f"""WITH {TEL} SELECT machineID AS "machineID", event_id, volt FROM tel QUALIFY row_number() OVER (PARTITION BY machineID ORDER BY ts DESC, event_id DESC) <= 100""")
def last_readings(spark, d):
    sink, checkpoint = jobs.work_folder(spark, "j3")
    source = stream(spark, d).select("machineID", F.unix_micros("datetime").alias("t"), "event_id", "volt")
    out = jobs.drain(jobs.last_readings(source, 100), sink, checkpoint, "update")
    latest = out.groupBy("machineID").agg(F.max("_batch").alias("_batch"))
    return out.join(latest, ["machineID", "_batch"]).select("machineID", "event_id", "volt")


@query("j4_keyed_features", f"""WITH {TEL} SELECT event_id, lag(volt, 3) OVER w AS volt_lag_3h,
 round(CASE WHEN count(volt) OVER f = 6 THEN avg(volt) OVER f END, 6) AS volt_mean_6h FROM tel
 WINDOW w AS (PARTITION BY machineID ORDER BY ts, event_id), f AS (PARTITION BY machineID ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""")
def keyed_features(spark, d):
    sink, checkpoint = jobs.work_folder(spark, "j4")
    source = sliced(spark, d, delayed=NEAR_THE_END, closing=True).select("event_id", "machineID", "datetime", "volt")
    out = keyed.row_feature_stream(source, ["volt"], tie=TIE, late="1 day", lags=[3], means=[6], stds=[], slopes=[])
    return r6(jobs.drain(out, sink, checkpoint).select("event_id", "volt_lag_3h", "volt_mean_6h").filter("event_id >= 0"))


@query("j4_stateful_features", f"""WITH {TEL} SELECT event_id, lag(volt, 3) OVER w AS volt_lag_3h,
 round(CASE WHEN count(volt) OVER f = 6 THEN avg(volt) OVER f END, 6) AS volt_mean_6h FROM tel
 WINDOW w AS (PARTITION BY machineID ORDER BY ts, event_id), f AS (PARTITION BY machineID ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""")
def stateful_features(spark, d):
    sink, checkpoint = jobs.work_folder(spark, "j4b")
    source = sliced(spark, d).select("event_id", "machineID", "datetime", "volt")
    jobs.with_state(source, jobs.stateful_features(["volt"], ["datetime", "event_id"]), sink, checkpoint)
    return r6(spark.read.parquet(f"{sink}/out/b=*").select("event_id", "volt_lag_3h", "volt_mean_6h"))


@query("j5_critical_alerts", f"""WITH {TEL} SELECT DISTINCT machineID AS "machineID", strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start FROM tel WHERE p > 0.6""")
def critical_alerts(spark, d):
    sink, checkpoint = jobs.work_folder(spark, "j5")
    return _text(jobs.drain(jobs.critical_alerts(stream(spark, d), 0.6), sink, checkpoint), "window_start").select("machineID", "window_start")


@query("j6_daily_digest", f"""WITH {TEL} SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) FILTER (p >= 0.8) AS critical,
 count(*) FILTER (p >= 0.6 AND p < 0.8) AS warning, count(*) FILTER (p < 0.6) AS normal, round(max(p), 6) AS max_p FROM tel GROUP BY 1""")
def daily_digest(spark, d):
    sink, checkpoint = jobs.work_folder(spark, "j6")
    out = jobs.drain(jobs.alert_digest(stream(spark, d), "Daily"), sink, checkpoint, "update")
    return r6(_text(jobs.newest_update(out, ["window_start"]), "window_start"))


@query("j6_immediate", f"WITH {TEL} SELECT event_id, CASE WHEN p >= 0.8 THEN 'Critical' ELSE 'Warning' END AS risk_level FROM tel WHERE p >= 0.6")
def immediate(spark, d):
    sink, checkpoint = jobs.work_folder(spark, "j6i")
    return jobs.drain(jobs.alert_digest(stream(spark, d), "Immediate"), sink, checkpoint).select("event_id", "risk_level")


_LIMIT = """WITH RECURSIVE n AS (SELECT event_id, event_type AS key, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events),
 r AS (SELECT key, event_id, rn, [t] AS acc, true AS allowed FROM n WHERE rn = 1
  UNION ALL SELECT n.key, n.event_id, n.rn, CASE WHEN len([a FOR a IN r.acc IF n.t - a < 3600000000]) < 2 THEN list_append([a FOR a IN r.acc IF n.t - a < 3600000000], n.t)
   ELSE [a FOR a IN r.acc IF n.t - a < 3600000000] END, len([a FOR a IN r.acc IF n.t - a < 3600000000]) < 2 FROM r JOIN n ON n.key = r.key AND n.rn = r.rn + 1)
 SELECT event_id, key, allowed FROM r"""


@query("j7_rate_limit", _LIMIT)
def rate_limit(spark, d):
    calls = table(spark, d, "events").select("event_id", F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("datetime"))
    return jobs.rate_limit(calls, 2, 3600.0, tie=["event_id"]).select("event_id", "key", "allowed")


@query("j7_rate_limit_stream", _LIMIT)
def rate_limit_stream(spark, d):
    sink, checkpoint = jobs.work_folder(spark, "j7")
    source = sliced(spark, d).select("event_id", F.col("event_type").alias("key"), "datetime")
    jobs.with_state(source, jobs.rate_limit_step(2, 3600.0, tie=["event_id"]), sink, checkpoint)
    return spark.read.parquet(f"{sink}/out/b=*").select("event_id", "key", "allowed")


@query("j7_keyed_rate_limit", _LIMIT)
def keyed_rate_limit(spark, d):
    sink, checkpoint = jobs.work_folder(spark, "j7")
    source = sliced(spark, d, delayed=NEAR_THE_END, closing=True).select("event_id", F.col("event_type").alias("key"), "datetime")
    out = keyed.rate_limit(source, 2, 3600.0, tie=TIE, late="1 day")
    return jobs.drain(out, sink, checkpoint).select("event_id", "key", "allowed").filter("event_id >= 0")


@query("j7_wait", _LIMIT.replace("SELECT event_id, key, allowed FROM r", "SELECT r.event_id, CASE WHEN allowed THEN 0.0 ELSE round((list_min(acc) + 3600000000 - t) / 1e6, 6) END AS wait FROM r JOIN n USING (event_id)"))
def rate_limit_wait(spark, d):
    """How long a denied call has to wait for the next free place."""
    sink, checkpoint = jobs.work_folder(spark, "j7w")
    source = sliced(spark, d, closing=True).select("event_id", F.col("event_type").alias("key"), "datetime")
    out = keyed.rate_limit(source, 2, 3600.0, tie=TIE, late="1 day")
    return r6(jobs.drain(out, sink, checkpoint).filter("event_id >= 0").select("event_id", "wait"))


@query("j8_enrich_static", """SELECT e.event_id, c.c_mktsegment AS model, c.c_nationkey AS age FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id""")
def enrich_static(spark, d):
    sink, checkpoint = jobs.work_folder(spark, "j8")
    return jobs.drain(jobs.enrich(stream(spark, d), machines(spark, d)), sink, checkpoint).select("event_id", "model", "age")


@query("j8_join_events", f"""WITH {TEL} SELECT t.event_id, e.event_id AS error_id FROM tel t JOIN tel e ON e.machineID = t.machineID AND e.event_type = 'error'
 AND e.ts <= t.ts AND e.ts >= t.ts - INTERVAL 24 HOUR""")
def join_events(spark, d):
    sink, checkpoint = jobs.work_folder(spark, "j8e")
    events = stream(spark, d).filter("event_type = 'error'").select(
        "machineID", F.col("datetime").alias("event_time"), F.col("event_id").alias("error_id"))
    return jobs.drain(jobs.join_events(stream(spark, d), events), sink, checkpoint).select("event_id", "error_id")


@query("j9_without_repeats", "SELECT event_id FROM events")
def without_repeats(spark, d):
    sink, checkpoint = jobs.work_folder(spark, "j9")
    again = sliced(spark, d, repeated="at > 0.97")
    return jobs.drain(jobs.without_repeats(again, TIE, "1 day"), sink, checkpoint).select("event_id")


@query("j9_late_rows", f"""WITH s AS (SELECT event_id, ts, {_SLICE} + CASE WHEN event_id % 10 = 3 THEN 1 ELSE 0 END AS k FROM events),
 m AS (SELECT k, max(max(ts)) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM s GROUP BY k)
 SELECT event_id, coalesce(ts < newest - INTERVAL 2 HOUR, false) AS late FROM s JOIN m USING (k)""")
def late_rows(spark, d):
    sink, checkpoint = jobs.work_folder(spark, "j9l")
    jobs.with_state(sliced(spark, d, delayed="event_id % 10 = 3"), jobs.count_late(2), sink, checkpoint)
    return spark.read.parquet(f"{sink}/out/b=*").select("event_id", "late")


@query("m_stream_progress", f"""WITH {TEL}, s AS (SELECT p, {_SLICE.replace('event_id *', 'tel.event_id *')} AS batch FROM tel)
 SELECT batch, count(*) AS input_rows, count(*) AS readings, count(*) FILTER (p > 0.6) AS high_risk FROM s GROUP BY 1""")
def stream_progress(spark, d):
    """What each micro-batch of the live metrics saw, from the table that a listener writes."""
    sink, checkpoint = jobs.work_folder(spark, "m")
    seen = progress.observed(sliced(spark, d), "live", readings=F.count(F.lit(1)), high_risk=F.count_if(F.col("p") > 0.6))
    _, log = progress.logged(spark, jobs.work_folder(spark, "progress")[0],
                             lambda: jobs.drain(jobs.live_metrics(seen, 0.6), sink, checkpoint, "update"))
    part = F.from_json("metrics", "live struct<readings: long, high_risk: long>")["live"]
    return log.filter("input_rows > 0").select("batch", "input_rows", part["readings"].alias("readings"), part["high_risk"].alias("high_risk"))


@query("j10_silence_sessions", f"""WITH {TEL}, g AS (SELECT machineID, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS s FROM tel WINDOW w AS (PARTITION BY machineID ORDER BY ts)),
 n AS (SELECT *, sum(s) OVER (PARTITION BY machineID ORDER BY ts) AS k FROM g)
 SELECT machineID AS "machineID", strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts) + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S') AS ended, count(*) AS readings FROM n GROUP BY machineID, k""")
def silence_sessions(spark, d):
    return _text(jobs.silence_sessions(telemetry(spark, d)), "started", "ended")


@query("j10_silence_sessions_stream")
def silence_sessions_stream(spark, d):
    sink, checkpoint = jobs.work_folder(spark, "j10")
    return jobs.drain(jobs.silence_sessions(stream(spark, d), late="2 hours"), sink, checkpoint)
