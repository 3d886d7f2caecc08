"""Feature, label and as-of queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gearwatch import schemas as S
from gearwatch.catalog.base import COMPS, ERRORS, SENSORS, TEL, TIE, errors, failures, machines, maint, query, r6, table, telemetry
from gearwatch.operators import asof, series
from gearwatch.plans.features import feature_table

KEY, ORDER = ["machineID"], ["datetime", "event_id"]


def _feature_sql(sensors=SENSORS) -> str:
    cols = []
    for s in sensors:
        cols += [f"lag({s}, {k}) OVER w AS {s}_lag_{k}h" for k in S.LAGS]
        for k in S.ROLL_MEANS:
            frame = f"OVER (PARTITION BY machineID ORDER BY ts, event_id ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
            cols.append(f"round(CASE WHEN count({s}) {frame} = {k} THEN avg({s}) {frame} END, 6) AS {s}_mean_{k}h")
        for k in S.ROLL_STDS:
            frame = f"OVER (PARTITION BY machineID ORDER BY ts, event_id ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
            cols.append(f"round(CASE WHEN count({s}) {frame} = {k} THEN stddev_pop({s}) {frame} END, 6) AS {s}_std_{k}h")
        cols += [f"round(({s} - lag({s}, {k}) OVER w) / {k}, 6) AS {s}_slope_{k}h" for k in S.SLOPES]
    return ", ".join(cols)


def _last(kind: str) -> str:
    return (f"max(CASE WHEN event_type = '{kind}' THEN ts END) OVER "
            "(PARTITION BY machineID ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")


def _flag(kind: str, h: int) -> str:
    return f"CASE WHEN date_diff('microsecond', {_last(kind)}, ts) <= {h} * 3600000000 THEN 1 ELSE 0 END AS {kind}_last_{h}h"


def _age(comp: str) -> list[str]:
    hours = f"date_diff('microsecond', {_last(comp)}, ts) / 3600000000.0"
    return [f"round({hours}, 6) AS time_since_maint_{comp}_h", f"round({hours} / 24.0, 6) AS time_since_maint_{comp}_d"]


_FLAGS = ", ".join(_flag(e, h) for e in ERRORS for h in S.HORIZONS)
_AGES = ", ".join(c for comp in COMPS for c in _age(comp))
_WILL = ", ".join(
    f"CAST(EXISTS (SELECT 1 FROM tel f WHERE f.machineID = t.machineID AND f.event_type = 'signup' AND f.ts >= t.ts "
    f"AND f.ts <= t.ts + INTERVAL {h} HOUR) AS INT) AS will_fail_in_{h}h"
    for h in S.HORIZONS
)
_WINDOW = "WINDOW w AS (PARTITION BY machineID ORDER BY ts, event_id)"


def flagship(spark, d, hot_rows=series.HOT_ROWS):
    full = feature_table(
        telemetry(spark, d), errors(spark, d), maint(spark, d), failures(spark, d), machines(spark, d),
        SENSORS, ERRORS, COMPS, tiebreak=TIE, hot_rows=hot_rows,
    )
    return r6(full.drop("datetime"))


query("feature_table_full", f"""WITH {TEL},
 f AS (SELECT event_id, machineID, volt, rotate, {_feature_sql()}, {_FLAGS}, {_AGES} FROM tel {_WINDOW}),
 l AS (SELECT event_id, {_WILL} FROM tel t)
 SELECT f.*, l.* EXCLUDE (event_id), c.c_mktsegment AS model, c.c_nationkey AS age
 FROM f JOIN l USING (event_id) LEFT JOIN customer c ON c.c_custkey = f.machineID""")(flagship)


@query("e1_e4_sensor_features", f"WITH {TEL} SELECT event_id, {_feature_sql()} FROM tel {_WINDOW}")
def sensor_features(spark, d):
    out = series.sensor_features(telemetry(spark, d), SENSORS, KEY, ORDER)
    return r6(out.drop("machineID", "datetime", *SENSORS))


@query("c1_machine_metadata", """SELECT e.event_id, e.user_id AS "machineID", c.c_mktsegment AS model, c.c_nationkey AS age
 FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id""")
def machine_metadata(spark, d):
    return asof.with_machines(telemetry(spark, d), machines(spark, d)).select("event_id", "machineID", "model", "age")


@query("c1_duplicate_keys", "SELECT user_id AS \"machineID\", count(*) AS \"count\" FROM events GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return asof.duplicate_keys(telemetry(spark, d))


@query("c2_failure_horizons", f"WITH {TEL} SELECT event_id, {_WILL} FROM tel t")
def failure_horizons(spark, d):
    out = asof.add_history(telemetry(spark, d), failures=failures(spark, d))
    return out.select("event_id", "will_fail_in_24h", "will_fail_in_48h")


@query("c3_error_flags", "WITH " + TEL + " SELECT event_id, " + ", ".join(
    f"CAST(EXISTS (SELECT 1 FROM tel f WHERE f.machineID = t.machineID AND f.event_type = '{e}' AND f.ts <= t.ts "
    f"AND f.ts >= t.ts - INTERVAL {h} HOUR) AS INT) AS {e}_last_{h}h" for e in ERRORS for h in S.HORIZONS
) + " FROM tel t")
def error_flags(spark, d):
    out = asof.add_history(telemetry(spark, d), errors=errors(spark, d), error_types=ERRORS)
    return out.drop("machineID", "datetime", *SENSORS)


@query("c4_maintenance_age", f"""WITH {TEL},
 a AS (SELECT t.event_id, date_diff('microsecond', m.ts, t.ts) / 3600000000.0 AS h
       FROM tel t ASOF LEFT JOIN (SELECT machineID, ts FROM tel WHERE event_type = 'purchase') m
       ON t.machineID = m.machineID AND t.ts >= m.ts),
 b AS (SELECT t.event_id, date_diff('microsecond', m.ts, t.ts) / 3600000000.0 AS h
       FROM tel t ASOF LEFT JOIN (SELECT machineID, ts FROM tel WHERE event_type = 'click') m
       ON t.machineID = m.machineID AND t.ts >= m.ts)
 SELECT a.event_id, round(a.h, 6) AS time_since_maint_purchase_h, round(a.h / 24.0, 6) AS time_since_maint_purchase_d,
   round(b.h, 6) AS time_since_maint_click_h, round(b.h / 24.0, 6) AS time_since_maint_click_d
 FROM a JOIN b USING (event_id)""")
def maintenance_age(spark, d):
    out = asof.add_history(telemetry(spark, d), maint=maint(spark, d), comps=COMPS)
    return r6(out.drop("machineID", "datetime", *SENSORS))


def _asof(spark, d, direction, tolerance_us=None):
    left = telemetry(spark, d)
    right = table(spark, d, "events").filter("event_type = 'error'").select(
        F.col("user_id").alias("machineID"), F.col("ts").cast("timestamp").alias("datetime"),
        F.col("event_id").alias("error_event"), F.col("value").alias("error_value"))
    out = asof.asof_join(left, right, "datetime", ["machineID"], ["error_event", "error_value"], direction,
                         tolerance_us, ["error_event"])
    return out.select("event_id", "error_event", "error_value")


_RIGHT = "(SELECT machineID, ts, event_id AS error_event, volt AS error_value FROM tel WHERE event_type = 'error')"


@query("c5_asof_backward", f"""WITH {TEL} SELECT t.event_id, r.error_event, r.error_value FROM tel t
 ASOF LEFT JOIN {_RIGHT} r ON t.machineID = r.machineID AND t.ts >= r.ts""")
def asof_backward(spark, d):
    return _asof(spark, d, "backward")


@query("c5_asof_forward_12h", f"""WITH {TEL} SELECT t.event_id,
 CASE WHEN r.ts <= t.ts + INTERVAL 12 HOUR THEN r.error_event END AS error_event,
 CASE WHEN r.ts <= t.ts + INTERVAL 12 HOUR THEN r.error_value END AS error_value FROM tel t
 ASOF LEFT JOIN {_RIGHT} r ON t.machineID = r.machineID AND t.ts <= r.ts""")
def asof_forward(spark, d):
    return _asof(spark, d, "forward", 12 * series.HOUR)


@query("c5_asof_nearest", f"""WITH {TEL},
 pairs AS (SELECT t.event_id, r.error_event, r.error_value,
   row_number() OVER (PARTITION BY t.event_id ORDER BY abs(date_diff('microsecond', t.ts, r.ts)), r.ts) AS rn
   FROM tel t JOIN {_RIGHT} r ON t.machineID = r.machineID)
 SELECT t.event_id, p.error_event, p.error_value FROM tel t LEFT JOIN (SELECT * FROM pairs WHERE rn = 1) p USING (event_id)""")
def asof_nearest(spark, d):
    return _asof(spark, d, "nearest")


@query("e5_ols_slope", f"WITH {TEL} SELECT event_id, " + ", ".join(
    f"round(CASE WHEN count(*) OVER p{k} = {k} THEN regr_slope({s}, rn) OVER p{k} END, 6) AS {s}_ols_{k}h"
    for s in SENSORS for k in S.SLOPES
) + " FROM (SELECT *, CAST(row_number() OVER (PARTITION BY machineID ORDER BY ts, event_id) AS DOUBLE) AS rn FROM tel) WINDOW "
  + ", ".join(f"p{k} AS (PARTITION BY machineID ORDER BY ts, event_id ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)" for k in S.SLOPES))
def ols_slope(spark, d):
    return r6(series.ols_slopes(telemetry(spark, d), SENSORS, S.SLOPES, KEY, ORDER).drop("machineID", "datetime", *SENSORS))


# Gaps for the fill query: rotate is treated as missing below 60.
_GAP = "CASE WHEN rotate >= 60 THEN rotate END"


@query("e6_fill_gaps", f"""WITH {TEL},
 g AS (SELECT event_id, machineID, {_GAP} AS x, row_number() OVER (PARTITION BY machineID ORDER BY ts, event_id) AS pos FROM tel),
 n AS (SELECT *, max(CASE WHEN x IS NOT NULL THEN pos END) OVER (PARTITION BY machineID ORDER BY pos) AS pp,
   min(CASE WHEN x IS NOT NULL THEN pos END) OVER (PARTITION BY machineID ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS np FROM g)
 SELECT n.event_id, round(CASE WHEN n.x IS NOT NULL THEN n.x WHEN n.pos - n.pp <= 5 THEN a.x
   WHEN n.pp IS NOT NULL AND n.np IS NOT NULL THEN a.x + (b.x - a.x) * (n.pos - (n.pp + 5)) / (n.np - (n.pp + 5))
   WHEN n.pp IS NOT NULL THEN a.x ELSE (SELECT avg(x) FROM g) END, 6) AS rotate
 FROM n LEFT JOIN g a ON a.machineID = n.machineID AND a.pos = n.pp LEFT JOIN g b ON b.machineID = n.machineID AND b.pos = n.np""")
def fill_gaps(spark, d):
    holes = telemetry(spark, d).withColumn("rotate", F.when(F.col("rotate") >= 60, F.col("rotate")))
    return r6(series.fill_gaps(holes, ["rotate"], 5, KEY, ORDER).select("event_id", "rotate"))


def _cold_sql() -> str:
    cols = []
    for s in SENSORS:
        cols += [f"{s} AS {s}_lag_{k}h" for k in S.LAGS] + [f"{s} AS {s}_mean_{k}h" for k in S.ROLL_MEANS]
        cols += [f"0.0::DOUBLE AS {s}_std_{k}h" for k in S.ROLL_STDS] + [f"0.0::DOUBLE AS {s}_slope_{k}h" for k in S.SLOPES]
    cols += [f"0 AS {e}_last_{h}h" for e in S.ERROR_TYPES for h in S.HORIZONS]
    cols += [f"{v}::DOUBLE AS time_since_maint_{c}_{u}" for c in S.COMPONENTS for u, v in (("h", 48.0), ("d", 2.0))]
    return ", ".join(cols)


@query("e7_e8_cold_start", f"WITH {TEL} SELECT event_id, {_cold_sql()} FROM tel")
def cold_start(spark, d):
    return series.cold_start(telemetry(spark, d), SENSORS).drop("machineID", "datetime", *SENSORS)


@query("e9_latest_reading", f"""WITH {TEL} SELECT event_id, "machineID", volt, rotate FROM (
 SELECT *, row_number() OVER (PARTITION BY machineID ORDER BY ts DESC, event_id DESC) AS rn FROM tel) WHERE rn = 1""")
def latest_reading(spark, d):
    return series.latest(telemetry(spark, d), KEY, ORDER).select("event_id", "machineID", "volt", "rotate")


@query("e11_last_100_readings", f"""WITH {TEL} SELECT event_id, "machineID", volt FROM (
 SELECT *, row_number() OVER (PARTITION BY machineID ORDER BY ts DESC, event_id DESC) AS rn FROM tel) WHERE rn <= 100""")
def last_readings(spark, d):
    return series.last_n(telemetry(spark, d), 100, KEY, ORDER).select("event_id", "machineID", "volt")


@query("e16_step_delta", f"WITH {TEL} SELECT event_id, " + ", ".join(
    f"round({s} - lag({s}) OVER w, 6) AS {s}_delta" for s in SENSORS) + f" FROM tel {_WINDOW}")
def step_delta(spark, d):
    return r6(series.step_delta(telemetry(spark, d), SENSORS, KEY, ORDER).drop("machineID", "datetime", *SENSORS))


def _time_sql() -> str:
    cols = []
    for s in SENSORS:
        for k in (3, 24):
            frame = f"(PARTITION BY machineID ORDER BY ts RANGE BETWEEN INTERVAL '{k * 3600 - 1}.999999 seconds' PRECEDING AND CURRENT ROW)"
            cols += [f"round(avg({s}) OVER {frame}, 6) AS {s}_tmean_{k}h", f"round(stddev_pop({s}) OVER {frame}, 6) AS {s}_tstd_{k}h"]
            cols.append(f"(SELECT arg_max(o.{s}, o.ts) FROM tel o WHERE o.machineID = t.machineID AND o.ts <= t.ts - INTERVAL {k} HOUR "
                        f"AND o.ts >= t.ts - INTERVAL {2 * k} HOUR) AS {s}_tlag_{k}h")
    return ", ".join(cols)


@query("e17_time_features", f"WITH {TEL} SELECT event_id, {_time_sql()} FROM tel t")
def time_features(spark, d):
    out = series.time_features(telemetry(spark, d), SENSORS, [3, 24], KEY)
    return r6(out.drop("machineID", "datetime", *SENSORS))


@query("g2_history_and_new_rows", f"""WITH {TEL}, c AS (SELECT max(ts) - INTERVAL 2 DAY AS cut FROM tel)
 SELECT event_id, round(CASE WHEN count(volt) OVER f = 24 THEN avg(volt) OVER f END, 6) AS volt_mean_24h
 FROM tel WINDOW f AS (PARTITION BY machineID ORDER BY ts, event_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)
 QUALIFY ts > (SELECT cut FROM c)""")
def history_and_new_rows(spark, d):
    tel = telemetry(spark, d)
    cut = tel.agg((F.max("datetime") - F.expr("INTERVAL 2 DAYS")).alias("cut")).scalar()
    new = tel.filter(F.col("datetime") > cut).withColumn("new", F.lit(True))
    history = series.last_n(tel.filter(F.col("datetime") <= cut), 48, KEY, ORDER).withColumn("new", F.lit(False))
    out = series.sensor_features(history.unionByName(new), ["volt"], KEY, ORDER)
    return r6(out.filter("new").select("event_id", "volt_mean_24h"))


@query("h9_sensor_series", f"WITH {TEL} SELECT event_id, \"machineID\", volt FROM tel ORDER BY ts, event_id")
def sensor_series(spark, d):
    return telemetry(spark, d).select("event_id", "machineID", "volt", "datetime").orderBy(*ORDER).drop("datetime")
