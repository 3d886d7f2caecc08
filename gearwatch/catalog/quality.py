"""Quality, overview and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gearwatch import schemas as S
from gearwatch.catalog.base import COMPS, ERRORS, SENSORS, TEL, errors, failures, query, r6, scored, table, telemetry
from gearwatch.functions import tiers
from gearwatch.operators import asof, prefix, quality, report, series

ORDER = ["datetime", "event_id"]
_NULLED = "SELECT event_id, machineID, ts, volt, nullif(rotate, 0) AS rotate FROM tel"


def gappy(spark, d):
    """Telemetry whose second sensor has gaps."""
    return telemetry(spark, d).withColumn("rotate", F.nullif(F.col("rotate"), F.lit(0.0)))


def _labelled(spark, d):
    tel = telemetry(spark, d)
    return asof.add_history(tel, failures=failures(spark, d))


_LAB = f"""{TEL}, lab AS (SELECT t.*, CAST(EXISTS (SELECT 1 FROM tel f WHERE f.machineID = t.machineID AND f.event_type = 'signup'
  AND f.ts >= t.ts AND f.ts <= t.ts + INTERVAL 24 HOUR) AS INT) AS will_fail_in_24h,
  CAST(EXISTS (SELECT 1 FROM tel f WHERE f.machineID = t.machineID AND f.event_type = 'signup'
  AND f.ts >= t.ts AND f.ts <= t.ts + INTERVAL 48 HOUR) AS INT) AS will_fail_in_48h FROM tel t)"""


@query("a3_null_profile", f"""WITH {TEL}, g AS ({_NULLED}), u AS (SELECT count(*) AS n, count(*) - count(volt) AS volt,
 count(*) - count(rotate) AS rotate FROM g)
 SELECT 'volt' AS column_name, n AS "rows", volt AS nulls, round(volt * 100.0 / n, 6) AS null_pct FROM u
 UNION ALL SELECT 'rotate', n, rotate, round(rotate * 100.0 / n, 6) FROM u""")
def null_profile(spark, d):
    df = quality.require_columns(gappy(spark, d), ["volt", "rotate"])
    return r6(quality.null_profile(df.select("volt", "rotate")))


@query("a4_distinct_rows", "SELECT DISTINCT user_id AS \"machineID\", event_type FROM events")
def distinct_rows(spark, d):
    return quality.sort_and_clean(table(spark, d, "events").select(F.col("user_id").alias("machineID"), "event_type"))


@query("b1_defaults", "SELECT event_id, CAST(18 AS INT) AS age, CASE WHEN event_type IN ('error', 'view') THEN event_type ELSE 'model1' END AS model FROM events")
def defaults(spark, d):
    df = table(spark, d, "events").select("event_id", F.when(F.col("event_type").isin(ERRORS), F.col("event_type")).alias("model"))
    return tiers.with_defaults(df, {"model": S.DEFAULT_MODEL, "age": S.DEFAULT_AGE})


@query("b2_lenient_timestamp", """SELECT event_id, try_strptime(CASE WHEN event_type = 'error' THEN 'bad' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END,
 '%Y-%m-%d %H:%M:%S') IS NOT NULL AS parsed FROM events""")
def lenient_timestamp(spark, d):
    raw = table(spark, d, "events").select(
        "event_id", F.when(F.col("event_type") == "error", "bad").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("t"))
    return tiers.parse_ts(raw, ["t"]).select("event_id", F.col("t").isNotNull().alias("parsed"))


@query("b4_date_range", "SELECT event_id, user_id AS \"machineID\" FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-10'")
def date_range(spark, d):
    return report.between_dates(telemetry(spark, d), "2024-01-05", "2024-01-10").select("event_id", "machineID")


@query("b10_float32", "SELECT event_id::FLOAT AS event_id, round(value::FLOAT::DOUBLE, 4) AS value FROM events")
def float32(spark, d):
    return tiers.to_float32(table(spark, d, "events").select("event_id", "value")).withColumn(
        "value", F.round(F.col("value").cast("double"), 4))


@query("d1_class_balance", """SELECT event_type AS label, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct,
 round(max(count(*)) OVER () / count(*), 6) AS imbalance FROM events GROUP BY event_type""")
def class_balance(spark, d):
    return r6(quality.class_balance(table(spark, d, "events"), "event_type"))


@query("d2_overview", f"""WITH {TEL}, g AS ({_NULLED}) SELECT count(*) AS "rows", count(DISTINCT machineID) AS machines,
 CAST(floor(date_diff('microsecond', min(ts), max(ts)) / 86400000000.0) AS BIGINT) AS span_days,
 round((count(*) - count(rotate)) * 100.0 / (count(*) * 5), 6) AS missing_pct FROM g""")
def overview(spark, d):
    return r6(quality.overview(gappy(spark, d)))


def _sensor_union(select: str) -> str:
    return " UNION ALL ".join(select.format(s=s) for s in SENSORS)


@query("d3_sensor_quality", f"WITH {TEL}, g AS ({_NULLED}) " + _sensor_union(
    "SELECT '{s}' AS sensor, round((count(*) - count({s})) * 100.0 / count(*), 6) AS missing_pct, round(avg({s}), 6) AS mean, "
    "round(stddev_samp({s}), 6) AS std, min({s}) AS min, max({s}) AS max FROM g"))
def sensor_quality(spark, d):
    return r6(quality.sensor_quality(gappy(spark, d), SENSORS))


@query("d4_eight_numbers", f"WITH {TEL}, g AS ({_NULLED}) " + _sensor_union(
    "SELECT '{s}' AS sensor, count(*) AS count, round(avg({s}), 6) AS mean, round(stddev_samp({s}), 6) AS std, min({s}) AS min, "
    "max({s}) AS max, round(quantile_cont({s}, 0.25), 6) AS q25, round(quantile_cont({s}, 0.5), 6) AS q50, "
    "round(quantile_cont({s}, 0.75), 6) AS q75 FROM g"))
def eight_numbers(spark, d):
    return r6(quality.eight_numbers(gappy(spark, d), SENSORS))


@query("d5_correlations", f"WITH {TEL}, g AS ({_NULLED}) " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM g" for a in SENSORS for b in SENSORS))
def correlations(spark, d):
    return r6(quality.correlations(gappy(spark, d), SENSORS))


@query("d6_null_and_duplicates", """WITH e AS (SELECT user_id, event_type, nullif(CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) % 7, 0) AS k FROM events)
 SELECT CAST(count(*) AS BIGINT) AS "rows", CAST(count(*) - count(k) AS BIGINT) AS null_cells,
 CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM e)) AS BIGINT) AS duplicate_rows FROM e""")
def null_and_duplicates(spark, d):
    k = F.get_json_object("props", "$.k").cast("int") % 7
    return quality.null_and_duplicate_totals(
        table(spark, d, "events").select("user_id", "event_type", F.nullif(k, F.lit(0)).alias("k")))


@query("d6_columns_with_nulls", f"""WITH {TEL}, g AS ({_NULLED}) SELECT 'rotate' AS column_name, count(*) AS "rows",
 count(*) - count(rotate) AS nulls, round((count(*) - count(rotate)) * 100.0 / count(*), 6) AS null_pct FROM g
 HAVING count(*) > count(rotate)""")
def columns_with_nulls(spark, d):
    return r6(quality.columns_with_nulls(gappy(spark, d)))


@query("d7_frequencies", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def frequencies(spark, d):
    return quality.frequencies(table(spark, d, "events"), "event_type")


@query("d8_cross_counts", "SELECT user_id, " + ", ".join(
    f"count(*) FILTER (event_type = '{v}') AS \"{v}\"" for v in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY user_id")
def cross_counts(spark, d):
    return quality.cross_counts(table(spark, d, "events"), "user_id", "event_type", ["click", "error", "purchase", "signup", "view"])


_HIST = """, e AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
 c AS (SELECT least(CAST(floor((x - lo) / ((hi - lo) / {n})) AS INT), {n} - 1) AS bin, count(*) AS n FROM v, e WHERE x IS NOT NULL GROUP BY 1)
 SELECT CAST(s.bin AS INT) AS bin, round(lo + s.bin * ((hi - lo) / {n}), 6) AS lo, round(lo + (s.bin + 1) * ((hi - lo) / {n}), 6) AS hi,
 coalesce(c.n, 0) AS n FROM range({n}) s(bin) CROSS JOIN e LEFT JOIN c ON c.bin = s.bin"""


@query("d9_daily_event_histogram", "WITH v AS (SELECT CAST(count(*) AS DOUBLE) AS x FROM events GROUP BY CAST(ts AS DATE))" + _HIST.format(n=20))
def daily_event_histogram(spark, d):
    return r6(prefix.histogram(quality.events_per_day(table(spark, d, "events"), "ts"), "n", 20))


@query("d10_histogram", "WITH v AS (SELECT value AS x FROM events)" + _HIST.format(n=50))
def histogram(spark, d):
    return r6(prefix.histogram(telemetry(spark, d), "volt", 50))


@query("d11_failure_rate_by_day", f"WITH {_LAB} SELECT CAST(ts AS DATE) AS day, round(avg(will_fail_in_24h), 6) AS rate, count(*) AS n FROM lab GROUP BY 1")
def failure_rate_by_day(spark, d):
    return r6(report.rate_by(_labelled(spark, d), F.to_date("datetime").alias("day"), "will_fail_in_24h"))


@query("d11_failure_rollup", f"""WITH {_LAB} SELECT c.c_mktsegment AS model, machineID AS "machineID", round(avg(will_fail_in_24h), 6) AS rate, count(*) AS n
 FROM lab LEFT JOIN customer c ON c.c_custkey = machineID GROUP BY ROLLUP (c.c_mktsegment, machineID)""")
def failure_rollup(spark, d):
    from gearwatch.catalog.base import machines

    return r6(report.failure_rollup(asof.with_machines(_labelled(spark, d), machines(spark, d)), "will_fail_in_24h", ["model", "machineID"]))


@query("d12_report_summary", f"""WITH {_LAB} SELECT count(DISTINCT machineID) AS total_machines, count(*) AS total_readings,
 strftime(min(ts), '%Y-%m-%d') || ' to ' || strftime(max(ts), '%Y-%m-%d') AS date_range,
 round(avg(will_fail_in_24h) * 100, 6) AS will_fail_in_24h_pct, round(avg(will_fail_in_48h) * 100, 6) AS will_fail_in_48h_pct,
 round(avg(volt), 6) AS avg_volt, round(avg(rotate), 6) AS avg_rotate FROM lab""")
def report_summary(spark, d):
    return r6(report.report_summary(_labelled(spark, d), SENSORS, ["will_fail_in_24h", "will_fail_in_48h"]))


@query("d14_dataset_card", f"""WITH {TEL} SELECT count(*) AS "rows", CAST(5 AS INT) AS columns, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_reading,
 strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_reading, count(DISTINCT machineID) AS machines FROM tel""")
def dataset_card(spark, d):
    return report.dataset_card(telemetry(spark, d))


@query("d31_daily_trend", f"""WITH {TEL}, m AS (SELECT CAST(max(ts) AS DATE) AS last FROM tel),
 s AS (SELECT CAST(last - CAST(i AS INT) AS DATE) AS day FROM m, range(14) r(i))
 SELECT s.day, round(avg(volt), 6) AS avg_volt, round(avg(rotate), 6) AS avg_rotate FROM s LEFT JOIN tel ON CAST(tel.ts AS DATE) = s.day GROUP BY s.day""")
def daily_trend(spark, d):
    return r6(report.daily_trend(telemetry(spark, d), SENSORS, 14))


@query("d32_fleet_summary", f"""WITH {TEL}, m AS (SELECT max(ts) AS last FROM tel) SELECT count(*) AS records, count(DISTINCT machineID) AS machines,
 strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day, round(avg(y), 6) AS failure_rate,
 round(avg(volt), 6) AS avg_volt, round(avg(rotate), 6) AS avg_rotate,
 count(DISTINCT CASE WHEN ts > last - INTERVAL 24 HOUR THEN machineID END) AS active_machines,
 count(*) FILTER (p >= 0.8) AS critical, count(*) FILTER (p >= 0.6 AND p < 0.8) AS warning, count(*) FILTER (p < 0.6) AS normal FROM tel, m""")
def fleet_summary(spark, d):
    return r6(report.fleet_summary(scored(spark, d), SENSORS, "y", "p"))


@query("d33_h1_top_failing_machines", f"""WITH {_LAB} SELECT machineID AS "machineID", round(avg(will_fail_in_24h), 6) AS rate FROM lab GROUP BY machineID
 ORDER BY avg(will_fail_in_24h) DESC, machineID LIMIT 15""")
def top_failing_machines(spark, d):
    return r6(report.top_machines(_labelled(spark, d), "will_fail_in_24h"))


_E24 = ", ".join(
    f"CAST(EXISTS (SELECT 1 FROM tel f WHERE f.machineID = t.machineID AND f.event_type = '{e}' AND f.ts <= t.ts "
    f"AND f.ts >= t.ts - INTERVAL {h} HOUR) AS INT) AS {e}_last_{h}h" for e in ERRORS for h in S.HORIZONS)
_FLAGS = [f"{e}_last_{h}h" for e in ERRORS for h in S.HORIZONS]


@query("d34_flag_totals", f"WITH {TEL}, f AS (SELECT {_E24} FROM tel t) SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS flag, CAST(sum({c}) AS BIGINT) AS total FROM f" for c in _FLAGS) + ") ORDER BY total DESC, flag LIMIT 5")
def flag_totals(spark, d):
    flagged = asof.add_history(telemetry(spark, d), errors=errors(spark, d), error_types=ERRORS)
    return quality.flag_totals(flagged, _FLAGS)


@query("h5_busiest_machine", """WITH m AS (SELECT user_id FROM events GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 1)
 SELECT event_id, user_id AS "machineID", value AS volt FROM events WHERE user_id = (SELECT user_id FROM m) ORDER BY ts, event_id LIMIT 500""")
def busiest_machine(spark, d):
    return report.busiest_machine(telemetry(spark, d), order=ORDER).select("event_id", "machineID", "volt")


@query("b12_sample_rows")
def sample_rows(spark, d):
    return report.sample_n(telemetry(spark, d), 5000, ["event_id"]).select("event_id", "volt")


@query("a12_export_data", "SELECT event_id, value AS volt FROM events ORDER BY ts, event_id LIMIT 10000")
def export_data(spark, d):
    tel = telemetry(spark, d)
    return report.export_tables(tel, ORDER, report.dataset_card(tel))[1].select("event_id", "volt")


@query("a12_export_summary", f"""WITH {TEL}, c AS (SELECT CAST(count(*) AS VARCHAR) AS "rows", '5' AS columns, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_reading,
 strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_reading, CAST(count(DISTINCT machineID) AS VARCHAR) AS machines FROM tel)
 UNPIVOT c ON "rows", columns, first_reading, last_reading, machines INTO NAME name VALUE value""")
def export_summary(spark, d):
    tel = telemetry(spark, d)
    return report.export_tables(tel, ORDER, report.dataset_card(tel))[0]
