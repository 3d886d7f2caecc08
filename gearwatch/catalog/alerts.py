"""Tier, rule, alert, anomaly and threshold-metric queries on the scored table."""

from __future__ import annotations

from pyspark.sql import functions as F

from gearwatch.catalog.base import COMPS, SENSORS, TEL, maint, query, r6, scored, table, telemetry
from gearwatch.functions import tiers
from gearwatch.operators import alerts, anomaly, asof, curves, report

def _p():
    return F.col("p")


@query("b6_probability_tiers", f"""WITH {TEL} SELECT event_id,
 CASE WHEN p <= 0 THEN NULL WHEN p <= 0.3 THEN 'Low' WHEN p <= 0.7 THEN 'Medium' WHEN p <= 1 THEN 'High' END AS risk_level,
 CASE WHEN p >= 0.8 THEN 'Critical' WHEN p >= 0.6 THEN 'Warning' ELSE 'Normal' END AS api_tier,
 CASE WHEN p > 0.8 THEN 'CRITICAL' WHEN p > 0.6 THEN 'HIGH' ELSE 'MEDIUM' END AS mail_tier,
 CASE WHEN p > 0.7::DOUBLE THEN 'CRITICAL' WHEN p > 0.7::DOUBLE * 0.7::DOUBLE THEN 'WARNING' ELSE 'NORMAL' END AS threshold_tier,
 CASE WHEN p >= 0.5 THEN 'HIGH' WHEN p >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS heat_tier,
 CASE WHEN p >= 0.5 THEN 'Immediate Inspection' WHEN p >= 0.3 THEN 'Schedule Maintenance' ELSE 'Normal Operation' END AS heat_action,
 CASE WHEN p > 0.6::DOUBLE THEN 'Critical' WHEN p > 0.3 THEN 'Warning' ELSE 'Normal' END AS live_tier,
 CASE WHEN p > 0.7 THEN 'High' WHEN p > 0.4 THEN 'Medium' ELSE 'Low' END AS simple_tier FROM tel""")
def probability_tiers(spark, d):
    return scored(spark, d).select(
        "event_id", tiers.risk_level(_p()).alias("risk_level"), tiers.api_tier(_p()).alias("api_tier"),
        tiers.mail_tier(_p()).alias("mail_tier"), tiers.threshold_tier(_p(), F.lit(0.7)).alias("threshold_tier"),
        tiers.heat_tier(_p(), 0.5).alias("heat_tier"), tiers.heat_action(_p(), 0.5).alias("heat_action"),
        tiers.live_tier(_p(), 0.6).alias("live_tier"), tiers.simple_tier(_p()).alias("simple_tier"),
    )


@query("b6g_i31_component_health", f"""WITH {TEL}, l AS (SELECT * FROM tel QUALIFY row_number() OVER (PARTITION BY machineID ORDER BY ts DESC, event_id DESC) = 1),
 h AS (""" + " UNION ALL ".join(f"""SELECT l.machineID, l.p, '{c}' AS component, date_diff('microsecond', m.ts, l.ts) / 86400000000.0 AS days
 FROM l ASOF LEFT JOIN (SELECT machineID, ts FROM tel WHERE event_type = '{c}') m ON l.machineID = m.machineID AND l.ts >= m.ts""" for c in COMPS) + """)
 SELECT machineID AS "machineID", round(p, 6) AS p, component, round(days, 6) AS days_since_maint, CASE WHEN days IS NULL THEN NULL WHEN floor(days) > 80 THEN 'Critical' WHEN floor(days) > 60 THEN 'Warning'
 WHEN floor(days) > 40 THEN 'Check Soon' ELSE 'Good' END AS status FROM h""")
def component_health(spark, d):
    history = asof.add_history(scored(spark, d), maint=maint(spark, d), comps=COMPS)
    return r6(anomaly.component_health(history, COMPS, "p", order=("datetime", "event_id")))


_HEALTH = f"""WITH {TEL}, l AS (SELECT * FROM tel QUALIFY row_number() OVER (PARTITION BY machineID ORDER BY ts DESC, event_id DESC) = 1),
 h AS (""" + " UNION ALL ".join(f"""SELECT l.machineID, '{c}' AS component, date_diff('microsecond', m.ts, l.ts) / 86400000000.0 AS days
 FROM l ASOF JOIN (SELECT machineID, ts FROM tel WHERE event_type = '{c}') m ON l.machineID = m.machineID AND l.ts >= m.ts""" for c in COMPS) + ")"


@query("i31_oldest_components", _HEALTH + """ SELECT machineID AS "machineID", component, round(days, 6) AS days_since_maint FROM h
 ORDER BY days DESC, machineID, component LIMIT 10""")
def oldest_components(spark, d):
    history = asof.add_history(scored(spark, d), maint=maint(spark, d), comps=COMPS)
    health = anomaly.component_health(history, COMPS, "p", order=("datetime", "event_id"))
    return r6(anomaly.oldest_components(health).select("machineID", "component", "days_since_maint"))


@query("b7_d16_rethreshold", f"WITH {TEL} SELECT event_id, CAST(p >= 0.4 AS INT) AS decision FROM tel")
def rethreshold(spark, d):
    return scored(spark, d).select("event_id", tiers.decide(_p(), 0.4).alias("decision"))


@query("b8_present", f"""WITH {TEL} SELECT event_id, round(p, 4) AS p, CASE WHEN p >= 0.5 THEN 'High Risk' ELSE 'Normal' END AS status,
 CASE WHEN p - 0.5 > 0 THEN 'Increases Risk' ELSE 'Decreases Risk' END AS effect FROM tel""")
def present(spark, d):
    return scored(spark, d).select("event_id", F.round(_p(), 4).alias("p"), tiers.status_label(tiers.decide(_p(), 0.5)).alias("status"),
                                   tiers.effect_label(_p() - 0.5).alias("effect"))


RULES = [
    alerts.Rule("High Voltage", "volt > 400", "CRITICAL", "format_string('Voltage at %.2f exceeds 400', volt)"),
    alerts.Rule("Low Rotation", "rotate < 5", "HIGH", "format_string('Rotation at %.1f below minimum (5)', rotate)"),
    alerts.Rule("High Failure Probability", "p > 0.8", "CRITICAL", "'Schedule maintenance immediately.'"),
]


@query("b9_rule_engine", f"""WITH {TEL} SELECT event_id, 'High Voltage' AS rule, 'CRITICAL' AS severity, printf('Voltage at %.2f exceeds 400', volt) AS message FROM tel WHERE volt > 400
 UNION ALL SELECT event_id, 'Low Rotation', 'HIGH', printf('Rotation at %.1f below minimum (5)', rotate) FROM tel WHERE rotate < 5
 UNION ALL SELECT event_id, 'High Failure Probability', 'CRITICAL', 'Schedule maintenance immediately.' FROM tel WHERE p > 0.8""")
def rule_engine(spark, d):
    return alerts.evaluate_rules(scored(spark, d), RULES).select("event_id", "rule", "severity", "message")


@query("b14_image_verdict", """SELECT doc_id, CASE WHEN p >= 0.5 THEN 'Non-Defected' ELSE 'Defected' END AS verdict,
 round(CASE WHEN p >= 0.5 THEN p ELSE 1 - p END, 6) AS confidence FROM (SELECT doc_id, (n_chars % 101) / 100.0 AS p FROM documents)""")
def image_verdict(spark, d):
    df = table(spark, d, "documents").select("doc_id", ((F.col("n_chars") % 101) / 100.0).alias("p"))
    verdict, confidence = tiers.image_verdict(_p())
    return r6(df.select("doc_id", verdict.alias("verdict"), confidence.alias("confidence")))


@query("c12_alert_config", f"""WITH {TEL} SELECT event_id, round((SELECT avg(p) FROM tel), 6) AS threshold,
 CAST(p >= (SELECT avg(p) FROM tel) AS INT) AS failure_prediction FROM tel""")
def alert_config(spark, d):
    df = scored(spark, d)
    config = df.agg(F.avg("p").alias("threshold"))
    return r6(alerts.apply_config(df, config).select("event_id", "threshold", "failure_prediction"))


@query("d15_score_summary", f"WITH {TEL} SELECT count(*) AS n, count(*) FILTER (p >= 0.5) AS high, round(avg(p), 6) AS mean_p, round(max(p), 6) AS max_p FROM tel")
def score_summary(spark, d):
    return r6(alerts.score_summary(scored(spark, d), 0.5))


@query("d16_risk_buckets", f"""WITH {TEL} SELECT count(*) FILTER (p >= 0.5) AS high, count(*) FILTER (p >= 0.3 AND p < 0.5) AS medium,
 count(*) FILTER (p < 0.3) AS low FROM tel""")
def risk_buckets(spark, d):
    return alerts.risk_buckets(scored(spark, d), 0.5)


_ALERTS = f"WITH {TEL}, a AS (SELECT *, CASE WHEN p >= 0.8 THEN 'Critical' WHEN p >= 0.6 THEN 'Warning' ELSE 'Normal' END AS risk_level FROM tel)"


def _alerts(spark, d):
    return scored(spark, d).withColumn("risk_level", tiers.api_tier(_p()))


@query("d17_alert_stats", _ALERTS + """ SELECT count(*) AS total, count(*) FILTER (risk_level = 'Critical') AS critical, count(*) FILTER (risk_level = 'Warning') AS warning,
 count(*) FILTER (risk_level = 'Normal') AS normal, round(count(*) FILTER (risk_level = 'Critical') * 100.0 / count(*), 1) AS critical_pct,
 round(count(*) FILTER (risk_level = 'Warning') * 100.0 / count(*), 1) AS warning_pct, round(count(*) FILTER (risk_level = 'Normal') * 100.0 / count(*), 1) AS normal_pct FROM a""")
def alert_stats(spark, d):
    return alerts.alert_stats(_alerts(spark, d))


@query("d18_top_alert_machines", _ALERTS + """ SELECT machineID AS "machineID", count(*) AS n FROM a WHERE risk_level = 'Critical' GROUP BY 1
 ORDER BY n DESC, 1 LIMIT 3""")
def top_alert_machines(spark, d):
    return alerts.top_alert_machines(_alerts(spark, d).filter("risk_level = 'Critical'"))


@query("d23_live_snapshot", f"""WITH {TEL} SELECT count(*) AS readings, count(*) FILTER (p > 0.6) AS high_risk,
 round(count(*) FILTER (p > 0.6) * 100.0 / count(*), 6) AS high_risk_pct, round((1 - avg(p)) * 100, 6) AS health, count(DISTINCT machineID) AS machines FROM tel""")
def live_snapshot(spark, d):
    return r6(alerts.live_snapshot(scored(spark, d), 0.6))


@query("h2_machines_by_risk", f"""WITH {TEL} SELECT machineID AS "machineID", round(max(p), 6) AS p FROM tel GROUP BY machineID ORDER BY max(p) DESC, 1""")
def machines_by_risk(spark, d):
    df = scored(spark, d).groupBy("machineID").agg(F.max("p").alias("p"))
    return r6(df.orderBy(F.desc("p"), "machineID"))


def _fences(k: float) -> str:
    return "f AS (" + " UNION ALL ".join(
        f"SELECT '{s}' AS sensor, quantile_cont({s}, 0.25) - {k} * (quantile_cont({s}, 0.75) - quantile_cont({s}, 0.25)) AS lo, "
        f"quantile_cont({s}, 0.75) + {k} * (quantile_cont({s}, 0.75) - quantile_cont({s}, 0.25)) AS hi FROM tel" for s in SENSORS) + ")"


_LONG = "u AS (" + " UNION ALL ".join(f"SELECT event_id, machineID, '{s}' AS sensor, {s} AS value FROM tel" for s in SENSORS) + ")"


@query("i27_iqr_outliers", f"""WITH {TEL}, {_fences(0.5)}, {_LONG} SELECT event_id, machineID AS "machineID", u.sensor, value, 'Medium' AS severity
 FROM u JOIN f USING (sensor) WHERE value < lo OR value > hi""")
def iqr_outliers(spark, d):
    return anomaly.iqr_outliers(telemetry(spark, d), SENSORS, ["event_id", "machineID"], k=0.5)


_Z = f"""WITH {TEL}, {_LONG}, s AS (SELECT sensor, avg(value) AS m, stddev_samp(value) AS s FROM u GROUP BY sensor),
 a AS (SELECT u.* FROM u JOIN s USING (sensor) WHERE s.s > 0 AND abs((value - m) / s.s) > """


@query("i28_z_outliers", _Z + "1.5) SELECT event_id, machineID AS \"machineID\", sensor, value, 'High' AS severity FROM a")
def z_outliers(spark, d):
    return anomaly.z_outliers(telemetry(spark, d), SENSORS, ["event_id", "machineID"], 1.5)


@query("d19_anomaly_counts", _Z + "1.5) SELECT sensor, count(*) AS n, count(DISTINCT machineID) AS machines FROM a GROUP BY ROLLUP (sensor)")
def anomaly_counts(spark, d):
    return anomaly.anomaly_counts(anomaly.z_outliers(telemetry(spark, d), SENSORS, ["machineID"], 1.5))


@query("i29_clip_outliers", f"""WITH {TEL}, {_fences(0.25)} SELECT event_id, round(greatest(least(volt, (SELECT hi FROM f WHERE sensor = 'volt')), (SELECT lo FROM f WHERE sensor = 'volt')), 6) AS volt,
 round(greatest(least(rotate, (SELECT hi FROM f WHERE sensor = 'rotate')), (SELECT lo FROM f WHERE sensor = 'rotate')), 6) AS rotate FROM tel""")
def clip_outliers(spark, d):
    return r6(anomaly.clip_outliers(telemetry(spark, d), SENSORS, 0.25).select("event_id", *SENSORS))


_SPLIT = """CASE WHEN ts <= TIMESTAMP '2024-01-20 23:59:59' THEN 'train' WHEN ts <= TIMESTAMP '2024-01-25 23:59:59' THEN 'val' ELSE 'test' END"""


@query("i1_d13_time_split", f"""WITH {TEL} SELECT {_SPLIT} AS split, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, round(avg(y), 6) AS rate,
 strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_reading, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_reading FROM tel GROUP BY 1""")
def time_split(spark, d):
    from gearwatch.plans.training import time_split as split

    return r6(report.split_stats(split(scored(spark, d), "2024-01-20 23:59:59", "2024-01-25 23:59:59"), "y"))


_CURVE = f"""WITH {TEL}, g AS (SELECT p AS t, sum(y) AS pos, count(*) - sum(y) AS neg FROM tel GROUP BY p),
 c AS (SELECT *, sum(pos) OVER (ORDER BY t DESC) AS tp, sum(neg) OVER (ORDER BY t DESC) AS fp, sum(pos) OVER () AS pa, sum(neg) OVER () AS na FROM g)"""


@query("i16_confusion_metrics", f"""WITH {TEL}, c AS (SELECT count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp,
 count(*) FILTER (p < 0.5 AND y = 0) AS tn, count(*) FILTER (p < 0.5 AND y = 1) AS fn FROM tel)
 SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
 round(tn / (tn + fp + 1e-12), 6) AS specificity, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(5 * tp / (5 * tp + fp + 4 * fn), 6) AS f2 FROM c""")
def confusion_metrics(spark, d):
    return r6(curves.confusion_metrics(scored(spark, d), 0.5))


@query("i17_roc_points", _CURVE + " SELECT round(t, 6) AS t, round(fp / na, 6) AS fpr, round(tp / pa, 6) AS tpr FROM c")
def roc_points(spark, d):
    return r6(curves.roc_points(scored(spark, d)))


@query("i17_i18_auc_and_ap", _CURVE + """ SELECT round((SELECT sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) / count(*)
 FROM tel a, tel b WHERE a.y = 1 AND b.y = 0), 6) AS roc_auc, round(sum(pos / pa * (tp / (tp + fp))), 6) AS pr_auc FROM c""")
def auc_and_ap(spark, d):
    return r6(curves.auc_and_ap(scored(spark, d)))


@query("i19_best_threshold", _CURVE + """, f AS (SELECT t, 5 * (tp / (tp + fp)) * (tp / pa) / (4 * (tp / (tp + fp)) + tp / pa + 1e-12) AS fb FROM c)
 SELECT round(t, 6) AS threshold, round(fb, 6) AS fbeta FROM f ORDER BY fb DESC, t LIMIT 1""")
def best_threshold(spark, d):
    return r6(curves.best_threshold(scored(spark, d)))


@query("e12_precision_recall", _CURVE + " SELECT round(t, 6) AS t, round(tp / (tp + fp), 6) AS precision, round(tp / pa, 6) AS recall FROM c")
def precision_recall(spark, d):
    return r6(curves.precision_recall_points(scored(spark, d)))


@query("i20_classification_report", f"""WITH {TEL}, q AS (SELECT y, CAST(p >= 0.5 AS INT) AS yh FROM tel), k AS (SELECT unnest([0, 1]) AS class)
 SELECT CAST(class AS INT) AS class, round(count(*) FILTER (y = class AND yh = class) / count(*) FILTER (yh = class), 6) AS precision,
 round(count(*) FILTER (y = class AND yh = class) / count(*) FILTER (y = class), 6) AS recall,
 round(2 * count(*) FILTER (y = class AND yh = class) / (count(*) FILTER (yh = class) + count(*) FILTER (y = class)), 6) AS f1,
 count(*) FILTER (y = class) AS support FROM q, k GROUP BY class""")
def classification_report(spark, d):
    df = scored(spark, d).withColumn("yhat", tiers.decide(_p(), 0.5))
    return r6(curves.classification_report(df, "y", "yhat"))
