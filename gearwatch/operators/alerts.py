"""Rules, alert configuration and alert statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Rule:
    """An alert rule: a SQL predicate, its severity, and a SQL expression for the message."""

    name: str
    predicate: str
    severity: str
    message: str


# The default rules.
DEFAULT_RULES = [
    Rule("High Vibration", "vibration > 60", "CRITICAL",
         "format_string('Vibration at %.1f Hz exceeds threshold (60 Hz)', vibration)"),
    Rule("Low Pressure", "pressure < 80", "HIGH",
         "format_string('Pressure at %.1f PSI below minimum (80 PSI)', pressure)"),
    Rule("High Failure Probability", "failure_prob > 0.8", "CRITICAL",
         "format_string('Failure probability at %.1f%%. Schedule maintenance immediately.', failure_prob * 100)"),
]


def evaluate_rules(df: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """One row per fired rule; rows that fire nothing disappear."""
    fired = [
        F.when(F.expr(r.predicate), F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"),
                                             F.expr(r.message).alias("message")))
        for r in rules
    ]
    return df.withColumn("_a", F.explode(F.array_compact(F.array(*fired)))).select(*df.columns, "_a.*")


def apply_config(scored: DataFrame, config: DataFrame, prob: str = "p") -> DataFrame:
    """Attach the one-row alert configuration (``threshold``) and the resulting decision to every row."""
    threshold = config.select("threshold").scalar()
    return scored.withColumn("threshold", threshold).withColumn(
        "failure_prediction", (F.col(prob) >= F.col("threshold")).cast("int"))


def alert_stats(alerts: DataFrame, level: str = "risk_level") -> DataFrame:
    """Total alerts, count and % (one decimal) per level; zero when there are none."""
    names = ["Critical", "Warning", "Normal"]
    one = alerts.agg(F.count("*").alias("total"), *[F.count_if(F.col(level) == n).alias(n.lower()) for n in names])
    pct = [F.round(F.coalesce(F.try_divide(F.col(n.lower()) * 100.0, F.col("total")), F.lit(0.0)), 1).alias(f"{n.lower()}_pct")
           for n in names]
    return one.select("*", *pct)


def top_alert_machines(alerts: DataFrame, n: int = 3, key: str = "machineID") -> DataFrame:
    """Machines with most alerts."""
    return alerts.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)


def score_summary(scored: DataFrame, threshold: float, prob: str = "p") -> DataFrame:
    """Rows, rows at or above the threshold, mean and max score."""
    return scored.agg(F.count("*").alias("n"), F.count_if(F.col(prob) >= threshold).alias("high"),
                      F.avg(prob).alias("mean_p"), F.max(prob).alias("max_p"))


def risk_buckets(scored: DataFrame, threshold: float, prob: str = "p") -> DataFrame:
    """Rows per heat tier at the threshold."""
    p = F.col(prob)
    return scored.agg(F.count_if(p >= threshold).alias("high"),
                      F.count_if((p >= threshold * 0.6) & (p < threshold)).alias("medium"),
                      F.count_if(p < threshold * 0.6).alias("low"))


def live_snapshot(scored: DataFrame, threshold: float, prob: str = "p", key: str = "machineID") -> DataFrame:
    """Readings, readings above the threshold and their %, fleet health, machines."""
    over = F.count_if(F.col(prob) > threshold)
    return scored.agg(
        F.count("*").alias("readings"), over.alias("high_risk"),
        (over * 100.0 / F.greatest(F.count("*"), F.lit(1))).alias("high_risk_pct"),
        ((1 - F.avg(prob)) * 100).alias("health"), F.count_distinct(key).alias("machines"),
    )
