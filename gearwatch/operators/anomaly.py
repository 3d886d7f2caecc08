"""Outlier flags, clipping and component health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gearwatch.functions.tiers import component_tier
from gearwatch.operators.prefix import quantiles
from gearwatch.operators.series import latest


def _long(df: DataFrame, sensors: Sequence[str], ids: Sequence[str]) -> DataFrame:
    wide = df.select(*ids, *[F.col(s).cast("double").alias(s) for s in sensors])
    return wide.unpivot(list(ids), list(sensors), "sensor", "value").filter(F.col("value").isNotNull())


def fences(df: DataFrame, sensors: Sequence[str], k: float, exact: bool = True) -> DataFrame:
    """Lower and upper fence per sensor: quartiles minus / plus k interquartile ranges."""
    q = quantiles(_long(df, sensors, []), "value", {"q1": 0.25, "q3": 0.75}, ["sensor"], exact)
    iqr = F.col("q3") - F.col("q1")
    return q.select("sensor", (F.col("q1") - k * iqr).alias("lower"), (F.col("q3") + k * iqr).alias("upper"))


def iqr_outliers(df: DataFrame, sensors, ids=("machineID",), k: float = 1.5, exact: bool = True) -> DataFrame:
    """Readings strictly outside the fences, severity Medium."""
    out = _long(df, sensors, ids).join(fences(df, sensors, k, exact), "sensor")
    return out.filter((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))).select(
        *ids, "sensor", "value", F.lit("Medium").alias("severity")
    )


def z_outliers(df: DataFrame, sensors, ids=("machineID",), limit: float = 3.0) -> DataFrame:
    """Readings more than ``limit`` sample deviations from the mean, severity High; flat sensors are skipped."""
    long = _long(df, sensors, ids)
    stats = long.groupBy("sensor").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s")).filter("s > 0")
    out = long.join(stats, "sensor").filter(F.abs((F.col("value") - F.col("m")) / F.col("s")) > limit)
    return out.select(*ids, "sensor", "value", F.lit("High").alias("severity"))


def anomaly_counts(anomalies: DataFrame, key: str = "machineID") -> DataFrame:
    """Anomalies and distinct machines per sensor, with the grand total as the null sensor."""
    return anomalies.rollup("sensor").agg(F.count("*").alias("n"), F.count_distinct(key).alias("machines"))


def clip_outliers(df: DataFrame, sensors: Sequence[str], k: float = 3.0, exact: bool = True) -> DataFrame:
    """Clip every sensor to its fences."""
    limits = fences(df, sensors, k, exact)
    one = limits.agg(*[
        F.struct(*[F.max(F.when(F.col("sensor") == s, F.col(c))).alias(c) for c in ("lower", "upper")]).alias(s)
        for s in sensors
    ])
    box = one.select(F.struct(*sensors).alias("b")).scalar()
    clipped = {
        s: F.when(F.col(s).isNotNull(), F.greatest(F.least(F.col(s), F.col("_b")[s]["upper"]), F.col("_b")[s]["lower"]))
        for s in sensors
    }
    return df.withColumn("_b", box).withColumns(clipped).drop("_b")


def component_health(history: DataFrame, comps: Sequence[str], prob: str, key="machineID", order=("datetime",)) -> DataFrame:
    """Days since maintenance of each component at the latest reading of each machine, with its tier."""
    now = latest(history, [key], list(order))
    ages = {c: f"time_since_maint_{c}_d" for c in comps}
    long = now.select(key, prob, *[F.col(a).alias(c) for c, a in ages.items()]).unpivot(
        [key, prob], list(comps), "component", "days_since_maint"
    )
    return long.withColumn("status", component_tier(F.floor("days_since_maint")))


def oldest_components(health: DataFrame, n: int = 10, key: str = "machineID") -> DataFrame:
    """The n component ages that are longest overdue."""
    return health.filter(F.col("days_since_maint").isNotNull()).orderBy(
        F.desc("days_since_maint"), key, "component").limit(n)


def health_lists(health: DataFrame) -> DataFrame:
    """Components per status."""
    return health.groupBy("component", "status").agg(F.count("*").alias("n"))
