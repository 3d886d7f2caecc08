"""Fleet and report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def rate_by(df: DataFrame, group, label: str, name: str = "rate") -> DataFrame:
    """Mean of a 0/1 label per group (a timestamp, a day, a machine)."""
    return df.groupBy(group).agg(F.avg(label).alias(name), F.count("*").alias("n"))


def failure_rollup(df: DataFrame, label: str, keys: Sequence[str]) -> DataFrame:
    """D11 over grouping levels, from the grand total down to all keys."""
    return df.rollup(*keys).agg(F.avg(label).alias("rate"), F.count("*").alias("n"))


def top_machines(df: DataFrame, label: str, n: int = 15, key: str = "machineID") -> DataFrame:
    """Machines with the highest failure rate; equal rates go by machine."""
    return df.groupBy(key).agg(F.avg(label).alias("rate")).orderBy(F.desc("rate"), key).limit(n)


def report_summary(df: DataFrame, sensors: Sequence[str], labels: Sequence[str], key="machineID", ts="datetime") -> DataFrame:
    """Machines, readings, date range text, failure % per horizon, sensor means."""
    day = "yyyy-MM-dd"
    return df.agg(
        F.count_distinct(key).alias("total_machines"),
        F.count("*").alias("total_readings"),
        F.concat(F.date_format(F.min(ts), day), F.lit(" to "), F.date_format(F.max(ts), day)).alias("date_range"),
        *[(F.avg(c) * 100).alias(f"{c}_pct") for c in labels],
        *[F.avg(s).alias(f"avg_{s}") for s in sensors],
    )


def dataset_card(df: DataFrame, key="machineID", ts="datetime") -> DataFrame:
    """Rows, columns, date range and distinct machines."""
    return df.agg(
        F.count("*").alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.date_format(F.min(ts), "yyyy-MM-dd HH:mm:ss").alias("first_reading"),
        F.date_format(F.max(ts), "yyyy-MM-dd HH:mm:ss").alias("last_reading"),
        F.count_distinct(key).alias("machines"),
    )


def split_stats(df: DataFrame, label: str, ts="datetime") -> DataFrame:
    """Size, positives, rate and time range per split."""
    return df.groupBy("split").agg(
        F.count("*").alias("n"),
        F.sum(label).alias("positives"),
        F.avg(label).alias("rate"),
        F.date_format(F.min(ts), "yyyy-MM-dd HH:mm:ss").alias("first_reading"),
        F.date_format(F.max(ts), "yyyy-MM-dd HH:mm:ss").alias("last_reading"),
    )


def daily_trend(df: DataFrame, sensors: Sequence[str], days: int, ts="datetime") -> DataFrame:
    """Daily sensor means for the last ``days`` days of the data, with empty days kept as nulls."""
    newest = df.agg(F.to_date(F.max(ts)).alias("d")).scalar()
    spine = df.sparkSession.range(days).select(F.date_sub(newest, F.col("id").cast("int")).alias("day"))
    means = (
        df.filter(F.to_date(ts) > F.date_sub(newest, days))
        .groupBy(F.to_date(ts).alias("day"))
        .agg(*[F.avg(s).alias(f"avg_{s}") for s in sensors])
    )
    return spine.join(means, "day", "left")


def fleet_summary(df: DataFrame, sensors, label: str, prob: str, ts="datetime", key="machineID", active_hours=24) -> DataFrame:
    """Overview of a scored table: volume, range, failure rate, means, active machines, alert levels."""
    newest = df.agg(F.max(ts).alias("t")).scalar()
    recent = F.col(ts) > newest - F.expr(f"INTERVAL {active_hours} HOURS")
    day = "yyyy-MM-dd"
    return df.agg(
        F.count("*").alias("records"),
        F.count_distinct(key).alias("machines"),
        F.date_format(F.min(ts), day).alias("first_day"),
        F.date_format(F.max(ts), day).alias("last_day"),
        F.avg(label).alias("failure_rate"),
        *[F.avg(s).alias(f"avg_{s}") for s in sensors],
        F.count_distinct(F.when(recent, F.col(key))).alias("active_machines"),
        F.count_if(F.col(prob) >= 0.8).alias("critical"),
        F.count_if((F.col(prob) >= 0.6) & (F.col(prob) < 0.8)).alias("warning"),
        F.count_if(F.col(prob) < 0.6).alias("normal"),
    )


def between_dates(df: DataFrame, first: str, last: str, ts="datetime") -> DataFrame:
    """Rows from the first to the last day, both included, as a half-open range that reaches the scan."""
    end = F.to_timestamp(F.date_add(F.lit(last).cast("date"), 1))
    return df.filter((F.col(ts) >= F.lit(first).cast("timestamp")) & (F.col(ts) < end))


def busiest_machine(df: DataFrame, rows: int = 500, key="machineID", order: Sequence[str] = ("datetime",)) -> DataFrame:
    """H5: the machine with most readings (smallest id on ties) and its first ``rows`` readings by time."""
    mode = df.groupBy(key).count().orderBy(F.desc("count"), key).limit(1).select(key).scalar()
    return df.filter(F.col(key) == mode).orderBy(*order).limit(rows)


def sample_n(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Reproducible sample of n rows, independent of partitioning."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)


def export_tables(df: DataFrame, order: Sequence[str], summary: DataFrame, rows: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """The transposed summary (name, value) and the first ``rows`` rows of the data in key order."""
    text = summary.select(*[F.col(c).cast("string").alias(c) for c in summary.columns])
    return text.unpivot([], summary.columns, "name", "value"), df.orderBy(*order).limit(rows)
