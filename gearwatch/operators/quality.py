"""Data quality and exploratory statistics: validation, balance, overview, summaries, correlations, frequencies."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from gearwatch.operators.prefix import quantiles


def require_columns(df: DataFrame, required: Sequence[str], rows: bool = False) -> DataFrame:
    """A3: fail when a required column is missing (schema only, no job), or with ``rows`` when there is no row."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if rows and df.isEmpty():
        raise ValueError("the table has no rows")
    return df


def null_profile(df: DataFrame) -> DataFrame:
    """Rows, null count and null % per column from one pass."""
    nulls = [F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns]
    one = df.agg(F.count("*").alias("_rows"), *nulls)
    return (
        one.unpivot("_rows", df.columns, "column_name", "nulls")
        .select(
            "column_name",
            F.col("_rows").alias("rows"),
            "nulls",
            F.coalesce(F.try_divide(F.col("nulls") * 100.0, F.col("_rows")), F.lit(0.0)).alias("null_pct"),
        )
    )


def columns_with_nulls(df: DataFrame, top: int = 5) -> DataFrame:
    """The columns with most nulls."""
    return null_profile(df).filter("nulls > 0").orderBy(F.desc("nulls"), "column_name").limit(top)


def null_and_duplicate_totals(df: DataFrame) -> DataFrame:
    """Total null cells and repeated rows (the first copy is not a repeat)."""
    nulls = reduce(lambda a, b: a + b, [F.col(f"`{c}`").isNull().cast("long") for c in df.columns])
    copies = (
        df.withColumn("_nulls", nulls)
        .groupBy(*df.columns)
        .agg(F.count("*").alias("_n"), F.sum("_nulls").alias("_nulls"))
    )
    return copies.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("_nulls"), F.lit(0)).alias("null_cells"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def sort_and_clean(df: DataFrame) -> DataFrame:
    """Drop exact copies. Order is a property of the sink (``sort_within_files``), not of a DataFrame."""
    return df.dropDuplicates()


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Count and share per label value, and how many majority rows stand for each row of the class."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    whole = W.partitionBy()
    return counts.select(
        "label",
        "n",
        (F.col("n") * 100.0 / F.sum("n").over(whole)).alias("pct"),
        (F.max("n").over(whole) / F.col("n")).alias("imbalance"),
    )


def overview(df: DataFrame, key: str = "machineID", ts: str = "datetime", exact: bool = True) -> DataFrame:
    """Rows, distinct machines, span in whole days, missing % over all cells."""
    cells = reduce(lambda a, b: a + b, [F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns])
    distinct = F.count_distinct(key) if exact else F.approx_count_distinct(key)
    one = df.agg(
        F.count("*").alias("rows"),
        distinct.alias("machines"),
        F.floor((F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 86_400_000_000).alias("span_days"),
        cells.alias("_nulls"),
    )
    share = F.try_divide(F.col("_nulls") * 100.0, F.col("rows") * len(df.columns))
    return one.select("rows", "machines", "span_days", F.coalesce(share, F.lit(0.0)).alias("missing_pct"))


def _long(df: DataFrame, sensors: Sequence[str]) -> DataFrame:
    wide = df.select(*[F.col(s).cast("double").alias(s) for s in sensors])
    return wide.unpivot([], list(sensors), "sensor", "value")


def sensor_quality(df: DataFrame, sensors: Sequence[str]) -> DataFrame:
    """D3: missing %, mean, sample std, min and max per sensor."""
    return _long(df, sensors).groupBy("sensor").agg(
        (F.count_if(F.col("value").isNull()) * 100.0 / F.count("*")).alias("missing_pct"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )


def eight_numbers(df: DataFrame, sensors: Sequence[str], exact: bool = True) -> DataFrame:
    """Row count (nulls included), mean, sample std, min, quartiles and max per sensor."""
    long = _long(df, sensors)
    moments = long.groupBy("sensor").agg(
        F.count("*").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    quarts = quantiles(long, "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, ["sensor"], exact)
    return moments.join(quarts, "sensor", "left")


def correlations(df: DataFrame, sensors: Sequence[str]) -> DataFrame:
    """Correlation matrix in long form, all pairs in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(sensors) for b in sensors[i:]]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        for x, y in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"_{i}").alias("corr")))
    return one.select(F.inline(F.array(*cells)))


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """Count per value of a categorical column."""
    return df.groupBy(column).agg(F.count("*").alias("n"))


def cross_counts(df: DataFrame, index: str, category: str, values: Sequence[str]) -> DataFrame:
    """Counts of declared category values per index value, as conditional sums in one aggregate."""
    return df.groupBy(index).agg(*[F.count_if(F.col(category) == v).alias(v) for v in values])


def events_per_day(df: DataFrame, ts: str) -> DataFrame:
    """Events per calendar day."""
    return df.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))


def flag_totals(df: DataFrame, flags: Sequence[str], top: int = 5) -> DataFrame:
    """Total of each flag column, largest first."""
    one = df.agg(*[F.sum(c).alias(c) for c in flags])
    return one.unpivot([], list(flags), "flag", "total").orderBy(F.desc("total"), "flag").limit(top)
