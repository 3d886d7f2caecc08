"""Query registration and the mapping from the given tables to the domain tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gearwatch.schemas import normalise

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SENSORS = ["volt", "rotate"]
ERRORS = ["error", "view"]
COMPS = ["purchase", "click"]
TIE = ["event_id"]


def query(name: str, sql: str | None = None):
    """Register a query and, when plain SQL can state it, its oracle."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(df: DataFrame, *keep: str) -> DataFrame:
    """Round every double column to six places (keeping ``keep`` as they are) so results can be hashed."""
    return df.select(*[
        F.round(F.col(c), 6).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes
    ])


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a reading of machine ``user_id`` with sensors volt (value) and rotate (props.k)."""
    events = normalise(table(spark, sf_dir, "events"))
    return events.select(
        "event_id",
        F.col("user_id").alias("machineID"),
        F.col("ts").alias("datetime"),
        F.col("value").alias("volt"),
        F.get_json_object("props", "$.k").cast("double").alias("rotate"),
    )


def log(spark: SparkSession, sf_dir: str, kinds: list[str], name: str) -> DataFrame:
    events = table(spark, sf_dir, "events").filter(F.col("event_type").isin(kinds))
    return events.select(F.col("ts").cast("timestamp").alias("datetime"), F.col("user_id").alias("machineID"),
                         F.col("event_type").alias(name))


def errors(spark, sf_dir):
    return log(spark, sf_dir, ERRORS, "errorID")


def maint(spark, sf_dir):
    return log(spark, sf_dir, COMPS, "comp")


def failures(spark, sf_dir):
    return log(spark, sf_dir, ["signup"], "failure")


def machines(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("machineID"), F.col("c_mktsegment").alias("model"), F.col("c_nationkey").alias("age")
    )


def scored(spark, sf_dir):
    """A scored table on every event: label y (sign-up) and probability p, which has many ties."""
    return normalise(table(spark, sf_dir, "events")).select(
        "event_id",
        F.col("user_id").alias("machineID"),
        F.col("ts").alias("datetime"),
        F.col("value").alias("volt"),
        F.get_json_object("props", "$.k").cast("double").alias("rotate"),
        F.least(F.col("value") / 500, F.lit(1.0)).alias("p"),
        (F.col("event_type") == "signup").cast("int").alias("y"),
        "event_type",
    )


# SQL building blocks of the oracles.
TEL = """tel AS (SELECT event_id, user_id AS machineID, ts, value AS volt,
  CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) AS rotate, event_type,
  least(value / 500, 1.0) AS p, CAST(event_type = 'signup' AS INT) AS y FROM events)"""
