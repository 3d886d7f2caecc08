"""Feature impacts of scored rows: linear and tree explanations, rankings, drivers, importances."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


def _long(df: DataFrame, key: str, pairs: dict[str, Column], extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per feature from a fixed feature list, made inside the projection (no join, no shuffle)."""
    cells = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"), impact.alias("impact"))
             for f, impact in pairs.items()]
    return df.select(key, *extra, F.inline(F.array(*cells)))


def linear_impacts(df: DataFrame, key: str, coefficients: dict[str, float], intercept: float,
                   means: dict[str, float] | None = None) -> DataFrame:
    """impact = coefficient x value, or x (value - mean) against a background; base = sigmoid(intercept)."""
    def impact(f: str) -> Column:
        x = F.col(f).cast("double")
        return F.lit(coefficients[f]) * (x - F.lit(means[f]) if means else x)

    out = _long(df, key, {f: impact(f) for f in coefficients})
    return out.withColumn("base_value", F.lit(1 / (1 + math.exp(-intercept))))


def tree_impacts(df: DataFrame, key: str, importances: dict[str, float], prob: str) -> DataFrame:
    """Importance x value / largest |value| of the row x (p - 0.5) x 2; all-zero importances count as ones."""
    if not any(importances.values()):
        importances = dict.fromkeys(importances, 1.0)
    widest = F.greatest(*[F.abs(F.col(f).cast("double")) for f in importances]) if len(importances) > 1 else F.abs(F.col(next(iter(importances))))
    sure = (F.col(prob) - 0.5) * 2
    return _long(df, key, {f: F.lit(w) * (F.col(f).cast("double") / (widest + 1e-10)) * sure for f, w in importances.items()})


def ranked(impacts: DataFrame, key: str) -> DataFrame:
    """Rank by |impact| per row, running share in %, and how many features to show (within 90 %, 5 to 20)."""
    size = F.abs("impact")
    order = W.partitionBy(key).orderBy(F.desc("abs_impact"), "feature")
    whole = W.partitionBy(key)
    out = impacts.withColumn("abs_impact", size).withColumns({
        "rank": F.row_number().over(order),
        "cumulative_impact": F.sum("abs_impact").over(order.rowsBetween(W.unboundedPreceding, 0)),
        "_total": F.sum("abs_impact").over(whole),
    }).withColumn("cumulative_pct", F.try_divide("cumulative_impact", "_total") * 100)
    shown = F.when(F.col("_total") > 0, F.greatest(F.lit(5), F.least(
        F.count_if(F.col("cumulative_pct") <= 90).over(whole).cast("int"), F.lit(20)))).otherwise(
        F.least(F.lit(10), F.count("*").over(whole).cast("int")))
    return out.withColumn("features_shown", shown).drop("_total")


def top_impacts(impacts: DataFrame, key: str, n: int = 10) -> DataFrame:
    """H6: the n features with the largest |impact| of every row."""
    return ranked(impacts, key).filter(F.col("rank") <= n)


def driver_summary(impacts: DataFrame, key: str, decisions: DataFrame) -> DataFrame:
    """Main driver of every row with the recommendation for its decision (``failure_prediction``)."""
    best = F.max_by(F.struct("feature", "impact", "value"), F.abs("impact")).alias("t")
    top = impacts.groupBy(key).agg(best).select(key, "t.*").join(decisions, key)
    text = F.when(
        F.col("failure_prediction") == 1,
        F.concat(F.lit("Main driver: "), F.col("feature"), F.format_string(" (impact: %.3f). Schedule immediate inspection", "impact")),
    ).otherwise(F.concat(F.lit("Continue monitoring: "), F.col("feature"), F.format_string(" (value: %.2f)", "value")))
    return top.select(key, "feature", "impact", "value", text.alias("recommendation"))


def feature_names(fitted: DataFrame, vector: str) -> list[str]:
    """Names of the slots of an assembled vector, from its column metadata."""
    meta = fitted.schema[vector].metadata["ml_attr"]
    slots = [a for group in meta["attrs"].values() for a in group]
    return [a.get("name", str(a["idx"])) for a in sorted(slots, key=lambda a: a["idx"])]


def importance_table(spark: SparkSession, names: list[str], model, top: int = 20) -> DataFrame:
    """Importances of a tree model or |coefficients| of a linear one, largest first."""
    weights = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
    rows = [(n, float(w), abs(float(w))) for n, w in zip(names, weights.toArray())]
    df = spark.createDataFrame(rows, "feature string, weight double, importance double")
    return df.orderBy(F.desc("importance"), "feature").limit(top)
