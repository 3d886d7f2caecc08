"""Exact threshold curves of a binary score: confusion metrics, ROC-AUC, average precision, best F-beta."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gearwatch.operators.prefix import prefix_sums


def threshold_curve(df: DataFrame, label: str = "y", score: str = "p") -> DataFrame:
    """One row per distinct score t: positives / negatives at t, and counts with score >= t (tp, fp).

    Rows are combined by score first, so ties share one point; totals P and N ride along as ``pos_all, neg_all``.
    """
    points = (
        df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(score).alias("t"))
        .agg(F.sum(label).cast("long").alias("pos"), F.sum(1 - F.col(label)).cast("long").alias("neg"))
    )
    ranked = prefix_sums(points.withColumn("_desc", -F.col("t")), "_desc", ["pos", "neg"])
    return ranked.select("t", "pos", "neg", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
                         F.col("all_pos").alias("pos_all"), F.col("all_neg").alias("neg_all"))


def roc_points(df: DataFrame, label: str = "y", score: str = "p") -> DataFrame:
    """ROC curve points (threshold, fpr, tpr)."""
    c = threshold_curve(df, label, score)
    return c.select("t", F.try_divide("fp", "neg_all").alias("fpr"), F.try_divide("tp", "pos_all").alias("tpr"))


def precision_recall_points(df: DataFrame, label: str = "y", score: str = "p") -> DataFrame:
    """Precision and recall at every distinct threshold."""
    c = threshold_curve(df, label, score)
    return c.select("t", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                    F.try_divide("tp", "pos_all").alias("recall"))


def auc_and_ap(df: DataFrame, label: str = "y", score: str = "p") -> DataFrame:
    """I17 + I18: rank AUC with half credit for ties, and average precision, in one row."""
    c = threshold_curve(df, label, score)
    ahead = F.col("tp") - F.col("pos") + F.col("pos") / 2
    return c.agg(
        F.try_divide(F.sum(F.col("neg") * ahead), F.max(F.col("pos_all").cast("double") * F.col("neg_all"))).alias("roc_auc"),
        F.try_divide(
            F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))), F.max(F.col("pos_all").cast("double"))
        ).alias("pr_auc"),
    )


def best_threshold(df: DataFrame, label: str = "y", score: str = "p", beta: float = 2.0) -> DataFrame:
    """Threshold with the highest F-beta, the lowest one on ties."""
    b = beta * beta
    pr = precision_recall_points(df, label, score)
    f = (1 + b) * F.col("precision") * F.col("recall") / (b * F.col("precision") + F.col("recall") + 1e-12)
    return pr.select(F.col("t").alias("threshold"), f.alias("fbeta")).orderBy(F.desc("fbeta"), "threshold").limit(1)


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion_metrics(df: DataFrame, threshold, label: str = "y", score: str = "p", by: tuple[str, ...] = ()) -> DataFrame:
    """I16: confusion counts and the metrics derived from them at a threshold, one pass."""
    hit, y = F.col(score) >= threshold, F.col(label) == 1
    counts = df.groupBy(*by).agg(
        F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"),
        F.count_if(~hit & ~y).alias("tn"), F.count_if(~hit & y).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    return counts.select(
        *by, "tp", "fp", "tn", "fn",
        _ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        (tn / (tn + fp + 1e-12)).alias("specificity"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _ratio(5 * tp, 5 * tp + fp + 4 * fn).alias("f2"),
    )


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class."""
    pairs = df.groupBy(F.col(label).alias("y"), F.col(prediction).alias("yhat")).agg(F.count("*").alias("n"))
    sides = pairs.select(
        F.inline(F.array(
            F.struct(F.col("y").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                     F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0).alias("tp")),
            F.struct(F.col("yhat").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                     F.lit(0).cast("long").alias("tp")),
        ))
    )
    per = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    tp = F.col("tp").cast("double")
    return per.select(
        "class",
        _ratio(tp, F.col("predicted")).alias("precision"),
        _ratio(tp, F.col("support")).alias("recall"),
        _ratio(2 * tp, F.col("predicted") + F.col("support")).alias("f1"),
        "support",
    )
