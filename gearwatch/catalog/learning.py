"""Preparation, training, scoring and explanation queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from gearwatch import schemas as S
from gearwatch.catalog.base import COMPS, ERRORS, SENSORS, TEL, TIE, failures, machines, maint, errors, query, r6, scored, telemetry
from gearwatch.catalog.quality import gappy
from gearwatch.functions import tiers
from gearwatch.operators import explain, prepare, series
from gearwatch.plans import training
from gearwatch.plans.features import feature_columns, feature_table
from gearwatch.session import materialise

CUTS = ("2024-01-20 23:59:59", "2024-01-25 23:59:59")
_GAPPY = "g AS (SELECT event_id, machineID, ts, volt, nullif(rotate, 0) AS rotate FROM tel)"
_HOLES = "g AS (SELECT event_id, volt, CASE WHEN rotate >= 60 THEN rotate END AS rotate, CASE WHEN rotate >= 60 THEN event_type END AS kind FROM tel)"


def holes(spark, d):
    df = scored(spark, d)
    seen = F.col("rotate") >= 60
    return df.select("event_id", "volt", F.when(seen, F.col("rotate")).alias("rotate"), F.when(seen, F.col("event_type")).alias("kind"))


@query("i2_fill_mean", f"WITH {TEL}, {_HOLES} SELECT event_id, round(coalesce(rotate, (SELECT avg(rotate) FROM g)), 6) AS rotate FROM g")
def fill_mean(spark, d):
    return r6(prepare.fill_mean(holes(spark, d), ["rotate"]).select("event_id", "rotate"))


@query("i3_fill_median", f"WITH {TEL}, {_HOLES} SELECT event_id, coalesce(rotate, (SELECT quantile_cont(rotate, 0.5) FROM g)) AS rotate FROM g")
def fill_median(spark, d):
    return prepare.fill_median(holes(spark, d), ["rotate"]).select("event_id", "rotate")


@query("i4_fill_mode", f"""WITH {TEL}, {_HOLES} SELECT event_id, coalesce(kind, (SELECT kind FROM g WHERE kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1)) AS kind FROM g""")
def fill_mode(spark, d):
    return prepare.fill_mode(holes(spark, d), ["kind"]).select("event_id", "kind")


def _scale_sql(centre: str, spread: str) -> str:
    return f"WITH {TEL}, s AS (SELECT " + ", ".join(f"{centre.format(c=c)} AS c_{c}, {spread.format(c=c)} AS d_{c}" for c in SENSORS) + \
        " FROM tel) SELECT event_id, " + ", ".join(f"round(({c} - c_{c}) / d_{c}, 6) AS {c}" for c in SENSORS) + " FROM tel, s"


@query("i5_scale_standard", _scale_sql("avg({c})", "stddev_pop({c})"))
def scale_standard(spark, d):
    return r6(prepare.scale(telemetry(spark, d), SENSORS).select("event_id", *SENSORS))


@query("i5_scale_robust", _scale_sql("quantile_cont({c}, 0.5)", "(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"))
def scale_robust(spark, d):
    return r6(prepare.scale(telemetry(spark, d), SENSORS, "robust").select("event_id", *SENSORS))


@query("i5_scale_minmax", _scale_sql("min({c})", "(max({c}) - min({c}))"))
def scale_minmax(spark, d):
    return r6(prepare.scale(telemetry(spark, d), SENSORS, "minmax").select("event_id", *SENSORS))


@query("i6_one_hot", "SELECT event_id, " + ", ".join(f"CAST(event_type = '{v}' AS INT) AS kind_{v}" for v in ("click", "error", "view")) + " FROM events")
def one_hot(spark, d):
    df = scored(spark, d).select("event_id", F.col("event_type").alias("kind"))
    return prepare.one_hot(df, "kind", ["click", "error", "view"]).drop("kind")


@query("i7_label_codes", f"WITH {TEL}, {_HOLES} SELECT event_id, CAST(dense_rank() OVER (ORDER BY coalesce(kind, 'nan')) - 1 AS INT) AS kind_code FROM g")
def label_codes(spark, d):
    return prepare.label_codes(holes(spark, d).select("event_id", "kind"), "kind").select("event_id", "kind_code")


@query("i8_class_weight", f"WITH {TEL} SELECT event_id, round(CASE WHEN y = 1 THEN count(*) OVER () / (2.0 * sum(y) OVER ()) ELSE count(*) OVER () / (2.0 * (count(*) OVER () - sum(y) OVER ())) END, 6) AS weight FROM tel")
def class_weight(spark, d):
    return r6(prepare.class_weight(scored(spark, d)).select("event_id", "weight"))


def training_rows(spark, d):
    """The full feature table with both failure labels, cut by time and written once for the many fit passes."""
    full = feature_table(telemetry(spark, d), errors(spark, d), maint(spark, d), failures(spark, d), machines(spark, d),
                         SENSORS, ERRORS, COMPS, tiebreak=TIE)
    kinds = dict(full.dtypes)
    full = full.withColumns({c: F.col(c).cast("double") for c in feature_columns(full) if kinds[c] != "string"})
    return materialise(training.time_split(full, *CUTS), "training")


def inputs(rows) -> tuple[list[str], list[str]]:
    """Numeric and categorical inputs; a numeric one without any value in the training rows has no mean and is left out."""
    kinds, names = dict(rows.dtypes), feature_columns(rows)
    numeric = [c for c in names if kinds[c] == "double"]
    n = rows.filter("split = 'train'").agg(*[F.count(c).alias(c) for c in numeric]).first()
    return [c for c in numeric if n[c]], [c for c in names if kinds[c] == "string"]


LABELS = {h: f"will_fail_in_{h}h" for h in S.HORIZONS}


def of_label(rows: DataFrame, horizon: int) -> DataFrame:
    return rows.withColumn("y", F.col(LABELS[horizon])).drop(*LABELS.values())


def each_horizon(spark, d, run: Callable[[DataFrame, Callable], DataFrame]) -> DataFrame:
    """What ``run`` gives for the rows of each horizon (label ``y``, split, vector ``features``) and a function that builds their
    models by name, with the horizon."""
    rows = training_rows(spark, d)
    names = inputs(rows)
    _, vectors = training.encoded(rows, *names, ["event_id", "split", *LABELS.values()])

    def model(name: str, **more):
        return training.on_vectors(training.get_model(name, *names, **more))

    parts = training.side_by_side(lambda h: run(of_label(vectors, h), model), S.HORIZONS)
    return reduce(DataFrame.unionByName, [part.withColumn("horizon", F.lit(h)) for h, part in zip(S.HORIZONS, parts, strict=True)])


def _scores(spark, d, name, **more):
    def run(rows, model):
        fitted = training.fit(rows.filter("split = 'train'"), model(name, **more))
        return training.score(fitted, rows.filter("split <> 'train'")).select("event_id", "split", "y", F.round("p", 6).alias("p"))

    return each_horizon(spark, d, run)


@query("i9_oversample")
def oversample(spark, d):
    return prepare.oversample(scored(spark, d).withColumn("y", F.col("y")), SENSORS, "event_id")


@query("i9_oversample_balance", f"WITH {TEL}, c AS (SELECT y, count(*) AS n FROM tel GROUP BY y) SELECT y, CAST((SELECT max(n) FROM c) AS BIGINT) AS n FROM c")
def oversample_balance(spark, d):
    return prepare.oversample(scored(spark, d), SENSORS, "event_id").groupBy("y").agg(F.count("*").alias("n"))


@query("i10_i14_i15_logistic_scores")
def logistic_scores(spark, d):
    return _scores(spark, d, "logistic_regression")


@query("i9_oversampled_scores")
def oversampled_scores(spark, d):
    """The default of training: classes made equal in size before the fit."""
    return _scores(spark, d, "logistic_regression", oversample=True)


@query("i11_forest_scores")
def forest_scores(spark, d):
    return _scores(spark, d, "random_forest")


@query("i12_boosting_scores")
def boosting_scores(spark, d):
    return _scores(spark, d, "gradient_boosting")


@query("i13_stacked_scores")
def stacked_scores(spark, d):
    return _scores(spark, d, "stacking")


@query("i16_i19_train_and_evaluate")
def train_and_evaluate(spark, d):
    def run(rows, model):
        return training.train_and_evaluate(rows, model("logistic_regression"))[1]

    return each_horizon(spark, d, run)


@query("i30_grid_search")
def grid_search(spark, d):
    from pyspark.ml.tuning import ParamGridBuilder

    rows = training_rows(spark, d)
    numeric, categorical = inputs(rows)
    folds = training.fold_vectors(rows.filter("split = 'train'"), training.get_model("logistic_regression", numeric, categorical), [*LABELS.values()])

    def run(horizon):
        own = of_label(rows, horizon)
        pipeline = training.get_model("logistic_regression", numeric, categorical)
        grid = ParamGridBuilder().addGrid(pipeline.getStages()[-1].regParam, [0.001, 0.1]).build()
        best = training.grid_search(own.filter("split = 'train'"), pipeline, grid, prepared=[of_label(t, horizon) for t in folds])
        return training.score(best.bestModel, own.filter("split = 'test'")).select(
            "event_id", "y", F.round("p", 6).alias("p"), F.lit(horizon).alias("horizon"))

    return reduce(DataFrame.unionByName, [run(h) for h in S.HORIZONS])


@query("i21_importance")
def importance(spark, d):
    from pyspark.ml.feature import StringIndexerModel

    rows = training_rows(spark, d)
    numeric, categorical = inputs(rows)
    before, vectors = training.encoded(rows, numeric, categorical, ["split", *LABELS.values()])
    labels = next((s.labelsArray for s in before.stages if isinstance(s, StringIndexerModel)), [])
    names = [*numeric, *[f"{c}_{v}" for c, values in zip(categorical, labels, strict=True) for v in values]]

    def run(horizon):
        pipeline = training.on_vectors(training.get_model("random_forest", numeric, categorical))
        model = training.fit(of_label(vectors, horizon).filter("split = 'train'"), pipeline)
        return explain.importance_table(spark, names, model.stages[-1]).withColumn("horizon", F.lit(horizon))

    return reduce(DataFrame.unionByName, training.side_by_side(run, S.HORIZONS))


@query("i22_runs_best")
def runs_best(spark, d):
    from gearwatch.session import scratch_path

    path = scratch_path(spark, "runs")
    rows = training_rows(spark, d)
    names = inputs(rows)
    _, vectors = training.encoded(rows, *names, ["split", *LABELS.values()])
    trials = [(name, h) for h in S.HORIZONS for name in ("logistic_regression", "logistic_regression_tuned")]

    def run(trial):
        return training.train_and_evaluate(of_label(vectors, trial[1]), training.on_vectors(training.get_model(trial[0], *names)))[1]

    for (name, horizon), metrics in zip(trials, training.side_by_side(run, trials), strict=True):
        training.append_run(metrics, path, f"{name}-{horizon}h", {"model": name, "horizon": horizon}, {"stage": "trial"})
    return training.best_runs(spark.read.parquet(path)).select("run", "split", "f1", "f2", "roc_auc")


# A fixed linear and tree model, so explanations have an exact oracle.
COEF = {"volt": 0.004, "rotate": -0.021, "p": 1.5}
IMPORTANCE = {"volt": 0.5, "rotate": 0.3, "p": 0.2}
MEANS = {"volt": 50.0, "rotate": 50.0, "p": 0.1}
_LIN = " UNION ALL ".join(f"SELECT event_id, '{f}' AS feature, {f} AS value, {c}::DOUBLE * {f} AS impact FROM tel" for f, c in COEF.items())
_TREE = " UNION ALL ".join(
    f"SELECT event_id, '{f}' AS feature, {f} AS value, {w}::DOUBLE * ({f} / (greatest(abs(volt), abs(rotate), abs(p)) + 1e-10)) * ((p - 0.5) * 2) AS impact FROM tel"
    for f, w in IMPORTANCE.items())


def linear(spark, d):
    return explain.linear_impacts(scored(spark, d), "event_id", COEF, -1.0)


@query("i23_linear_impacts", f"WITH {TEL}, l AS ({_LIN}) SELECT event_id, feature, round(value, 6) AS value, round(impact, 6) AS impact, round(1 / (1 + exp(1.0::DOUBLE)), 6) AS base_value FROM l")
def linear_impacts(spark, d):
    return r6(linear(spark, d))


@query("i23_centred_impacts", f"WITH {TEL} " + " UNION ALL ".join(
    f"SELECT event_id, '{f}' AS feature, round({c}::DOUBLE * ({f} - {MEANS[f]}::DOUBLE), 6) AS impact FROM tel" for f, c in COEF.items()))
def centred_impacts(spark, d):
    return r6(explain.linear_impacts(scored(spark, d), "event_id", COEF, -1.0, MEANS).select("event_id", "feature", "impact"))


@query("i24_tree_impacts", f"WITH {TEL}, l AS ({_TREE}) SELECT event_id, feature, round(value, 6) AS value, round(impact, 6) AS impact FROM l")
def tree_impacts(spark, d):
    return r6(explain.tree_impacts(scored(spark, d), "event_id", IMPORTANCE, "p"))


@query("e10_cumulative_impact", f"""WITH {TEL}, l AS ({_LIN}), c AS (SELECT *, row_number() OVER w AS rank, sum(abs(impact)) OVER (w ROWS UNBOUNDED PRECEDING) AS cum, sum(abs(impact)) OVER (PARTITION BY event_id) AS tot
 FROM l WINDOW w AS (PARTITION BY event_id ORDER BY abs(impact) DESC, feature))
 SELECT event_id, feature, CAST(rank AS INT) AS rank, round(cum, 6) AS cumulative_impact, round(cum / tot * 100, 6) AS cumulative_pct FROM c""")
def cumulative_impact(spark, d):
    return r6(explain.ranked(linear(spark, d), "event_id").select("event_id", "feature", "rank", "cumulative_impact", "cumulative_pct"))


@query("h6_top_impacts", f"""WITH {TEL}, l AS ({_LIN}) SELECT event_id, feature, round(impact, 6) AS impact FROM l
 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(impact) DESC, feature) <= 2""")
def top_impacts(spark, d):
    return r6(explain.top_impacts(linear(spark, d), "event_id", 2).select("event_id", "feature", "impact"))


@query("i25_driver_summary", f"""WITH {TEL}, l AS ({_LIN}), t AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(impact) DESC) = 1)
 SELECT t.event_id, feature, CASE WHEN p >= 0.5 THEN 'Main driver: ' || feature || printf(' (impact: %.3f)', impact) || '. Schedule immediate inspection'
 ELSE 'Continue monitoring: ' || feature || printf(' (value: %.2f)', value) END AS recommendation FROM t JOIN tel USING (event_id)""")
def driver_summary(spark, d):
    df = scored(spark, d)
    decisions = df.select("event_id", tiers.decide(F.col("p"), 0.5).alias("failure_prediction"))
    return explain.driver_summary(linear(spark, d), "event_id", decisions).select("event_id", "feature", "recommendation")


@query("i26_principal_components")
def principal_components(spark, d):
    full = series.sensor_features(telemetry(spark, d), SENSORS, ["machineID"], ["datetime", "event_id"], lags=[1], means=[3], stds=[], slopes=[])
    feats = [*SENSORS, *[f"{s}_{f}" for s in SENSORS for f in ("lag_1h", "mean_3h")]]
    return prepare.principal_components(full, feats).select("event_id", "pc1", "pc2", "pc3")
