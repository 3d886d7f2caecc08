"""Invariants of training, explanation and projection."""

import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from gearwatch.catalog.base import SENSORS, errors, failures, machines, maint, scored, telemetry
from gearwatch.operators import explain, prepare
from gearwatch.plans import features, training, transformers

INPUTS = (telemetry, errors, maint, failures, machines)


@pytest.fixture(scope="module")
def separable(spark):
    df = spark.range(2000).select(
        F.col("id").alias("event_id"), (F.col("id") % 100).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    return df.withColumn("y", (F.col("a") > 60).cast("int")).withColumn("kind", F.when(F.col("b") > 3, "u").otherwise("v")).persist()


@pytest.mark.parametrize("name, params, share", [
    ("logistic_regression", {"max_iter": 50}, 0.01),
    # Ten times the penalty flattens the slope, so the balanced boundary moves a little into the larger class.
    ("logistic_regression_tuned", {"max_iter": 50}, 0.03),
    ("random_forest", {"trees": 10, "depth": 5}, 0.01), ("gradient_boosting", {"trees": 5}, 0.01),
])
def test_models_separate(separable, name, params, share):
    model = training.fit(separable, training.get_model(name, ["a", "b"], ["kind"], **params))
    out = training.score(model, separable)
    wrong = out.filter((F.col("p") >= 0.5).cast("int") != F.col("y")).count()
    assert wrong <= 2000 * share and out.count() == 2000


def test_stacking_is_saved_and_separates(spark, separable, tmp_path):
    training.register_model("small_stacking", lambda: training.Stacking(
        [training.logistic(max_iter=20), training.forest(trees=5, depth=4), training.boosting(trees=3)], folds=3))
    model = training.fit(separable, training.get_model("small_stacking", ["a", "b"], ["kind"]))
    out = training.score(model, separable)
    assert out.columns == [*separable.columns, "p"]
    assert out.filter((F.col("p") >= 0.5).cast("int") != F.col("y")).count() <= 20
    model.write().save(str(tmp_path / "stack"))
    again = training.score(PipelineModel.load(str(tmp_path / "stack")), separable)
    assert out.select("event_id", "p").exceptAll(again.select("event_id", "p")).count() == 0
    del training.MODELS["small_stacking"]


def test_oversampling_acts_in_fit_only(spark, separable):
    rare = separable.filter("y = 0 OR event_id % 5 = 0")
    pipeline = training.get_model("logistic_regression", ["a", "b"], ["kind"], oversample=True, max_iter=50)
    prepared = training.Pipeline(stages=pipeline.getStages()[:-1]).fit(rare).transform(rare)
    stage = pipeline.getStages()[-1]
    assert isinstance(stage, training.Oversampled)
    both = stage.balanced(prepared)
    sizes = {r["y"]: r["count"] for r in both.groupBy("y").count().collect()}
    assert sizes[0.0] == sizes[1.0] == rare.filter("y = 0").count()
    model = training.fit(rare, pipeline)
    assert not any(isinstance(s, training.Oversampled) for s in model.stages)
    out = training.score(model, rare)
    assert out.count() == rare.count()
    assert out.filter((F.col("p") >= 0.5).cast("int") != F.col("y")).count() <= 0.02 * rare.count()


def test_grid_search_spreads_the_penalty(spark, separable):
    from pyspark.ml.tuning import ParamGridBuilder

    few = separable.filter("event_id % 4 = 0")
    pipeline = training.get_model("logistic_regression", ["a", "b"], max_iter=30)
    grid = ParamGridBuilder().addGrid(pipeline.getStages()[-1].regParam, [1.0]).build()
    best = training.grid_search(few, pipeline, grid, folds=2).bestModel.stages[-1]
    plain = training.fit(few, training.get_model("logistic_regression", ["a", "b"], max_iter=30)).stages[-1]
    np.testing.assert_allclose(best.coefficients.toArray(), plain.coefficients.toArray(), rtol=1e-6)


def test_unknown_names():
    with pytest.raises(ValueError, match="random_forest"):
        training.get_model("nope", ["a"])
    with pytest.raises(ValueError):
        training.preprocessing(["a"], scaler="nope")


def test_unknown_category_is_all_zero(separable):
    model = training.fit(separable, training.get_model("logistic_regression", ["a"], ["kind"], max_iter=5))
    row = model.transform(separable.limit(1).withColumn("kind", F.lit("new")).withColumn("weight", F.lit(1.0))).first()
    assert list(row["features"].toArray()[1:]) == [0.0, 0.0]


def test_impacts_add_up_to_the_log_odds(separable):
    model = training.fit(separable, training.get_model("logistic_regression", ["a", "b"], max_iter=50))
    lr = model.stages[-1]
    prepared = model.transform(separable)
    from pyspark.ml.functions import vector_to_array

    x = prepared.select("event_id", vector_to_array("features").alias("v"), vector_to_array("probability")[1].alias("p"))
    x = x.select("event_id", "p", F.col("v")[0].alias("a"), F.col("v")[1].alias("b"))
    impacts = explain.linear_impacts(x, "event_id", dict(zip("ab", map(float, lr.coefficients))), lr.intercept)
    total = impacts.groupBy("event_id").agg(F.sum("impact").alias("s")).join(x, "event_id")
    for r in total.limit(50).collect():
        p = min(max(r["p"], 1e-12), 1 - 1e-12)
        assert abs(r["s"] + lr.intercept - math.log(p / (1 - p))) < 1e-6


def test_features_shown_rule(spark):
    rows = [(1, f"f{i}", 1.0, 0.0) for i in range(12)] + [(2, f"f{i}", 1.0, 1.0) for i in range(12)]
    out = explain.ranked(spark.createDataFrame(rows, "k int, feature string, value double, impact double"), "k")
    assert {r["k"]: r["features_shown"] for r in out.collect()} == {1: 10, 2: 10}


def test_zero_importances_count_as_ones(spark):
    df = spark.createDataFrame([(1, 2.0, -4.0, 0.75)], "k int, a double, b double, p double")
    got = {r["feature"]: r["impact"] for r in explain.tree_impacts(df, "k", {"a": 0.0, "b": 0.0}, "p").collect()}
    assert abs(got["a"] - 0.25) < 1e-9 and abs(got["b"] + 0.5) < 1e-9


def test_projection_matches_numpy(spark, sf):
    df = telemetry(spark, sf).withColumn("sum", F.col("volt") * 0.3 + F.col("rotate"))
    out = prepare.principal_components(df, ["volt", "rotate", "sum"], 2).orderBy("event_id")
    got = np.array([[r["pc1"], r["pc2"]] for r in out.collect()])
    m = np.array([[r["volt"], r["rotate"], r["sum"]] for r in df.orderBy("event_id").collect()])
    u, s, vt = np.linalg.svd(m - m.mean(0), full_matrices=False)
    want = (m - m.mean(0)) @ vt[:2].T
    signs = np.sign(vt[:2][np.arange(2), np.abs(vt[:2]).argmax(1)])
    assert np.allclose(got, want * signs, atol=1e-6)
    assert abs(got.mean()) < 1e-6


def test_transformer_survives_saving(spark, sf, tmp_path):
    stage = transformers.SensorFeatures(sensors=["volt"], order=["datetime", "event_id"])
    path = str(tmp_path / "pipeline")
    PipelineModel([stage, transformers.Float32()]).write().save(path)
    out = PipelineModel.load(path).transform(telemetry(spark, sf))
    assert dict(out.dtypes)["volt_mean_48h"] == "float" and out.count() == telemetry(spark, sf).count()


def test_feature_columns_and_families(spark, sf):
    from gearwatch.catalog.features import flagship

    full = flagship(spark, sf)
    names = features.feature_columns(full)
    assert not any(c.startswith("will_fail") for c in names) and "age" in names
    n = {r["family"]: r["n"] for r in features.feature_families(full).collect()}
    assert n == {"lag": 10, "rolling_mean": 10, "rolling_std": 6, "slope": 6, "error_flag": 4, "maintenance_age": 4}


def test_median_and_mode(spark):
    df = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (10.0, "b"), (None, None), (4.0, "a")], "x double, k string")
    assert prepare.fill_median(df, ["x"]).filter("x = 3.0").count() == 1
    assert prepare.fill_mode(df, ["k"]).filter("k = 'a'").count() == 3
    assert SENSORS and scored


@pytest.mark.parametrize("name", ["i10_i14_i15_logistic_scores", "i9_oversampled_scores", "i11_forest_scores", "i12_boosting_scores", "i13_stacked_scores",
                                  "i16_i19_train_and_evaluate", "i21_importance", "i22_runs_best", "i30_grid_search", "j1_score_stream"])
def test_learning_queries_ask_for_whole_models(spark, sf, monkeypatch, name):
    """No query shrinks a model or its number of folds, and all but the stream get the full feature table and both horizons."""
    from gearwatch.catalog import QUERIES
    from gearwatch.catalog.base import SENSORS as sensors

    asked, folds, build, small = [], [], training.get_model, training.MODELS["logistic_regression"]

    def get_model(kind, numeric, categorical=(), scaler="standard", oversample=False, **params):
        asked.append((kind, set(numeric), list(categorical), params))
        return build("small", numeric, categorical, scaler)

    def grid_search(train, pipeline, grid, label="y", folds_=training.FOLDS, search=training.grid_search, **other):
        folds.append(other.get("folds", folds_))
        return search(train, pipeline, grid, label, 2)

    monkeypatch.setitem(training.MODELS, "small", lambda: small(max_iter=2))
    monkeypatch.setattr(training, "get_model", get_model)
    monkeypatch.setattr(training, "grid_search", grid_search)
    monkeypatch.setattr(explain, "importance_table", lambda spark, names, model, **k: spark.createDataFrame([(len(names), len(model.coefficients))], "a int, b int"))
    out = QUERIES[name](spark, sf)
    assert asked and all(params == {} for *_, params in asked) and set(folds) <= {5}
    if name == "j1_score_stream":
        return
    full = set(features.feature_columns(features.feature_table(*[t(spark, sf) for t in INPUTS], sensors, ["error", "view"], ["purchase", "click"])))
    assert all(numeric | {*categorical} <= full and len(numeric) > 25 and categorical == ["model"] for _, numeric, categorical, _ in asked)
    if "horizon" in out.columns:
        assert {r[0] for r in out.select("horizon").distinct().collect()} == {24, 48}
    if name == "i13_stacked_scores":
        assert [kind for kind, *_ in asked] == ["stacking"] * 2
        whole = training.stacking()
        assert whole.folds == 5 and len(whole.bases) == 3
    if name == "i21_importance":
        assert all(r["a"] == r["b"] for r in out.collect())


def test_models_score_after_the_session_has_observed_metrics(spark, separable):
    from pyspark.sql import Observation

    seen = Observation()
    separable.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    assert seen.get["n"] == 2000
    for name, params in (("logistic_regression", {"max_iter": 5}), ("random_forest", {"trees": 3, "depth": 3})):
        model = training.fit(separable, training.get_model(name, ["a"], **params))
        assert not model.stages[-1].hasSummary
        assert training.score(model, separable).agg(F.sum("p")).first()[0] > 0


@pytest.fixture
def imputers(monkeypatch):
    """The fits of preprocessing, one entry each."""
    seen, fit = [], training.Imputer._fit
    monkeypatch.setattr(training.Imputer, "_fit", lambda self, rows: seen.append(1) or fit(self, rows))
    return seen


def test_grid_search_prepares_a_fold_once(separable, imputers):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    few = separable.filter("event_id % 4 = 0").withColumn("y", F.when(F.col("event_id") % 16 == 0, 1 - F.col("y")).otherwise(F.col("y")))
    pipeline = training.get_model("logistic_regression", ["a", "b"], ["kind"], max_iter=30)
    strength = pipeline.getStages()[-1].regParam
    found = training.grid_search(few, pipeline, ParamGridBuilder().addGrid(strength, [0.1, 10_000.0]).build(), folds=2)
    assert len(imputers) == 3  # two folds and all rows; one more for each further point of the grid before
    judge = MulticlassClassificationEvaluator(labelCol="y", metricName="fMeasureByLabel", metricLabel=1.0)
    n = few.count()
    plain = CrossValidator(estimator=training.spread_penalty(pipeline, n), evaluator=judge, numFolds=2, seed=training.SEED,
                           estimatorParamMaps=ParamGridBuilder().addGrid(strength, [0.1 / n, 10_000.0 / n]).build()).fit(prepare.class_weight(few))
    np.testing.assert_allclose(found.avgMetrics, plain.avgMetrics, rtol=1e-6)
    np.testing.assert_allclose(found.bestModel.stages[-1].coefficients.toArray(), plain.bestModel.stages[-1].coefficients.toArray(), rtol=1e-6)


def test_horizons_share_their_vectors(spark, sf, imputers):
    from gearwatch.catalog import QUERIES

    scores = QUERIES["i10_i14_i15_logistic_scores"](spark, sf)
    assert len(imputers) == 1  # once for each horizon before
    assert {r["horizon"] for r in scores.select("horizon").distinct().collect()} == {24, 48}
