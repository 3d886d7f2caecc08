"""Small inputs with known results: interval ends, ties, nulls, empty tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gearwatch import schemas as S
from gearwatch.functions import text as X, tiers
from gearwatch.operators import alerts, anomaly, asof, curves, prefix, quality, registry, report, retrieval, series
from gearwatch.sources import annotations as A, tables as IO

T0 = datetime(2015, 6, 1)


def at(hours, micros=0):
    return T0 + timedelta(hours=hours, microseconds=micros)


def readings(spark, hours, machine=1):
    rows = [(i, machine, h if isinstance(h, datetime) else at(h), float(i)) for i, h in enumerate(hours)]
    return spark.createDataFrame(rows, "event_id long, machineID int, datetime timestamp, volt double")


def values(df, order, *cols):
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.orderBy(order).collect()]


def test_failure_horizon_ends_are_inclusive(spark):
    failures = spark.createDataFrame([(at(0), 1, "comp1"), (at(0), 1, "comp2")], S.FAILURES)
    out = asof.add_history(readings(spark, [-25, -24, -1, 0, 1]), failures=failures)
    assert values(out, "event_id", "will_fail_in_24h") == [0, 1, 1, 1, 0]
    assert out.count() == 5


def test_error_flags(spark):
    errors = spark.createDataFrame([(at(0), 1, "error1")], S.ERRORS)
    out = asof.add_history(readings(spark, [-1, 0, 24, at(24, 1), 48, 49]), errors=errors, error_types=["error1"])
    assert values(out, "event_id", "error1_last_24h") == [0, 1, 1, 0, 0, 0]
    assert values(out, "event_id", "error1_last_48h") == [0, 1, 1, 1, 1, 0]


def test_maintenance_age(spark):
    maint = spark.createDataFrame([(at(0), 1, "comp1")], S.MAINT)
    out = asof.add_history(readings(spark, [-1, 0, 36]), maint=maint, comps=["comp1"])
    assert values(out, "event_id", "time_since_maint_comp1_h", "time_since_maint_comp1_d") == [(None, None), (0.0, 0.0), (36.0, 1.5)]


def test_asof_takes_the_last_of_equal_times(spark):
    left = readings(spark, [1, 2, 3])
    right = spark.createDataFrame([(1, at(2), 1, "a"), (1, at(2), 2, "b")], "machineID int, datetime timestamp, n int, tag string")
    out = asof.asof_join(left, right, "datetime", ["machineID"], ["tag"], tiebreak=["n"])
    assert values(out, "event_id", "tag") == [None, "b", "b"]
    first = asof.asof_join(left, right, "datetime", ["machineID"], ["tag"], "forward", tiebreak=["n"])
    assert values(first, "event_id", "tag") == ["a", "a", None]


def test_rolling_needs_non_null_values(spark):
    df = readings(spark, [0, 1, 2, 3]).withColumn("volt", F.element_at(F.array(F.lit(1.0), F.lit(None), F.lit(3.0), F.lit(4.0)), (F.col("event_id") + 1).cast("int")))
    out = series.sensor_features(df, ["volt"], lags=[1], means=[2], stds=[2], slopes=[])
    assert values(out, "event_id", "volt_mean_2h") == [None, None, None, 3.5]


def test_slope_and_cold_start(spark):
    df = readings(spark, [0, 1, 2, 3]).withColumn("volt", F.element_at(F.array(*[F.lit(v) for v in (10.0, 11.0, 12.0, 16.0)]), (F.col("event_id") + 1).cast("int")))
    out = series.sensor_features(df, ["volt"])
    assert values(out, "event_id", "volt_slope_3h")[-1] == 2.0
    cold = series.cold_start(df.filter("event_id = 0"), ["volt"]).first()
    assert (cold["volt_lag_24h"], cold["volt_mean_48h"], cold["volt_std_48h"], cold["volt_slope_12h"]) == (10.0, 10.0, 0.0, 0.0)
    assert (cold["error1_last_24h"], cold["time_since_maint_comp1_d"]) == (0, 2.0)


def test_tiers(spark):
    def tier(fn, vals):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, p double")
        return values(df.withColumn("t", fn(F.col("p"))), "i", "t")

    assert tier(tiers.risk_level, [0.0, .3, .30001, .7, 1.0, 1.2, None]) == [None, "Low", "Medium", "Medium", "High", None, None]
    assert tier(tiers.api_tier, [.8, .7999, .6, .59]) == ["Critical", "Warning", "Warning", "Normal"]
    assert tier(tiers.mail_tier, [.8, .81, .6, .61]) == ["HIGH", "CRITICAL", "MEDIUM", "HIGH"]
    assert tier(lambda p: tiers.threshold_tier(p, .7), [.7, .71, .48, .5]) == ["WARNING", "CRITICAL", "NORMAL", "WARNING"]
    assert tier(tiers.component_tier, [81.0, 61.0, 41.0, 40.0]) == ["Critical", "Warning", "Check Soon", "Good"]


def test_urgency_floors_days(spark):
    df = spark.createDataFrame([(i, at(h)) for i, h in enumerate((-1, 25, 168, 720, 744))], "i int, t timestamp")
    days = tiers.whole_days(F.col("t"), F.lit(T0).cast("timestamp"))
    out = df.withColumn("d", days).withColumn("u", tiers.maintenance_urgency(F.col("d")))
    assert values(out, "i", "d", "u") == [(-1, "Overdue"), (1, "Critical"), (7, "Critical"), (30, "Soon"), (31, "Scheduled")]


def test_summary_numbers(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)], "x double")
    one = quality.eight_numbers(df, ["x"]).first()
    assert one["q25"] == 1.75 and abs(one["std"] - 1.2909944487) < 1e-9
    same = spark.createDataFrame([(1, "a")] * 3, "x int, y string")
    assert quality.null_and_duplicate_totals(same).first()["duplicate_rows"] == 2


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 3, 4, 5, 6, 7, 8, 10)], "x double")
    assert values(prefix.histogram(df, "x", 5), "bin", "n") == [2, 2, 2, 2, 2]


def test_mode_prefers_the_smaller(spark):
    df = spark.createDataFrame([(m, at(i)) for i, m in enumerate((3, 1, 3, 1))], "machineID int, datetime timestamp")
    assert {r["machineID"] for r in report.busiest_machine(df).collect()} == {1}


def test_chunks(spark):
    df = spark.createDataFrame([(0, "ABCDEFGHIJ"), (1, "ABCD"), (2, "")], "i int, t string")
    got = values(df.withColumn("c", X.chunks(F.col("t"), 4, 2)), "i", "c")
    assert got == [["ABCD", "CDEF", "EFGH", "GHIJ"], ["ABCD"], []]
    with pytest.raises(ValueError):
        X.chunks(F.col("t"), 4, 4)


def test_text_helpers(spark):
    df = spark.createDataFrame([("Motor", ["a", "b", "c", "d"])], "t string, s array<string>")
    none = F.lit("")
    assert df.select(X.compose_problem(F.col("t"), none, none, F.col("s")).alias("c")).first()[0] == "Motor \n Solution: a | b | c"
    q = spark.createDataFrame([(0, "history of pump"), (1, "how do I"), (2, "Hello"), (3, "machine id #42 and 1234"), (4, "a!b-ما é"), (5, "مرحبا يا صديقي")], "i int, t string")
    assert values(q.withColumn("g", X.is_greeting(F.col("t"))), "i", "g") == [True, False, True, False, False, True]
    assert values(q.withColumn("m", X.machine_ids(F.col("t"))), "i", "m")[3] == ["1234", "42"]
    assert values(q.withColumn("s", X.sanitise(F.col("t"))), "i", "s")[4] == "ab-ما é"
    assert values(q.withColumn("l", X.language(F.col("t"))), "i", "l")[5] == "ar"


@pytest.mark.parametrize("k, matches, expected", [(5, 6, 6), (5, 5, 5), (20, 25, 10)])
def test_dynamic_top_k(spark, k, matches, expected):
    corpus = spark.createDataFrame([(i, [1.0, 0.001 * i]) for i in range(matches)] + [(99, [-1.0, 0.0]), (98, None), (97, [0.0, 0.0])],
                                   "chunk_id int, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "question_id int, embedding array<float>")
    out = retrieval.dynamic_top_k(corpus, asked, k).collect()
    assert len(out) == expected and {r["question_id"] for r in out} == {1}


def test_curves_with_ties(spark):
    df = spark.createDataFrame(list(zip([0, 1, 1, 0, 1, 0], [.1, .9, .6, .6, .4, .2])), "y int, p double")
    one = curves.auc_and_ap(df).first()
    assert abs(one["roc_auc"] - 0.8333333333) < 1e-9 and abs(one["pr_auc"] - 0.8055555556) < 1e-9
    best = curves.best_threshold(df).first()
    assert best["threshold"] == 0.4 and abs(best["fbeta"] - 0.9375) < 1e-9


def test_alert_history(spark):
    rows = [(42, "Critical")] * 4 + [(3, "Warning"), (11, "Warning"), (12, "Warning"), (13, "Normal"), (14, "Normal"), (15, "Normal")]
    df = spark.createDataFrame(rows, "machineID int, risk_level string")
    one = alerts.alert_stats(df).first()
    assert (one["total"], one["critical_pct"], one["warning_pct"], one["normal_pct"]) == (10, 40.0, 30.0, 30.0)
    assert [tuple(r) for r in alerts.top_alert_machines(df).collect()] == [(42, 4), (3, 1), (11, 1)]
    assert alerts.alert_stats(df.limit(0)).first()["critical_pct"] == 0.0


def test_rules(spark):
    df = spark.createDataFrame([(1, 61.0, 90.0, 0.1), (2, 60.0, 79.9, 0.81)], "id int, vibration double, pressure double, failure_prob double")
    out = values(alerts.evaluate_rules(df), "id", "id", "severity", "message")
    assert out[0] == (1, "CRITICAL", "Vibration at 61.0 Hz exceeds threshold (60 Hz)")
    assert {o[1] for o in out[1:]} == {"HIGH", "CRITICAL"}


def test_empty_inputs(spark):
    none = readings(spark, [0]).limit(0)
    errors = spark.createDataFrame([], S.ERRORS)
    assert asof.add_history(none, errors=errors).count() == 0
    assert series.sensor_features(none, ["volt"]).count() == 0
    assert quality.overview(none).first()["missing_pct"] == 0.0
    assert anomaly.iqr_outliers(none, ["volt"], ["machineID"]).count() == 0
    assert curves.auc_and_ap(spark.createDataFrame([], "y int, p double")).first()["roc_auc"] is None


def test_change_set(spark):
    target = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0)], "id int, name string, price double")
    changes = spark.createDataFrame([
        (1, "update", 1, "", 5.0), (2, "delete", 2, None, None), (9, "update", 3, "x", 1.0), (4, "insert", 4, "d", None),
        (3, "delete", 5, None, None), (3, "insert", 6, "again", None), (1, "update", 7, "z", None),
    ], "id int, op string, seq int, name string, price double")
    out = sorted(tuple(r) for r in registry.apply_changes(target, changes).collect())
    assert out == [(1, "z", 5.0), (3, "again", None), (4, "d", None)]


def test_shortest_number_text(spark):
    vals = [0.0, 0.5, 1.0, 123456.0, 1234567.0, 0.0001, 0.00001234, 0.333333333, 100.25, 2.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v double")
    assert values(df.withColumn("s", A.shortest(F.col("v"))), "i", "s") == ["%g" % v for v in vals]


def test_sources(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"id": "1", "title": "t", "solutions": ["x"]}\n\n{"id": \n{"id": "2"}\n')
    good, bad = IO.read_jsonl(spark, str(tmp_path / "p.jsonl"))
    assert (good.count(), bad.count()) == (2, 1)
    (tmp_path / "s.csv").write_text("machineID,volt\n1,2.5\n")
    row = IO.read_scoring_input(spark, str(tmp_path / "s.csv")).first()
    assert (row["model"], row["age"], row["volt"]) == ("model1", 18, 2.5)
    images = tmp_path / "images"
    images.mkdir()
    for name in ("a.JPG", "b.png", "c.txt"):
        (images / name).write_text("x")
    assert A.list_images(spark, str(images)).count() == 2
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels" / "a.txt").write_text("0 0.5 0.5 0.2 0.2\n\n1 0.1 0.1 0.3 0.1 0.3 0.5\n")
    rows = A.labels_from_fields(A.read_label_lines(spark, str(tmp_path / "labels"))).orderBy("cls").collect()
    assert [r["image_id"] for r in rows] == ["a", "a"] and abs(rows[1]["h"] - 0.4) < 1e-9 and rows[0]["polygon"] is None
    with pytest.raises(ValueError):
        quality.require_columns(good, ["nope"])


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert S.normalise(df).filter("x IS NULL").count() == 1


def test_problem_defaults_and_labels(spark):
    df = spark.createDataFrame([(None, None, None, 1), ("k", "t", ["s"], 2)], "id string, title string, solutions array<string>, n int")
    out = sorted(tuple(r) for r in registry.problem_defaults(df, ["n"]).collect())
    assert out == [("k", "t", ["s"], 2), ("problem_1", "", [], 1)]
