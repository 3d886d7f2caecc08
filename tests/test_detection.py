"""Box matching, AP, confusion and suppression against direct NumPy calculations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gearwatch.catalog import detection as cat
from gearwatch.functions import boxes as B
from gearwatch.operators import dataset, detection

LABEL = "image_id long, label_id long, cls int, x1 double, y1 double, x2 double, y2 double"
DET = "image_id long, det_id long, cls int, x1 double, y1 double, x2 double, y2 double, conf double"


def iou(a, b):
    w = max(min(a[2], b[2]) - max(a[0], b[0]), 0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0)
    return w / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w + 1e-7)


def test_worked_examples(spark):
    lb = spark.createDataFrame([(1, 0, 1, 50.0, 50.0, 200.0, 200.0)], LABEL)
    dt = spark.createDataFrame([(1, 0, 1, 50.0, 50.0, 200.0, 200.0, .9), (1, 1, 0, 30.0, 30.0, 150.0, 150.0, .7)], DET)
    rows = {r["det_id"]: [r[f"tp{i}"] for i in range(10)] for r in detection.match(lb, dt).collect()}
    assert rows == {0: [1] * 10, 1: [0] * 10}
    pair = spark.createDataFrame([(30.0, 30.0, 150.0, 150.0, 50.0, 50.0, 200.0, 200.0)], "ax1 double, ay1 double, ax2 double, ay2 double, bx1 double, by1 double, bx2 double, by2 double")
    assert abs(pair.select(B.iou(B.corners("a"), B.corners("b"))).first()[0] - 0.3717472119) < 1e-9
    js = spark.createDataFrame([(42, 0, 0, 100.0, 50.0, 200.0, 150.0, .9), (42, 1, 1, 50.0, 30.0, 100.0, 80.0, .8)], DET)
    out = dataset.to_detection_json(js, {0: 18, 1: 19}).orderBy("category_id").collect()
    assert [(r["category_id"], list(r["bbox"]), r["score"]) for r in out] == [(18, [100, 50, 100, 100], .9), (19, [50, 30, 50, 50], .8)]


def random_boxes(rng, n, images, conf):
    xy = rng.integers(0, 60, size=(n, 2)).astype(float)
    wh = rng.integers(5, 40, size=(n, 2)).astype(float)
    rows = []
    for i in range(n):
        row = (int(rng.integers(images)), i, int(rng.integers(3)), *[float(v) for v in (*xy[i], *(xy[i] + wh[i]))])
        rows.append((*row, float(np.round(rng.random(), 6))) if conf else row)
    return rows


def test_average_precision_by_hand(spark):
    rng = np.random.default_rng(5)
    lb, dt = random_boxes(rng, 60, 4, False), random_boxes(rng, 150, 4, True)
    labels, dets = spark.createDataFrame(lb, LABEL), spark.createDataFrame(dt, DET)
    matched = detection.match(labels, dets)
    hits = {r["det_id"]: [r[f"tp{i}"] for i in range(10)] for r in matched.collect()}
    ap = {(r["cls"], r["level"]): r["ap"] for r in detection.average_precision(detection.curve_points(matched, labels, 10), labels, 10).collect()}
    per = {r["cls"]: r for r in detection.evaluate(labels, dets).collect()}
    grid, f1s, curves = np.linspace(0, 1, 1000), [], {}
    for c in range(3):
        d = sorted((r for r in dt if r[2] == c), key=lambda r: -r[7])
        n = sum(r[2] == c for r in lb)
        tp = np.array([hits[r[1]] for r in d])
        rec, pre = tp.cumsum(0) / (n + 1e-16), tp.cumsum(0) / np.arange(1, len(d) + 1)[:, None]
        for lv in range(10):
            mrec, mpre = np.r_[0, rec[:, lv], 1], np.r_[1, pre[:, lv], 0]
            mpre = np.flip(np.maximum.accumulate(np.flip(mpre)))
            x = np.linspace(0, 1, 101)
            y = np.interp(x, mrec, mpre)
            assert abs(((y[1:] + y[:-1]) / 2 * 0.01).sum() - ap[c, lv]) < 1e-6
        conf = np.array([r[7] for r in d])
        r0, p0 = np.interp(-grid, -conf, rec[:, 0], left=0), np.interp(-grid, -conf, pre[:, 0], left=1)
        curves[c] = (r0, p0)
        f1s.append(2 * p0 * r0 / (p0 + r0 + 1e-16))
    mean = np.mean(f1s, axis=0)
    padded = np.r_[np.ones(50) * mean[0], mean, np.ones(50) * mean[-1]]
    best = np.convolve(padded, np.ones(101) / 101, mode="valid").argmax()
    for c in range(3):
        assert abs(per[c]["r"] - curves[c][0][best]) < 1e-6 and abs(per[c]["p"] - curves[c][1][best]) < 1e-6


def greedy(rows, limit=0.45):
    keep = []
    for r in sorted(rows, key=lambda r: (-r["conf"], r["pred_id"], r["cls"])):
        if all(k["cls"] != r["cls"] or iou([k[c] for c in detection.BOX], [r[c] for c in detection.BOX]) <= limit for k in keep):
            keep.append(r)
    return keep


def test_suppression_by_hand(spark, sf):
    preds = cat.predictions(spark, sf).withColumn("image_id", F.col("image_id") % 20)
    scored = detection.score_predictions(preds, multi_label=True).persist()
    got = {(r["image_id"], r["pred_id"], r["cls"]) for r in detection.suppress(scored, max_det=10**6).collect()}
    images = {}
    for r in scored.collect():
        images.setdefault(r["image_id"], []).append(r)
    want = {(i, r["pred_id"], r["cls"]) for i, rows in images.items() for r in greedy(rows)}
    assert got == want
    top = detection.suppress(scored, max_det=5).groupBy("image_id").count().agg(F.max("count")).first()[0]
    assert top == 5


def test_merge_is_a_weighted_mean(spark):
    rows = [(1, 0, 0.0, 0.0, 10.0, 10.0, .9, 0), (1, 1, 1.0, 0.0, 11.0, 10.0, .6, 0), (1, 2, 50.0, 50.0, 60.0, 60.0, .8, 0)]
    df = spark.createDataFrame(rows, "image_id long, pred_id long, x1 double, y1 double, x2 double, y2 double, conf double, cls int")
    out = detection.suppress(df, merge=True).collect()
    assert len(out) == 1 and abs(out[0]["x1"] - 0.6 / 1.5) < 1e-9


def test_label_checks(spark):
    images = spark.createDataFrame([(i, 100, 100, "jpg") for i in range(5)] + [(5, 9, 50, "png")], "image_id int, width int, height int, format string")
    lines = spark.createDataFrame([
        (0, [0.0, -0.1, 0.5, 0.5, 0.5]), (1, [0.0, 1.01, 0.5, 0.5, 0.5]), (2, [0.0, 0.5, 0.5, 0.5]),
        (3, [0.0, 0.5, 0.5, 0.5, 0.5]), (3, [0.0, 0.5, 0.5, 0.5, 0.5]),
    ], "image_id int, fields array<double>")
    rows = {r["image_id"]: r for r in dataset.verify(images, lines).collect()}
    assert [rows[i]["status"] for i in range(6)] == ["corrupt", "corrupt", "corrupt", "found", "missing", "corrupt"]
    assert "negative" in rows[0]["reasons"] and "bounds" in rows[1]["reasons"] and "columns" in rows[2]["reasons"]
    assert rows[3]["duplicates"] == 1


def test_split_shares(spark):
    df = spark.range(20000).select(F.concat(F.lit("img"), F.col("id").cast("string")).alias("path"))
    n = {r["split"]: r["count"] for r in dataset.assign_split(df).groupBy("split").count().collect()}
    assert set(n) == {"train", "val"} and abs(n["train"] / 20000 - 0.9) < 0.02


def test_fill_classes(spark):
    per = spark.createDataFrame([(0, 0.5), (1, 0.7)], "cls int, ap double")
    classes = spark.createDataFrame([(0,), (1,), (2,)], "cls int")
    assert [round(r["ap"], 9) for r in detection.fill_classes(per, classes).orderBy("cls").collect()] == [0.5, 0.7, 0.6]


def test_class_table():
    assert len(dataset.CLASS_80_TO_91) == 80 and dataset.CLASS_80_TO_91[79] == 90 and dataset.CLASS_80_TO_91[11] == 13


@pytest.mark.parametrize("floor", [0.45, 0.5, 0.7])
def test_grid_probe_reaches_every_partner(spark, floor):
    rng = np.random.default_rng(9)
    lb = spark.createDataFrame(random_boxes(rng, 300, 1, False), LABEL)
    dt = spark.createDataFrame(random_boxes(rng, 300, 1, True), DET)
    grid = {(r["l_label_id"], r["d_det_id"]) for r in detection.iou_pairs(lb, dt, ["image_id"], floor).collect()}
    want = {(a["label_id"], b["det_id"]) for a in lb.collect() for b in dt.collect()
            if iou([a[c] for c in detection.BOX], [b[c] for c in detection.BOX]) >= floor}
    assert grid == want
