"""Evaluation of object detections: box matching, average precision, confusion matrix, suppression.

Labels are rows (image_id, label_id, cls, x1, y1, x2, y2); detections add det_id and conf. Ids are unique inside an
image; detections of an image rank by confidence, then det_id.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gearwatch.functions import boxes as B
from gearwatch.operators.prefix import prefix_sums
from gearwatch.operators.vectors import matrix
from gearwatch.session import materialise

# IoU levels, cut-offs and limits.
LEVELS = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]
CONFUSION_CONF, CONFUSION_IOU = 0.25, 0.45
NMS_CONF, NMS_IOU, MAX_NMS, MAX_DET = 0.25, 0.45, 30_000, 300
FITNESS = {"map50": 0.1, "map": 0.9}
BOX = ["x1", "y1", "x2", "y2"]
TINY = 1e-16
#: Labels, detections or boxes of an image up to which all its pairs are compared; beyond it they meet through the grid.
CROWD_ROWS = 1000
#: Masks of a slice at most and the bytes that they may take, and masks of one product of matrices.
MASK_ROWS, MASK_BYTES, MASK_STEP = 4096, 64 << 20, 1024


def unique_boxes(df: DataFrame, keys: Sequence[str], id_col: str, extra: Sequence[str] = (), by_conf: bool = False) -> DataFrame:
    """One row per distinct box: copies can never win against the first of them, so only that one is paired.

    The first is the one with the smallest id, or ``by_conf`` the most confident one.
    """
    order = F.struct(-F.col("conf"), F.col(id_col)) if by_conf else F.col(id_col)
    keep = [id_col, *extra]
    return df.groupBy(*keys, *BOX).agg(F.min_by(F.struct(*keep), order).alias("_k")).select(*keys, *BOX, "_k.*")


def _named(df: DataFrame, prefix: str, keys: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}_{c}" for c in df.columns if c not in keys})


def _by_crowding(run: Callable[..., DataFrame], *tables: DataFrame) -> DataFrame:
    """What ``run(*tables, crowded)`` gives for the images with at most ``CROWD_ROWS`` rows in every table, which share one
    exchange by image, and for the others, which come without it and need the grid."""
    sizes = [df.groupBy("image_id").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD_ROWS).select("image_id") for df in tables]
    crowded = materialise(reduce(DataFrame.unionByName, sizes).filter("image_id IS NOT NULL").distinct(), "crowded-images")
    if crowded.isEmpty():
        return run(*[df.repartition("image_id") for df in tables], False)
    calm = run(*[df.join(crowded, "image_id", "left_anti").repartition("image_id") for df in tables], False)
    return calm.unionByName(run(*[df.join(crowded, "image_id", "left_semi") for df in tables], True))


def _near(left: DataFrame, right: DataFrame, keys: Sequence[str], floor: float, crowded: bool) -> DataFrame:
    """Pairs (l_, d_) of a group whose boxes have a common area: all of a calm image, or those that the grid brings together."""
    if crowded:
        cells = ["_lw", "_lh", "_gx", "_gy"]
        # The optimizer takes an exploded table for as small as the table before, and would broadcast it; a merge join it is.
        return _probe(left, floor).hint("merge").join(_place(right, floor), [*keys, *cells]).drop(*cells)
    real = lambda df, p: df.filter((F.col(f"{p}_x2") > F.col(f"{p}_x1")) & (F.col(f"{p}_y2") > F.col(f"{p}_y1")))
    others = {k: f"_d_{k}" for k in keys if k != "image_id"}
    return real(left, "l").join(real(right, "d").withColumnsRenamed(others), "image_id").filter(_overlapping(others)).drop(*others.values())


def _overlapping(others: dict[str, str]) -> Column:
    """Boxes l_ and d_ with a common area and equal ``others``; stated as ranges, as an equality would be one more key of the
    join, which would deal the rows anew."""
    test = F.lit(True)
    for a, b in others.items():
        test &= (F.col(a) <= F.col(b)) & (F.col(a) >= F.col(b))
    for c in "xy":
        test &= (F.col(f"l_{c}1") < F.col(f"d_{c}2")) & (F.col(f"d_{c}1") < F.col(f"l_{c}2"))
    return test


def _iou_pairs(labels: DataFrame, dets: DataFrame, crowded: bool, keys: list[str], floor: float, strict: bool, by_conf: bool) -> DataFrame:
    kind = [c for c in ("cls",) if c not in keys]
    left = _named(unique_boxes(labels, keys, "label_id", kind), "l", keys)
    right = _named(unique_boxes(dets, keys, "det_id", [*kind, "conf"], by_conf), "d", keys)
    pairs = _near(left, right, keys, floor, crowded).withColumn("iou", B.iou(B.corners("l_"), B.corners("d_")))
    return pairs.filter(F.col("iou") > floor if strict else F.col("iou") >= floor)


def iou_pairs(labels: DataFrame, dets: DataFrame, keys: Sequence[str], floor: float, strict: bool = False,
              by_conf: bool = False) -> DataFrame:
    """Label-detection pairs with IoU of at least (or above) ``floor``.

    Images of up to ``CROWD_ROWS`` labels and detections are compared in full after one exchange by image. In others a label
    meets only the detections in grid cells of matching size and place, as boxes that overlap by ``floor`` have sides within a
    factor 1/floor and near centres: about ten cells. Copies of a box are paired once.
    """
    return _by_crowding(lambda lb, dt, crowded: _iou_pairs(lb, dt, crowded, list(keys), floor, strict, by_conf), labels, dets)


def best_labels(labels: DataFrame, dets: DataFrame, keys: Sequence[str], floor: float, strict: bool = False,
                by_conf: bool = False) -> DataFrame:
    """All detections with the label of their group they overlap most: (det columns, ``label_id, l_cls, iou``).

    Nulls when no label reaches ``floor``; the smaller label id wins on equal IoU. Groups of any size are matched, crowded ones
    through the grid (``iou_pairs``); without crowded ones the rows stay dealt by image. Copies of a box lose every tie
    against the first of them (smallest id, or ``by_conf`` most confident), so they stay without a label.
    """
    keys = list(keys)
    cls = "cls" if "cls" in keys else "l_cls"
    label, place = F.struct(F.col("l_label_id").alias("label_id"), F.col(cls).alias("l_cls"), "iou"), F.struct(F.col("iou"), -F.col("l_label_id"))

    def run(labels: DataFrame, dets: DataFrame, crowded: bool) -> DataFrame:
        if not crowded:
            return calm(labels, dets)
        best = _iou_pairs(labels, dets, True, keys, floor, strict, by_conf).groupBy("image_id", "d_det_id").agg(
            F.max_by(label, place).alias("b")).select("image_id", F.col("d_det_id").alias("det_id"), "b.*")
        return dets.join(best, ["image_id", "det_id"], "left")

    def calm(labels: DataFrame, dets: DataFrame) -> DataFrame:
        # Rows stay where the exchange by image has put them: the first copy of a box is marked, not looked up again.
        order = F.struct(-F.col("conf"), F.col("det_id")) if by_conf else F.struct("det_id")
        lead = F.min(order).over(W.partitionBy(*keys, *BOX)) == order
        real = (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
        again = F.row_number().over(W.partitionBy("image_id", "det_id").orderBy(*BOX))
        own = dets.withColumns({"_lead": F.coalesce(lead & real & F.col("det_id").isNotNull(), F.lit(False)), "_again": again})
        for c in BOX:
            own = own.withColumn(f"d_{c}", F.col(c))
        others = {k: f"_l_{k}" for k in keys if k != "image_id"}
        kind = [c for c in ("cls",) if c not in keys]
        left = _named(unique_boxes(labels, keys, "label_id", kind), "l", keys).filter("l_x2 > l_x1 AND l_y2 > l_y1").withColumnsRenamed(
            {"image_id": "_l_image_id", **others})
        iou = B.iou(B.corners("l_"), B.corners("d_"))
        near = (F.col("image_id") == F.col("_l_image_id")) & F.col("_lead") & _overlapping(others) & (iou > floor if strict else iou >= floor)
        met = own.join(left, near, "left").withColumn("iou", F.when(F.col("l_label_id").isNotNull(), iou))
        row = ["image_id", "det_id", "_again"]
        rest = [c for c in dets.columns if c not in row]
        best = met.groupBy(*row).agg(F.first(F.struct(*rest)).alias("r"), F.max_by(label, F.when(F.col("iou").isNotNull(), place)).alias("b"))
        return best.select("image_id", "det_id", "r.*", "b.label_id", "b.l_cls", "b.iou")

    return _by_crowding(run, labels, dets)


def _base(floor: float) -> float:
    """Ratio of the size levels of the grid: partners of a box lie in two neighbouring levels at most."""
    return 1.001 / floor**2


def _level(side: Column, floor: float) -> Column:
    return F.floor(F.log(side) / math.log(_base(floor))).cast("int")


def _place(dets: DataFrame, floor: float) -> DataFrame:
    """Cell of a detection: size level per side, and the centre on a grid as wide as the largest box of that level."""
    w, h = F.col("d_x2") - F.col("d_x1"), F.col("d_y2") - F.col("d_y1")
    out = dets.filter((w > 0) & (h > 0)).withColumns({"_lw": _level(w, floor), "_lh": _level(h, floor)})
    grid = {}
    for g, lv, a, b in (("_gx", "_lw", "d_x1", "d_x2"), ("_gy", "_lh", "d_y1", "d_y2")):
        grid[g] = F.floor((F.col(a) + F.col(b)) / 2 / F.pow(F.lit(_base(floor)), F.col(lv) + 1))
    return out.withColumns(grid)


def _probe(labels: DataFrame, floor: float) -> DataFrame:
    """Every cell in which a partner of a label can lie: one or two levels for each side, and few cells of each.

    A partner of side t has its centre within (s + t) / 2 - floor * max(s, t) of a label of side s, with t between
    floor * s and s / floor.
    """
    base, slack = F.lit(_base(floor)), 1.001
    w, h = F.col("l_x2") - F.col("l_x1"), F.col("l_y2") - F.col("l_y1")
    out = labels.filter((w > 0) & (h > 0)).withColumns({"_w": w, "_h": h})
    for side, lv in (("_w", "_lw"), ("_h", "_lh")):
        s = F.col(side)
        out = out.withColumn(lv, F.explode(F.sequence(_level(s * floor / slack, floor), _level(s / floor * slack, floor))))
    for g, lv, side, a, b in (("_gx", "_lw", "_w", "l_x1", "l_x2"), ("_gy", "_lh", "_h", "l_y1", "l_y2")):
        s, cell = F.col(side), F.pow(base, F.col(lv) + 1)
        low, high = F.greatest(s * floor / slack, cell / base), F.least(s / floor * slack, cell)
        ends = [(s + t) / 2 - F.greatest(s, t) * floor for t in (high, F.least(F.greatest(s, low), high))]
        reach = (F.greatest(*ends) + s * 1e-3) * slack
        mid = (F.col(a) + F.col(b)) / 2
        out = out.withColumn(g, F.explode(F.sequence(F.floor((mid - reach) / cell), F.floor((mid + reach) / cell))))
    return out.drop("_w", "_h")


def match(labels: DataFrame, dets: DataFrame, levels: Sequence[float] = LEVELS) -> DataFrame:
    """V5: detections with one 0/1 column per IoU level (tp0, tp1, ...).

    Each detection takes its best label of the same class; at every level a label keeps its first detection by
    confidence among those that reach the level.
    """
    best = best_labels(labels, dets, ["image_id", "cls"], min(levels), by_conf=True)
    return _first_per_label(best, ["image_id", "cls"], levels).select(*dets.columns, *[f"tp{i}" for i in range(len(levels))])


def _first_per_label(best: DataFrame, keys: Sequence[str], levels: Sequence[float]) -> DataFrame:
    """tp columns from (label_id, iou, conf, det_id): a detection is first at a level when it reaches it and no
    earlier detection of the same label does, which one running maximum tells for all levels."""
    earlier = W.partitionBy(*keys, "label_id").orderBy(F.desc("conf"), "det_id").rowsBetween(W.unboundedPreceding, -1)
    ranked = best.withColumn("_before", F.coalesce(F.max("iou").over(earlier), F.lit(-1.0)))
    known = F.col("label_id").isNotNull()
    return ranked.withColumns({
        f"tp{i}": F.coalesce((known & (F.col("iou") >= t) & (F.col("_before") < t)).cast("int"), F.lit(0))
        for i, t in enumerate(levels)
    })


def _cell(value: Column, steps: int) -> Column:
    """Largest k with k/steps <= value, safe against rounding of the product."""
    k = F.floor(value * steps)
    step = F.lit(1.0 / steps)
    return F.when((k + 1) * step <= value, k + 1).when(k * step > value, k - 1).otherwise(k).cast("int")


def _upper_cell(value: Column, steps: int) -> Column:
    """Smallest k with value <= k/steps."""
    k = F.ceil(value * steps)
    step = F.lit(1.0 / steps)
    return F.when((k - 1) * step >= value, k - 1).when(k * step < value, k + 1).otherwise(k).cast("int")


def curve_points(matched: DataFrame, labels: DataFrame, n_levels: int) -> DataFrame:
    """Recall and precision at every distinct confidence per class and level (rc0, pr0, ...).

    Detections of equal confidence share one point, so the curve does not depend on their order. The counts per
    confidence are written once, so a curve that is read several times is not matched again.
    """
    tps = [f"tp{i}" for i in range(n_levels)]
    at_conf = matched.groupBy("cls", "conf").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in tps])
    ranked = prefix_sums(at_conf.withColumn("_desc", -F.col("conf")), "_desc", ["n", *tps], ["cls"])
    targets = labels.groupBy("cls").agg(F.count("*").alias("n_labels"))
    return ranked.join(targets, "cls").select(
        "cls", "conf", "n_labels",
        *[(F.col(f"cum_{c}") / (F.col("n_labels") + TINY)).alias(f"rc{i}") for i, c in enumerate(tps)],
        *[(F.col(f"cum_{c}") / F.col("cum_n")).alias(f"pr{i}") for i, c in enumerate(tps)],
    )


def average_precision(points: DataFrame, labels: DataFrame, n_levels: int) -> DataFrame:
    """E13 + V6: 101-point interpolated AP per class and level.

    Points fold into 101 recall cells per class and level first; the precision envelope and the interpolation then
    run on that small grid: at x, the line from the last point with recall <= x to the first beyond it, each
    raised to the highest precision at or after it.
    """
    long = points.select("cls", "conf", F.inline(F.array(*[
        F.struct(F.lit(i).alias("level"), F.col(f"rc{i}").alias("rc"), F.col(f"pr{i}").alias("pr")) for i in range(n_levels)
    ])))
    folded = long.groupBy("cls", "level", _upper_cell(F.col("rc"), 100).alias("k")).agg(
        F.max("pr").alias("top"), F.max("rc").alias("hi"), F.min("rc").alias("lo"), F.min_by("pr", "conf").alias("tail"))
    grid = labels.select("cls").distinct().select(
        "cls", F.explode(F.sequence(F.lit(0), F.lit(n_levels - 1))).alias("level")
    ).select("cls", "level", F.explode(F.sequence(F.lit(0), F.lit(100))).alias("k"))
    up = W.partitionBy("cls", "level").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    beyond = W.partitionBy("cls", "level").orderBy(F.desc("k")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("cls", "level")
    g = grid.join(folded, ["cls", "level", "k"], "left").select(
        "cls", "level", "k",
        F.coalesce(F.last("hi", True).over(up), F.lit(0.0)).alias("a"),
        F.last("tail", True).over(up).alias("pa"),
        F.coalesce(F.max("top").over(beyond), F.lit(0.0)).alias("m"),
        F.coalesce(F.last("lo", True).over(beyond), F.lit(1.0)).alias("b"),
        F.count("top").over(whole).alias("seen"),
    )
    env = F.when(F.col("pa").isNull(), 1.0).otherwise(F.greatest("pa", "m"))
    x = F.col("k") * 0.01
    y = F.when((F.col("k") == 100) | (F.col("seen") == 0), 0.0).otherwise(
        env + (F.col("m") - env) * (x - F.col("a")) / (F.col("b") - F.col("a")))
    half = F.when(F.col("k").isin(0, 100), 0.5).otherwise(1.0)
    return g.withColumn("y", y).groupBy("cls", "level").agg((F.sum(F.col("y") * half) * 0.01).alias("ap"))


def confidence_curves(points: DataFrame, labels: DataFrame, steps: int = 999) -> DataFrame:
    """V6: recall, precision and F1 of the first level on an even confidence grid, per class (interpolated)."""
    pt = F.struct(F.col("conf"), F.col("rc0").alias("r"), F.col("pr0").alias("p"))
    folded = points.groupBy("cls", _cell(F.col("conf"), steps).alias("k")).agg(
        F.min_by(pt, "conf").alias("low"), F.max_by(pt, "conf").alias("high"))
    grid = labels.select("cls").distinct().select("cls", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("k"))
    down = W.partitionBy("cls").orderBy(F.desc("k")).rowsBetween(W.unboundedPreceding, 0)
    under = W.partitionBy("cls").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("cls")
    g = grid.join(folded, ["cls", "k"], "left").select(
        "cls", "k", F.last("low", True).over(down).alias("j"), F.last("high", True).over(under).alias("nx"),
        F.count("low").over(whole).alias("seen"))
    px = F.col("k") * F.lit(1.0 / steps)
    share = (F.col("j")["conf"] - px) / (F.col("j")["conf"] - F.col("nx")["conf"])

    def line(v: str, left: float) -> Column:
        j, nx = F.col("j")[v], F.col("nx")[v]
        inner = F.when(F.col("nx").isNull(), j).otherwise(j + (nx - j) * share)
        return F.when(F.col("seen") == 0, 0.0).when(F.col("j").isNull(), left).otherwise(inner)

    out = g.select("cls", "k", line("r", 0.0).alias("r"), line("p", 1.0).alias("p"))
    return out.withColumn("f1", 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r") + TINY))


def smooth(mean: DataFrame, value: str, steps: int = 999, share: float = 0.1) -> DataFrame:
    """Box filter over the confidence grid; the ends repeat their value."""
    n = steps + 1
    half = (round(n * share * 2) // 2 + 1) // 2
    everything = W.partitionBy().orderBy("k").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    near = W.partitionBy().orderBy("k").rowsBetween(-half, half)
    k, zero = F.col("k"), F.lit(0)
    total = (
        F.sum(value).over(near)
        + F.first(value).over(everything) * F.greatest(F.lit(half) - k, zero)
        + F.last(value).over(everything) * F.greatest(k + half - steps, zero)
    )
    return mean.withColumn("smooth", total / (2 * half + 1))


def evaluate(labels: DataFrame, dets: DataFrame, levels: Sequence[float] = LEVELS) -> DataFrame:
    """V6 + V8: per class labels, precision, recall and F1 at the best smoothed mean F1, AP50, AP, tp and fp."""
    points = curve_points(match(labels, dets, levels), labels, len(levels))
    ap = average_precision(points, labels, len(levels)).groupBy("cls").agg(
        F.max(F.when(F.col("level") == 0, F.col("ap"))).alias("ap50"), F.avg("ap").alias("ap"))
    curves = confidence_curves(points, labels)
    mean = curves.groupBy("k").agg(F.avg("f1").alias("f1"))
    peak = smooth(mean, "f1").orderBy(F.desc("smooth"), "k").limit(1).select("k").scalar()
    targets = labels.groupBy("cls").agg(F.count("*").alias("labels"))
    per = curves.filter(F.col("k") == peak).join(ap, "cls").join(targets, "cls")
    tp = F.bround(F.col("r") * F.col("labels"), 0)
    return per.select("cls", "labels", "p", "r", "f1", "ap50", "ap", tp.alias("tp"),
                      F.bround(tp / (F.col("p") + TINY) - tp, 0).alias("fp"))


def summary(per_class: DataFrame) -> DataFrame:
    """V8: mean precision, recall, mAP50 and mAP50-95 over the classes that have labels."""
    return per_class.agg(F.sum("labels").alias("labels"), F.avg("p").alias("mp"), F.avg("r").alias("mr"),
                         F.avg("ap50").alias("map50"), F.avg("ap").alias("map"))


def fill_classes(per_class: DataFrame, classes: DataFrame) -> DataFrame:
    """V8: AP for every known class; a class without labels takes the overall mean."""
    overall = per_class.agg(F.avg("ap")).scalar()
    return classes.join(per_class.select("cls", "ap"), "cls", "left").select("cls", F.coalesce("ap", overall).alias("ap"))


def fitness(df: DataFrame, parts: Sequence[str] = ("",)) -> DataFrame:
    """V9: weighted mAP; with several prefixes (box and mask) the sum of each."""
    terms = [F.col(f"{p}{c}") * w for p in parts for c, w in FITNESS.items()]
    return df.withColumn("fitness", sum(terms[1:], terms[0]))


def best_run(df: DataFrame, row: str) -> DataFrame:
    """H8: run with the highest fitness, the first one on ties."""
    return df.orderBy(F.desc("fitness"), row).limit(1)


def confusion(labels: DataFrame, dets: DataFrame, conf: float = CONFUSION_CONF, floor: float = CONFUSION_IOU) -> DataFrame:
    """V7: counts (predicted, actual, n); null stands for background.

    Detections above ``conf`` take their best label by IoU, then labels keep their best detection, whatever the
    class. Unmatched detections count only in images that have a match, as the source definition does.
    """
    kept = dets.filter(F.col("conf") > conf)
    best = best_labels(labels, kept, ["image_id"], floor, strict=True)
    rival, image = W.partitionBy("image_id", "label_id"), W.partitionBy("image_id")
    place = F.struct((-F.col("iou")).alias("i"), F.col("det_id").alias("d"))
    won = F.coalesce(F.col("label_id").isNotNull() & (F.min(place).over(rival)["d"] == F.col("det_id")), F.lit(False))
    judged = best.withColumn("_hit", won).withColumn("_any", F.max("_hit").over(image))
    nobody = F.lit(None)
    # A few rows for each pair of classes, written once: three counts need them.
    counts = materialise(judged.groupBy(F.col("cls").alias("predicted"), F.col("l_cls").alias("actual"), "_hit", "_any").agg(
        F.count("*").alias("n")), "confusion-counts")
    found = counts.filter("_hit").groupBy("predicted", "actual").agg(F.sum("n").alias("n"))
    lost = counts.filter("_any AND NOT _hit").groupBy("predicted").agg(F.sum("n").alias("n"))
    targets = labels.groupBy(F.col("cls").alias("actual")).agg(F.count("*").alias("n"))
    # Missed labels are the targets of a class less its hits, so no label has to be looked up again.
    missed = targets.unionByName(found.select("actual", (-F.col("n")).alias("n"))).groupBy("actual").agg(F.sum("n").alias("n"))
    kind = dict(dets.dtypes)["cls"]
    return (
        found.unionByName(lost.select("predicted", nobody.cast(kind).alias("actual"), "n"))
        .unionByName(missed.filter("n > 0").select(nobody.cast(kind).alias("predicted"), "actual", "n"))
    )


def normalise_columns(matrix: DataFrame) -> DataFrame:
    """V7: share of each predicted class within an actual class."""
    whole = W.partitionBy("actual")
    return matrix.withColumn("share", F.col("n") / (F.sum("n").over(whole) + 1e-9))


def score_predictions(preds: DataFrame, conf: float = NMS_CONF, multi_label: bool = False, classes: Sequence[int] | None = None) -> DataFrame:
    """V10, first half: class scores = objectness x class score, best class or every class above ``conf``.

    ``preds`` holds (image_id, pred_id, x, y, w, h, obj, scores).
    """
    ok = preds.filter(F.col("obj") > conf).withColumn("scores", F.transform("scores", lambda s: s * F.col("obj")))
    if multi_label:
        rows = ok.select("*", F.posexplode("scores").alias("cls", "conf"))
    else:
        top = F.array_max("scores")
        rows = ok.withColumns({"conf": top, "cls": (F.array_position("scores", top) - 1).cast("int")})
    x1, y1, x2, y2 = B.to_corners(*[F.col(c).cast("double") for c in ("x", "y", "w", "h")])
    out = rows.filter(F.col("conf") > conf).select(
        "image_id", "pred_id", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), "conf", "cls")
    return out.filter(F.col("cls").isin(list(classes))) if classes else out


def suppress(scored: DataFrame, iou: float = NMS_IOU, agnostic: bool = False, merge: bool = False,
             max_nms: int = MAX_NMS, max_det: int = MAX_DET) -> DataFrame:
    """V10 + H7: greedy suppression per image, then the best ``max_det`` rows of each image.

    The first ``max_nms`` rows of an image by score take part. Classes do not interact unless ``agnostic``. Distinct boxes of a
    group that overlap by more than ``iou`` are edges from the stronger to the weaker one, found through the grid in images of
    more than ``CROWD_ROWS`` boxes; ``suppressed`` settles them by rounds, so no task holds the pairs of such an image. Copies
    of a box go with the strongest of them, and boxes without an area overlap nothing. With ``merge`` every kept box becomes the score-weighted mean of the boxes it
    overlaps, itself included, and boxes that overlap no other go (images of 2 to 2999 boxes).
    """
    if iou < 0.01:
        raise ValueError("the grid needs an overlap of at least 0.01")
    by_score = W.partitionBy("image_id").orderBy(F.desc("conf"), "pred_id", "cls")
    group = ["image_id"] if agnostic else ["image_id", "cls"]
    real = (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
    ranked = scored.withColumn("_rn", F.row_number().over(by_score)).filter(F.col("_rn") <= max_nms)
    # The strongest copy of a box stands for all of them; what is needed of the others is noted before the rows are written.
    copies = W.partitionBy(*group, *BOX)
    ranked = ranked.withColumn("_first", F.coalesce(~real | (real & (F.min("_rn").over(copies) == F.col("_rn"))), F.lit(False)))
    if merge:
        ranked = ranked.withColumns({"_n": F.count("*").over(copies), "_weight": F.sum("conf").over(copies)})
    top = materialise(ranked, "suppress-rows")
    boxes = top.filter(real & F.col("_first")).drop("_first")

    def overlaps(rows: DataFrame, crowded: bool) -> DataFrame:
        left, right = [_named(rows, p, group) for p in ("l", "d")]
        pairs = _near(left, right, group, iou, crowded).filter(F.col("l__rn") < F.col("d__rn"))
        return pairs.filter(B.iou(B.corners("l_"), B.corners("d_")) > iou).select(
            "image_id", F.col("l__rn").alias("strong"), F.col("d__rn").alias("weak"))

    near = materialise(_by_crowding(overlaps, boxes.select(*group, *BOX, "_rn")), "suppress-edges")
    gone = suppressed(near).withColumnRenamed("weak", "_rn")
    kept = top.filter("_first AND image_id IS NOT NULL").drop("_first").join(gone, ["image_id", "_rn"], "left_anti")
    if merge:
        kept = _merged(kept, boxes, near, top.groupBy("image_id").agg(F.count("*").alias("_size")))
    best = kept.withColumn("_place", F.row_number().over(by_score)).filter(F.col("_place") <= max_det)
    return best.select(*scored.columns)


def suppressed(edges: DataFrame) -> DataFrame:
    """(image_id, weak) of what greedy suppression removes, from edges (image_id, strong, weak).

    A box that is the weaker one in no open edge stays, so its weaker neighbours go, and with them all their edges. As every
    open edge has such a box above it, each round settles some until none is open.
    """
    gone = []
    while True:
        weak = edges.select("image_id", F.col("weak").alias("strong")).distinct()
        lost = materialise(edges.join(weak, ["image_id", "strong"], "left_anti").select("image_id", "weak").distinct(), "suppress-gone")
        gone.append(lost)
        edges = edges.join(lost, ["image_id", "weak"], "left_anti").join(lost.withColumnRenamed("weak", "strong"), ["image_id", "strong"], "left_anti")
        edges = materialise(edges.select("image_id", "strong", "weak"), "suppress-edges")
        if edges.isEmpty():
            return reduce(DataFrame.unionByName, gone)


def _merged(kept: DataFrame, boxes: DataFrame, near: DataFrame, sizes: DataFrame) -> DataFrame:
    """Kept boxes replaced by weighted means of the rows they overlap; single ones removed."""
    both = near.select("image_id", F.col("strong").alias("_rn"), F.col("weak").alias("_other")).unionByName(
        near.select("image_id", F.col("weak").alias("_rn"), F.col("strong").alias("_other")))
    own = boxes.select("image_id", "_rn", F.col("_rn").alias("_other"))
    rows = boxes.select("image_id", F.col("_rn").alias("_other"), "_n", "_weight", *BOX)
    # Only boxes that stay need their neighbours.
    linked = both.unionByName(own).join(kept.select("image_id", "_rn"), ["image_id", "_rn"], "left_semi").join(rows, ["image_id", "_other"])
    means = linked.groupBy("image_id", "_rn").agg(
        F.sum("_n").alias("_linked"), *[(F.sum(F.col("_weight") * F.col(c)) / F.sum("_weight")).alias(f"_m_{c}") for c in BOX])
    out = kept.join(sizes, "image_id").join(means, ["image_id", "_rn"], "left")
    change = F.col("_size").between(2, 2999)
    return out.filter(~change | (F.col("_linked") > 1)).withColumns({c: F.when(change, F.col(f"_m_{c}")).otherwise(F.col(c)) for c in BOX})


def mask_iou(a: Column, b: Column) -> Column:
    """IoU of two flat 0/1 masks."""
    inter = F.aggregate(F.zip_with(a, b, lambda u, v: (u * v).cast("double")), F.lit(0.0), lambda s, v: s + v)
    return inter / (_mass(a) + _mass(b) - inter + B.EPS)


def _mass(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0.0), lambda s, v: s + v.cast("double"))


def _mask_comparer(keys: Sequence[str], floor: float, best: bool):
    """Pairs of each cell (keys, a, b), whose labels (side 0) come before its detections (side 1); with ``best`` only the best
    label of each detection."""

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, held, names, marks, mass = None, [], None, None, None
        for frame in frames:
            for (*at, side), part in frame.groupby([*keys, "a", "b", "side"], sort=True):
                if at != cell:
                    cell, held, names = at, [], None
                if side == 0:
                    held.append(part[["l_label_id", "_mask"]])
                    continue
                if names is None:
                    if not held:
                        continue
                    own = pd.concat(held).sort_values("l_label_id", kind="stable")
                    held, names, marks = [], own["l_label_id"].to_numpy(), matrix(own["_mask"])
                    mass = marks.sum(axis=1)
                for i in range(0, len(part), MASK_STEP):
                    some = part.iloc[i : i + MASK_STEP]
                    ids, other = some["d_det_id"].to_numpy(), matrix(some["_mask"])
                    size, rows = other.sum(axis=1), np.arange(len(ids))
                    top, who = np.full(len(ids), -np.inf), np.zeros(len(ids), np.int64)
                    for j in range(0, len(names), MASK_STEP):
                        inter = other @ marks[j : j + MASK_STEP].T
                        iou = inter / (mass[None, j : j + MASK_STEP] + size[:, None] - inter + B.EPS)
                        iou[~((inter > 0) & (iou >= floor))] = -np.inf
                        if best:  # labels ascend, so the first of equal ones is the smallest
                            first = iou.argmax(axis=1)
                            higher = iou[rows, first] > top
                            top[higher], who[higher] = iou[rows, first][higher], first[higher] + j
                            continue
                        d, n = np.nonzero(iou > -np.inf)
                        yield pd.DataFrame({**dict(zip(keys, at)), "l_label_id": names[n + j], "d_det_id": ids[d], "iou": iou[d, n]})
                    if best:
                        d = np.flatnonzero(top > -np.inf)
                        yield pd.DataFrame({**dict(zip(keys, at)), "l_label_id": names[who[d]], "d_det_id": ids[d], "iou": top[d]})

    return compare


def mask_pairs(labels: DataFrame, dets: DataFrame, keys: Sequence[str], floor: float = 0.5, best: bool = False) -> DataFrame:
    """Label-detection pairs of a group with mask IoU of at least ``floor``, which have a common pixel.

    Every pair of a group is compared, as blocks: labels and detections of a group are dealt to slices of ``MASK_ROWS`` rows at
    most (fewer if masks are large), every slice of labels meets every slice of detections in one task, and common pixels are
    counted by a product of matrices. A task holds one slice of labels whatever the size of a group; only pairs that reach
    ``floor`` leave it. With ``best`` a slice gives only the best label of each detection (the smallest id on ties), from which
    the caller takes the best of all slices. Masks with a null pixel and masks of different length match nothing.
    """
    keys = list(keys)

    def ready(df: DataFrame, p: str) -> DataFrame:
        named = df.withColumnsRenamed({c: f"{p}_{c}" for c in df.columns if c not in keys}).withColumnRenamed(f"{p}_mask", "_mask")
        whole = ~F.exists("_mask", lambda v: v.isNull()) & F.exists("_mask", lambda v: v.cast("double") > 0)
        return named.filter(whole).withColumn("_wide", F.size("_mask"))

    left, right = ready(labels, "l").filter("l_label_id IS NOT NULL"), ready(dets, "d").filter("d_det_id IS NOT NULL")
    cell = [*keys, "_wide"]
    rows = F.greatest(F.lit(1), F.least(F.lit(MASK_ROWS), F.floor(F.lit(MASK_BYTES) / (F.col("_wide") * 8))))
    slices = lambda df, n: df.groupBy(cell).agg(F.ceil(F.count("*") / F.first(rows)).cast("int").alias(n))
    sizes = slices(left, "_as").join(slices(right, "_bs"), cell)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    kinds = {"l_label_id": dict(left.dtypes)["l_label_id"], "d_det_id": dict(right.dtypes)["d_det_id"]}
    nothing = {c: F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()}
    pixels = F.transform("_mask", lambda v: v.cast("double")) if dict(left.dtypes)["_mask"] != dict(right.dtypes)["_mask"] else F.col("_mask")
    dealt = left.join(sizes, cell).select(*cell, own("l_label_id", "_as").alias("a"), every("_bs").alias("b"), F.lit(0).alias("side"),
                                          "l_label_id", nothing["d_det_id"], pixels.alias("_mask")).unionByName(
        right.join(sizes, cell).select(*cell, every("_as").alias("a"), own("d_det_id", "_bs").alias("b"), F.lit(1).alias("side"),
                                       nothing["l_label_id"], "d_det_id", pixels.alias("_mask")))
    dealt = dealt.repartition(*cell, "a", "b").sortWithinPartitions(*cell, "a", "b", "side")
    schema = ", ".join([f"`{k}` {dict(left.dtypes)[k]}" for k in keys] + [f"{c} {kind}" for c, kind in kinds.items()] + ["iou double"])
    compare = _mask_comparer(cell, floor, best)
    pairs = dealt.mapInPandas(lambda frames: (x.drop(columns="_wide") for x in compare(frames)), schema)
    for side, ident in ((left, "l_label_id"), (right, "d_det_id")):
        rest = side.drop("_mask", "_wide")
        if len(rest.columns) > len(keys) + 1:
            pairs = pairs.join(rest, [*keys, ident])
    return pairs.select(*[c for c in pairs.columns if c != "iou"], "iou")


def match_masks(labels: DataFrame, dets: DataFrame, levels: Sequence[float] = LEVELS) -> DataFrame:
    """As ``match``, with mask IoU; feeds the same average-precision steps."""
    keys = ["image_id", "cls"]

    def once(df: DataFrame, id_col: str, extra: list[str]) -> DataFrame:
        order = F.struct(-F.col("conf"), F.col(id_col)) if extra else F.col(id_col)
        return df.groupBy(*keys, "mask").agg(F.min_by(F.struct(id_col, *extra), order).alias("k")).select(*keys, "mask", "k.*")

    pairs = mask_pairs(once(labels, "label_id", []), once(dets, "det_id", ["conf"]).drop("conf"), keys, min(levels), best=True)
    best = pairs.groupBy(*keys, "d_det_id").agg(
        F.max_by(F.struct(F.col("l_label_id").alias("label_id"), "iou"), F.struct(F.col("iou"), -F.col("l_label_id"))).alias("b")
    ).select("image_id", F.col("d_det_id").alias("det_id"), "b.*")
    rest = [c for c in dets.columns if c != "mask"]
    full = dets.select(*rest).join(best, ["image_id", "det_id"], "left")
    return _first_per_label(full, keys, levels).select(*rest, *[f"tp{i}" for i in range(len(levels))])


def top_classes(df: DataFrame, scores: str = "scores", n: int = 5) -> DataFrame:
    """Class indexes of the n highest scores, best first (smaller index on ties)."""
    ranked = F.array_sort(F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.cast("int").alias("i"))))
    return df.withColumn("top", F.transform(F.slice(ranked, 1, n), lambda r: r["i"]))


def top_accuracy(df: DataFrame, target: str = "target", by_class: bool = True) -> DataFrame:
    """Share of rows whose target is first, or among the first five; per class and overall (null class)."""
    hit = df.withColumns({
        "_t1": (F.element_at("top", 1) == F.col(target)).cast("int"),
        "_t5": F.array_contains("top", F.col(target)).cast("int"),
    })
    grouped = hit.rollup(target) if by_class else hit.groupBy()
    return grouped.agg(F.count("*").alias("images"), F.avg("_t1").alias("top1"), F.avg("_t5").alias("top5"))
