"""Box, matching, evaluation and dataset queries. Every lineitem row is a label box and a shifted detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from gearwatch.catalog.base import query, r6, table
from gearwatch.functions import boxes as B
from gearwatch.operators import dataset, detection
from gearwatch.sources import annotations as A

NAMES = {0: "crack", 1: "dent", 2: "rust"}
ANCHORS = [(10, 13), (16, 30), (33, 23), (30, 61), (62, 45), (59, 119), (116, 90), (156, 198), (373, 326)]
FRAME = 200.0


def base_boxes(spark, d):
    cls = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    li = table(spark, d, "lineitem")
    x1, y1 = (F.col("l_partkey") % 100).cast("double"), (F.col("l_suppkey") % 100).cast("double")
    return li.select(
        F.col("l_orderkey").alias("image_id"),
        # Line, part and supplier can repeat inside an order, so the price in cents completes the id.
        (F.col("l_linenumber").cast("long") * 1_000_000_000_000_000_000 + F.col("l_partkey") * 1_000_000_000_000
         + F.col("l_suppkey") * 100_000_000 + F.round(F.col("l_extendedprice") * 100).cast("long")).alias("box_id"),
        cls.alias("cls"), x1.alias("x1"), y1.alias("y1"), (x1 + F.col("l_quantity")).alias("x2"),
        (y1 + F.col("l_linenumber") * 10.0).alias("y2"), (F.col("l_discount") * 100 - 5).alias("shift"),
        ((F.col("l_partkey") % 97) / 97.0).alias("conf"),
    )


def labels(spark, d):
    return base_boxes(spark, d).select("image_id", F.col("box_id").alias("label_id"), "cls", *detection.BOX)


def detections(spark, d):
    b = base_boxes(spark, d)
    return b.select("image_id", F.col("box_id").alias("det_id"), "cls", (F.col("x1") + F.col("shift")).alias("x1"), "y1",
                    (F.col("x2") + F.col("shift")).alias("x2"), "y2", "conf")


BOXES = """bx AS (SELECT l_orderkey AS image_id, CAST(l_linenumber AS BIGINT) * 1000000000000000000 + l_partkey * 1000000000000 + l_suppkey * 100000000
  + CAST(round(l_extendedprice * 100) AS BIGINT) AS box_id,
 CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS cls, CAST(l_partkey % 100 AS DOUBLE) AS x1, CAST(l_suppkey % 100 AS DOUBLE) AS y1,
 CAST(l_partkey % 100 AS DOUBLE) + l_quantity AS x2, CAST(l_suppkey % 100 AS DOUBLE) + l_linenumber * 10.0::DOUBLE AS y2,
 l_discount * 100 - 5 AS shift, (l_partkey % 97) / 97.0::DOUBLE AS conf FROM lineitem),
 lb AS (SELECT image_id, box_id AS label_id, cls, x1, y1, x2, y2 FROM bx),
 dt AS (SELECT image_id, box_id AS det_id, cls, x1 + shift AS x1, y1, x2 + shift AS x2, y2, conf FROM bx)"""
_IOU = """(greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0))"""


def _iou(a: str, b: str) -> str:
    i = _IOU.format(a=a, b=b)
    return f"({i} / (({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - {i} + 1e-7))"


@query("v1_box_conversions", f"""WITH {BOXES} SELECT image_id, label_id, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, x2 - x1 AS w, y2 - y1 AS h,
 round(((least(x1, 100.0) + least(x2, 100.0)) / 2) / 100, 6) AS nx, round((least(y2, 100.0) - least(y1, 100.0)) / 100, 6) AS nh, round(x1 / 200 * 640 + 4, 6) AS dx FROM lb""")
def box_conversions(spark, d):
    lb = labels(spark, d)
    c = B.corners()
    cx, cy, w, h = B.to_centre(*c)
    n = B.normalise(*c, F.lit(100.0), F.lit(100.0), do_clip=True)
    m = B.normalise(*c, F.lit(200.0), F.lit(200.0))
    back = B.denormalise(*m, 640, 640, 4, 4)
    return r6(lb.select("image_id", "label_id", cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h"), n[0].alias("nx"),
                        n[3].alias("nh"), back[0].alias("dx")))


@query("v2_rescale", f"""WITH {BOXES}, g AS (SELECT *, least(640 / 480.0::DOUBLE, 640 / 720.0::DOUBLE) AS g FROM lb)
 SELECT image_id, label_id, """ + ", ".join(
    f"round(least(greatest(({c} - (640 - {s} * g) / 2) / g, 0), {s}), 6) AS {c}" for c, s in (("x1", 720), ("y1", 480), ("x2", 720), ("y2", 480))) + " FROM g")
def rescale(spark, d):
    out = B.rescale(*B.corners(), *[F.lit(float(v)) for v in (640, 640, 720, 480)])
    return r6(labels(spark, d).select("image_id", "label_id", *[c.alias(n) for n, c in zip(detection.BOX, out)]))


def polygons(spark, d):
    li = table(spark, d, "lineitem")
    pts = F.array(B.point(F.col("l_partkey") % 100, F.col("l_suppkey") % 100), B.point(F.col("l_quantity"), F.col("l_linenumber") * 10),
                  B.point(F.col("l_discount") * 1000, F.col("l_tax") * 1000))
    return li.select(F.col("l_orderkey").alias("image_id"), "l_linenumber", "l_partkey", "l_suppkey", pts.alias("poly"))


@query("v3_polygon_boxes", """WITH p AS (SELECT l_orderkey AS image_id, l_linenumber, l_partkey, l_suppkey, [CAST(l_partkey % 100 AS DOUBLE), l_quantity, l_discount * 1000] AS xs,
 [CAST(l_suppkey % 100 AS DOUBLE), CAST(l_linenumber * 10 AS DOUBLE), l_tax * 1000] AS ys FROM lineitem),
 q AS (SELECT *, [i FOR i IN [1, 2, 3] IF xs[i] >= 0 AND ys[i] >= 0 AND xs[i] <= 60 AND ys[i] <= 60] AS k FROM p)
 SELECT image_id, l_linenumber, l_partkey, l_suppkey, round(list_min(xs), 6) AS x1, round(list_max(ys), 6) AS y2,
 CASE WHEN len([i FOR i IN k IF xs[i] <> 0]) > 0 THEN round(list_max([xs[i] FOR i IN k]), 6) ELSE 0.0::DOUBLE END AS inside_x2 FROM q""")
def polygon_boxes(spark, d):
    p = F.col("poly")
    whole, inside = B.polygon_box(p), B.polygon_box_inside(p, 60, 60)
    return r6(polygons(spark, d).select("image_id", "l_linenumber", "l_partkey", "l_suppkey", whole[0].alias("x1"), whole[3].alias("y2"),
                                        inside[2].alias("inside_x2")))


@query("v3_resample", """WITH p AS (SELECT l_orderkey AS image_id, l_linenumber, l_partkey, l_suppkey, [CAST(l_partkey % 100 AS DOUBLE), l_quantity, l_discount * 1000, CAST(l_partkey % 100 AS DOUBLE)] AS xs FROM lineitem),
 s AS (SELECT *, unnest(range(7)) AS i FROM p)
 SELECT image_id, l_linenumber, l_partkey, l_suppkey, CAST(i AS INT) AS i, round(xs[CAST(floor(i * 3 / 6.0) AS INT) + 1] + (coalesce(xs[CAST(floor(i * 3 / 6.0) AS INT) + 2], 0) - xs[CAST(floor(i * 3 / 6.0) AS INT) + 1])
  * (i * 3 / 6.0::DOUBLE - floor(i * 3 / 6.0::DOUBLE)), 6) AS x FROM s""")
def resample(spark, d):
    out = polygons(spark, d).select("image_id", "l_linenumber", "l_partkey", "l_suppkey", F.posexplode(B.resample(F.col("poly"), 7)).alias("i", "p"))
    return r6(out.select("image_id", "l_linenumber", "l_partkey", "l_suppkey", "i", F.col("p.x").alias("x")))


def _pair(spark, d):
    """Each label with the detection of the same row."""
    b = base_boxes(spark, d)
    return b.select("image_id", "box_id", *[F.col(c).alias(f"l_{c}") for c in detection.BOX],
                    (F.col("x1") + F.col("shift")).alias("d_x1"), F.col("y1").alias("d_y1"),
                    (F.col("x2") + F.col("shift")).alias("d_x2"), (F.col("y2") + 3).alias("d_y2"))


@query("v4_iou_family", f"""WITH {BOXES}, p AS (SELECT image_id, box_id, x1 AS ax1, y1 AS ay1, x2 AS ax2, y2 AS ay2, x1 + shift AS bx1, y1 AS by1, x2 + shift AS bx2, y2 + 3 AS by2 FROM bx),
 q AS (SELECT *, greatest(least(ax2, bx2) - greatest(ax1, bx1), 0) * greatest(least(ay2, by2) - greatest(ay1, by1), 0) AS i,
  (ax2 - ax1) * (ay2 - ay1) AS a, (bx2 - bx1) * (by2 - by1) AS b, greatest(ax2, bx2) - least(ax1, bx1) AS cw, greatest(ay2, by2) - least(ay1, by1) AS ch,
  ((bx1 + bx2 - ax1 - ax2) ** 2 + (by1 + by2 - ay1 - ay2) ** 2) / 4 AS rho FROM p),
 r AS (SELECT *, i / (a + b - i + 1e-7) AS iou, a + b - i + 1e-7 AS u, cw * ch + 1e-7 AS hull, rho / (cw ** 2 + ch ** 2 + 1e-7) AS dist,
  4 / pi() ** 2 * (atan((bx2 - bx1) / (by2 - by1)) - atan((ax2 - ax1) / (ay2 - ay1))) ** 2 AS v FROM q)
 SELECT image_id, box_id, round(iou, 6) AS iou, round(i / (b + 1e-7), 6) AS ioa, round(iou - (hull - u) / hull, 6) AS giou, round(iou - dist, 6) AS diou,
 round(iou - (dist + v * (v / (v - iou + 1 + 1e-7))), 6) AS ciou, round(least(ax2 - ax1, bx2 - bx1) * least(ay2 - ay1, by2 - by1) / (a + b - least(ax2 - ax1, bx2 - bx1) * least(ay2 - ay1, by2 - by1) + 1e-7), 6) AS wh_iou FROM r""")
def iou_family(spark, d):
    a, b = B.corners("l_"), B.corners("d_")
    size = [a[2] - a[0], a[3] - a[1], b[2] - b[0], b[3] - b[1]]
    return r6(_pair(spark, d).select("image_id", "box_id", B.iou(a, b).alias("iou"), B.ioa(a, b).alias("ioa"), B.giou(a, b).alias("giou"),
                                     B.diou(a, b).alias("diou"), B.ciou(a, b).alias("ciou"), B.wh_iou(*size).alias("wh_iou")))


_MATCH = f"""pr AS (SELECT d.image_id, d.cls, d.det_id, d.conf, l.label_id, {_iou('l', 'd')} AS iou FROM lb l JOIN dt d ON l.image_id = d.image_id AND l.cls = d.cls),
 best AS (SELECT * FROM pr WHERE iou >= 0.5 QUALIFY row_number() OVER (PARTITION BY image_id, det_id ORDER BY iou DESC, label_id) = 1),
 lv AS (SELECT unnest(range(10)) AS i, unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]::DOUBLE[]) AS t),
 win AS (SELECT image_id, det_id, i FROM best, lv WHERE iou >= t QUALIFY row_number() OVER (PARTITION BY image_id, label_id, i ORDER BY conf DESC, det_id) = 1),
 mt AS (SELECT d.image_id, d.det_id, d.cls, d.conf, """ + ", ".join(f"CAST(coalesce(max(CASE WHEN i = {i} THEN 1 END), 0) AS INT) AS tp{i}" for i in range(10)) + """
  FROM dt d LEFT JOIN win w USING (image_id, det_id) GROUP BY ALL)"""


@query("v5_c8_match", f"WITH {BOXES}, {_MATCH} SELECT * FROM mt")
def match(spark, d):
    return detection.match(labels(spark, d), detections(spark, d)).select("image_id", "det_id", "cls", "conf", *[f"tp{i}" for i in range(10)])


_CURVE = """ag AS (SELECT cls, conf, count(*) AS n, """ + ", ".join(f"sum(tp{i}) AS s{i}" for i in range(10)) + """ FROM mt GROUP BY cls, conf),
 nl AS (SELECT cls, count(*) AS nl FROM lb GROUP BY cls),
 pt AS (SELECT ag.cls, conf, row_number() OVER w AS ix, nl, """ + ", ".join(
    f"sum(s{i}) OVER w / (nl + 1e-16) AS rc{i}, sum(s{i}) OVER w / sum(n) OVER w AS pr{i}" for i in range(10)) + """ FROM ag JOIN nl USING (cls) WINDOW w AS (PARTITION BY ag.cls ORDER BY conf DESC))"""
_LONG = " UNION ALL ".join(f"SELECT cls, {i} AS level, ix, rc{i} AS rc, pr{i} AS pr FROM pt" for i in range(10))
_AP = f"""lg AS ({_LONG}), mx AS (SELECT cls, level, max(ix) + 1 AS e FROM lg GROUP BY 1, 2),
 se AS (SELECT * FROM lg UNION ALL SELECT cls, level, 0, 0.0, 1.0 FROM mx UNION ALL SELECT cls, level, e, 1.0, 0.0 FROM mx),
 en AS (SELECT *, max(pr) OVER (PARTITION BY cls, level ORDER BY ix DESC) AS env FROM se),
 aj AS (SELECT cls, level, k, max(ix) AS j FROM en, range(101) g(k) WHERE rc <= k * 0.01::DOUBLE GROUP BY 1, 2, 3),
 iy AS (SELECT aj.cls, aj.level, k, CASE WHEN b.ix IS NULL THEN a.env ELSE a.env + (b.env - a.env) * (k * 0.01::DOUBLE - a.rc) / (b.rc - a.rc) END AS y
   FROM aj JOIN en a ON a.cls = aj.cls AND a.level = aj.level AND a.ix = aj.j LEFT JOIN en b ON b.cls = aj.cls AND b.level = aj.level AND b.ix = aj.j + 1),
 ap AS (SELECT cls, level, sum(CASE WHEN k IN (0, 100) THEN y / 2 ELSE y END) * 0.01 AS ap FROM iy GROUP BY 1, 2)"""


@query("e12_curve_points", f"WITH {BOXES}, {_MATCH}, {_CURVE} SELECT cls, round(conf, 6) AS conf, nl AS n_labels, " + ", ".join(
    f"round(rc{i}, 6) AS rc{i}, round(pr{i}, 6) AS pr{i}" for i in range(10)) + " FROM pt")
def curve_points(spark, d):
    lb = labels(spark, d)
    return r6(detection.curve_points(detection.match(lb, detections(spark, d)), lb, 10))


@query("v6_e13_average_precision", f"WITH {BOXES}, {_MATCH}, {_CURVE}, {_AP} SELECT cls, CAST(level AS INT) AS level, round(ap, 6) AS ap FROM ap")
def average_precision(spark, d):
    lb = labels(spark, d)
    points = detection.curve_points(detection.match(lb, detections(spark, d)), lb, 10)
    return r6(detection.average_precision(points, lb, 10))


_EVAL = """gr AS (SELECT cls, k, k * (1.0::DOUBLE / 999) AS px FROM nl, range(1000) g(k)),
 jj AS (SELECT gr.cls, k, px, (SELECT min(conf) FROM pt WHERE pt.cls = gr.cls AND conf >= px) AS cj, (SELECT max(conf) FROM pt WHERE pt.cls = gr.cls AND conf < px) AS cn FROM gr),
 cu AS (SELECT jj.cls, k, CASE WHEN cj IS NULL THEN 0.0 WHEN cn IS NULL THEN a.rc0 ELSE a.rc0 + (b.rc0 - a.rc0) * (cj - px) / (cj - cn) END AS r,
   CASE WHEN cj IS NULL THEN 1.0 WHEN cn IS NULL THEN a.pr0 ELSE a.pr0 + (b.pr0 - a.pr0) * (cj - px) / (cj - cn) END AS p
   FROM jj LEFT JOIN pt a ON a.cls = jj.cls AND a.conf = cj LEFT JOIN pt b ON b.cls = jj.cls AND b.conf = cn),
 fm AS (SELECT k, avg(2 * p * r / (p + r + 1e-16)) AS f FROM cu GROUP BY k),
 sm AS (SELECT a.k, (SELECT sum(f.f) FROM fm f, range(-50, 51) o(o) WHERE f.k = least(greatest(a.k + o, 0), 999)) / 101 AS s FROM fm a),
 pk AS (SELECT k FROM sm ORDER BY round(s, 12) DESC, k LIMIT 1),
 ev AS (SELECT cu.cls, nl AS labels, p, r, 2 * p * r / (p + r + 1e-16) AS f1, (SELECT ap FROM ap WHERE ap.cls = cu.cls AND level = 0) AS ap50,
   (SELECT avg(ap) FROM ap WHERE ap.cls = cu.cls) AS ap, round_even(r * nl, 0) AS tp, round_even(round_even(r * nl, 0) / (p + 1e-16) - round_even(r * nl, 0), 0) AS fp
   FROM cu JOIN nl USING (cls) WHERE k = (SELECT k FROM pk))"""


@query("v6_v8_e14_evaluate", f"WITH {BOXES}, {_MATCH}, {_CURVE}, {_AP}, {_EVAL} SELECT cls, labels, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in ("p", "r", "f1", "ap50", "ap", "tp", "fp")) + " FROM ev")
def evaluate(spark, d):
    return r6(detection.evaluate(labels(spark, d), detections(spark, d)))


@query("v8_v9_summary", f"WITH {BOXES}, {_MATCH}, {_CURVE}, {_AP}, {_EVAL} SELECT CAST(sum(labels) AS BIGINT) AS labels, round(avg(p), 6) AS mp, round(avg(r), 6) AS mr, "
       "round(avg(ap50), 6) AS map50, round(avg(ap), 6) AS map, round(0.1 * avg(ap50) + 0.9 * avg(ap), 6) AS fitness FROM ev")
def summary(spark, d):
    return r6(detection.fitness(detection.summary(detection.evaluate(labels(spark, d), detections(spark, d)))))


@query("v9_h8_best_run", """WITH r AS (SELECT p_size AS run, avg(p_retailprice) / 2000 AS map50, min(p_retailprice) / 2000 AS map FROM part GROUP BY p_size)
 SELECT run, round(map50, 6) AS map50, round(map, 6) AS map, round(0.1 * map50 + 0.9 * map, 6) AS fitness FROM r ORDER BY 0.1 * map50 + 0.9 * map DESC, run LIMIT 1""")
def best_run(spark, d):
    runs = table(spark, d, "part").groupBy(F.col("p_size").alias("run")).agg(
        (F.avg("p_retailprice") / 2000).alias("map50"), (F.min("p_retailprice") / 2000).alias("map"))
    return r6(detection.best_run(detection.fitness(runs), "run"))


_CONFUSION = f"""kd AS (SELECT * FROM dt WHERE conf > 0.25),
 pr AS (SELECT d.image_id, d.det_id, d.cls AS predicted, l.label_id, l.cls AS actual, {_iou('l', 'd')} AS iou FROM lb l JOIN kd d ON l.image_id = d.image_id),
 b1 AS (SELECT * FROM pr WHERE iou > 0.45 QUALIFY row_number() OVER (PARTITION BY image_id, det_id ORDER BY iou DESC, label_id) = 1),
 b2 AS (SELECT * FROM b1 QUALIFY row_number() OVER (PARTITION BY image_id, label_id ORDER BY iou DESC, det_id) = 1),
 al AS (SELECT predicted, actual FROM b2
   UNION ALL SELECT NULL, cls FROM lb WHERE (image_id, label_id) NOT IN (SELECT (image_id, label_id) FROM b2)
   UNION ALL SELECT cls, NULL FROM kd WHERE image_id IN (SELECT image_id FROM b2) AND (image_id, det_id) NOT IN (SELECT (image_id, det_id) FROM b2)),
 mx AS (SELECT predicted, actual, count(*) AS n FROM al GROUP BY 1, 2)
 SELECT predicted, actual, n, round(n / (sum(n) OVER (PARTITION BY actual) + 1e-9), 6) AS share FROM mx"""


@query("v7_c9_confusion", f"WITH {BOXES}, {_CONFUSION}")
def confusion(spark, d):
    return r6(detection.normalise_columns(detection.confusion(labels(spark, d), detections(spark, d))))


_MINIMA = ", ".join(f"min({c}) AS {c}" for c in ("cls", "x1", "y1", "x2", "y2", "shift", "conf"))
CROWDED = (BOXES.replace("l_orderkey AS image_id", "l_suppkey AS image_id").replace(
    """CAST(l_linenumber AS BIGINT) * 1000000000000000000 + l_partkey * 1000000000000 + l_suppkey * 100000000
  + CAST(round(l_extendedprice * 100) AS BIGINT) AS box_id""", "l_orderkey * 10 + l_linenumber AS box_id")
    .replace("bx AS (SELECT", "raw AS (SELECT", 1).replace("lb AS (", f"bx AS (SELECT image_id, box_id, {_MINIMA} FROM raw GROUP BY ALL), lb AS (", 1))


def crowded_boxes(spark, d):
    """All boxes of a supplier as one image: hundreds at the smallest scale. Lines that share an order and number are one box."""
    li = table(spark, d, "lineitem").select("*", F.col("l_suppkey").alias("image_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("_id"))
    cls = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    x1, y1 = (F.col("l_partkey") % 100).cast("double"), (F.col("l_suppkey") % 100).cast("double")
    box = {"cls": cls, "x1": x1, "y1": y1, "x2": x1 + F.col("l_quantity"), "y2": y1 + F.col("l_linenumber") * 10.0,
           "shift": F.col("l_discount") * 100 - 5, "conf": (F.col("l_partkey") % 97) / 97.0}
    return li.groupBy("image_id", F.col("_id").alias("box_id")).agg(*[F.min(c).alias(n) for n, c in box.items()])


@query("v7_crowded_confusion", f"WITH {CROWDED}, {_CONFUSION}")
def crowded_confusion(spark, d):
    b = crowded_boxes(spark, d)
    lb = b.select("image_id", F.col("box_id").alias("label_id"), "cls", *detection.BOX)
    dt = b.select("image_id", F.col("box_id").alias("det_id"), "cls", (F.col("x1") + F.col("shift")).alias("x1"), "y1",
                  (F.col("x2") + F.col("shift")).alias("x2"), "y2", "conf")
    return r6(detection.normalise_columns(detection.confusion(lb, dt)))


def predictions(spark, d):
    """Raw model output: one box per lineitem row with objectness and three class scores."""
    s = [((F.col("l_partkey") * k) % 89) / 89.0 for k in (1, 3, 7)]
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("image_id"),
        (F.col("l_linenumber") * 1_000_000_000_000 + F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")).alias("pred_id"),
        (F.col("l_partkey") % 100 + F.col("l_quantity") / 2).alias("x"), (F.col("l_suppkey") % 100 + F.col("l_linenumber") * 5.0).alias("y"),
        F.col("l_quantity").alias("w"), (F.col("l_linenumber") * 10.0).alias("h"), ((F.col("l_suppkey") % 10 + 1) / 10.0).alias("obj"), F.array(*s).alias("scores"))


@query("v10_score_predictions", """WITH p AS (SELECT l_orderkey AS image_id, CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 1000000 + l_suppkey AS pred_id,
 (l_suppkey % 10 + 1) / 10.0::DOUBLE AS obj, [((l_partkey * 1) % 89) / 89.0::DOUBLE, ((l_partkey * 3) % 89) / 89.0::DOUBLE, ((l_partkey * 7) % 89) / 89.0::DOUBLE] AS s FROM lineitem),
 q AS (SELECT image_id, pred_id, obj, unnest(s) * obj AS conf, unnest([0, 1, 2]) AS cls FROM p WHERE obj > 0.25)
 SELECT image_id, pred_id, CAST(cls AS INT) AS cls, round(conf, 6) AS conf FROM q WHERE conf > 0.25""")
def scored_predictions(spark, d):
    return r6(detection.score_predictions(predictions(spark, d), multi_label=True).select("image_id", "pred_id", "cls", "conf"))


_CORNERS = "x - w / 2 AS x1, y - h / 2 AS y1, x + w / 2 AS x2, y + h / 2 AS y2"
_PREDICTIONS = f"""p AS (SELECT l_orderkey AS image_id, CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 1000000 + l_suppkey AS pred_id,
 l_partkey % 100 + l_quantity / 2 AS x, l_suppkey % 100 + l_linenumber * 5.0::DOUBLE AS y, CAST(l_quantity AS DOUBLE) AS w, l_linenumber * 10.0::DOUBLE AS h,
 (l_suppkey % 10 + 1) / 10.0::DOUBLE AS obj, [((l_partkey * 1) % 89) / 89.0::DOUBLE, ((l_partkey * 3) % 89) / 89.0::DOUBLE, ((l_partkey * 7) % 89) / 89.0::DOUBLE] AS s FROM lineitem),
 every AS (SELECT image_id, pred_id, {_CORNERS}, unnest(s) * obj AS conf, unnest([0, 1, 2]) AS cls FROM p WHERE obj > 0.25)"""


def _greedy(group: str, rows: str) -> str:
    """Rows in order of score, one after the other: a row stays if no row that stays overlaps it."""
    box = "{'x1': n.x1, 'y1': n.y1, 'x2': n.x2, 'y2': n.y2}"
    free = f"len([e FOR e IN r.kept IF {_iou('e', 'n')} > 0.45]) = 0"
    keys = " AND ".join(f"n.{g} = r.{g}" for g in group.split(", "))
    return f"""n AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY conf DESC, pred_id, cls) AS k FROM {rows}),
 r AS (SELECT {", ".join("n." + g for g in group.split(", "))}, n.k, n.pred_id AS id, n.cls AS c, [{box}] AS kept, true AS stays FROM n WHERE k = 1
  UNION ALL SELECT {", ".join("n." + g for g in group.split(", "))}, n.k, n.pred_id, n.cls, CASE WHEN {free} THEN list_append(r.kept, {box}) ELSE r.kept END, {free} FROM r JOIN n ON {keys} AND n.k = r.k + 1)"""


@query("v10_h7_suppress", f"""WITH RECURSIVE {_PREDICTIONS}, q AS (SELECT * FROM every WHERE conf > 0.25), {_greedy("image_id, cls", "q")}
 SELECT n.image_id, n.pred_id, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2, round(conf, 6) AS conf, CAST(n.cls AS INT) AS cls FROM n JOIN r USING (image_id, cls, k) WHERE stays""")
def suppress(spark, d):
    return r6(detection.suppress(detection.score_predictions(predictions(spark, d), multi_label=True)))


@query("v10_merge_suppress", f"""WITH RECURSIVE {_PREDICTIONS}, q AS (SELECT image_id, pred_id, x1, y1, x2, y2, conf, cls FROM every WHERE conf > 0.25 QUALIFY row_number() OVER (PARTITION BY image_id, pred_id, x1, y1, x2, y2 ORDER BY conf DESC, cls) = 1),
 {_greedy("image_id", "q")}, b AS (SELECT n.* FROM n JOIN r USING (image_id, k) WHERE stays), z AS (SELECT image_id, count(*) AS size FROM q GROUP BY 1),
 m AS (SELECT b.image_id, b.pred_id, b.cls, b.conf, b.k, count(*) AS linked, """ + ", ".join(f"sum(n.conf * n.{c}) / sum(n.conf) AS {c}" for c in detection.BOX) + f""" FROM b JOIN n ON n.image_id = b.image_id AND {_iou('b', 'n')} > 0.45 GROUP BY ALL)
 SELECT b.image_id, b.pred_id, """ + ", ".join(f"round(CASE WHEN size >= 2 THEN m.{c} ELSE b.{c} END, 6) AS {c}" for c in detection.BOX) + """, round(b.conf, 6) AS conf, CAST(b.cls AS INT) AS cls
 FROM b JOIN z USING (image_id) LEFT JOIN m USING (image_id, k) WHERE size < 2 OR linked > 1""")
def merge_suppress(spark, d):
    return r6(detection.suppress(detection.score_predictions(predictions(spark, d)), merge=True, agnostic=True))


def masks(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("label").cast("long").alias("image_id"), "vec_id", F.lit(0).alias("cls"),
                    F.transform("embedding", lambda v: (v > 0).cast("tinyint")).alias("mask"))


_MASKS = "mk AS (SELECT vec_id, label, [CASE WHEN v > 0 THEN 1 ELSE 0 END FOR v IN embedding] AS m FROM embeddings)"


@query("v11_mask_iou_aligned", f"""WITH {_MASKS} SELECT a.vec_id, round(list_dot_product(a.m::DOUBLE[], b.m::DOUBLE[]) / (list_sum(a.m) + list_sum(b.m) - list_dot_product(a.m::DOUBLE[], b.m::DOUBLE[]) + 1e-7), 6) AS iou
 FROM mk a JOIN mk b ON b.vec_id = a.vec_id + 1""")
def mask_iou_aligned(spark, d):
    m = masks(spark, d)
    nxt = m.select((F.col("vec_id") - 1).alias("vec_id"), F.col("mask").alias("other"))
    return r6(m.join(nxt, "vec_id").select("vec_id", detection.mask_iou(F.col("mask"), F.col("other")).alias("iou")))


@query("v11_mask_pairs", f"""WITH {_MASKS}, p AS (SELECT a.label AS image_id, a.vec_id AS l_label_id, b.vec_id AS d_det_id,
 list_dot_product(a.m::DOUBLE[], b.m::DOUBLE[]) / (list_sum(a.m) + list_sum(b.m) - list_dot_product(a.m::DOUBLE[], b.m::DOUBLE[]) + 1e-7) AS iou FROM mk a JOIN mk b ON a.label = b.label)
 SELECT CAST(image_id AS BIGINT) AS image_id, l_label_id, d_det_id, round(iou, 6) AS iou FROM p WHERE iou >= 0.5""")
def mask_pairs(spark, d):
    m = masks(spark, d).drop("cls")
    return r6(detection.mask_pairs(m.withColumnRenamed("vec_id", "label_id"), m.withColumnRenamed("vec_id", "det_id"), ["image_id"]))


@query("v11_mask_average_precision")
def mask_average_precision(spark, d):
    m = masks(spark, d)
    lb = m.withColumnRenamed("vec_id", "label_id")
    dt = m.withColumn("conf", (F.col("vec_id") % 97) / 97.0).withColumn("mask", F.transform("mask", lambda v, i: F.when(i % 9 == 0, 1 - v).otherwise(v).cast("tinyint"))).withColumnRenamed("vec_id", "det_id")
    points = detection.curve_points(detection.match_masks(lb, dt), lb, 10)
    return detection.average_precision(points, lb, 10)


@query("v12_top_accuracy", """WITH e AS (SELECT vec_id, label, unnest(embedding) AS s, unnest(range(len(embedding))) AS i FROM embeddings),
 r AS (SELECT vec_id, label, i, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, i) AS rn FROM e),
 h AS (SELECT vec_id, CAST(label AS INT) AS target, max(CASE WHEN rn = 1 AND i = label THEN 1 ELSE 0 END) AS t1, max(CASE WHEN rn <= 5 AND i = label THEN 1 ELSE 0 END) AS t5 FROM r GROUP BY 1, 2)
 SELECT target, count(*) AS images, round(avg(t1), 6) AS top1, round(avg(t5), 6) AS top5 FROM h GROUP BY ROLLUP (target)""")
def top_accuracy(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("int").alias("target"), F.col("embedding").alias("scores"))
    return r6(detection.top_accuracy(detection.top_classes(e)))


def label_file(spark, d):
    """Label lines per order with defects in known places, and images with sizes."""
    li = table(spark, d, "lineitem")
    f = [F.col("l_linenumber").cast("double"), F.col("l_discount") * 10 - F.when(F.col("l_tax") > 0.07, 0.5).otherwise(0.0),
         F.col("l_tax") * 10, F.col("l_quantity") / 50, F.lit(0.5)]
    fields = F.when(F.col("l_quantity") > 48, F.array(*f[:4])).otherwise(F.array(*f))
    # Every third order has no label file of its own: its labels belong to the order before it.
    owner = F.col("l_orderkey") - F.when(F.col("l_orderkey") % 3 == 0, 1).otherwise(0)
    lines = li.select(owner.alias("image_id"), F.when(F.col("l_returnflag") != "R", fields).alias("fields"))
    images = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("image_id"), (F.col("o_custkey") % 200 + 5).alias("width"), F.lit(100).alias("height"),
        F.when(F.col("o_orderstatus") == "P", "GIF").otherwise("JPG").alias("format"))
    return images, lines


_OWNER = "l_orderkey - CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE 0 END"
_VERIFY = f"""ln AS (SELECT {_OWNER} AS image_id, CASE WHEN l_returnflag <> 'R' THEN CASE WHEN l_quantity > 48 THEN [l_linenumber::DOUBLE, l_discount * 10 - CASE WHEN l_tax > 0.07 THEN 0.5 ELSE 0 END, l_tax * 10, l_quantity / 50]
  ELSE [l_linenumber::DOUBLE, l_discount * 10 - CASE WHEN l_tax > 0.07 THEN 0.5 ELSE 0 END, l_tax * 10, l_quantity / 50, 0.5] END END AS f FROM lineitem),
 dl AS (SELECT image_id, f, count(*) AS c FROM ln GROUP BY 1, 2),
 pi AS (SELECT image_id, count(f) AS labels, coalesce(sum(c - 1) FILTER (f IS NOT NULL), 0) AS duplicates, bool_or(len(f) <> 5) AS r0, bool_or(list_min(f) < 0) AS r1, bool_or(list_max(f[2:]) > 1) AS r2 FROM dl GROUP BY 1),
 vf AS (SELECT o_orderkey AS image_id, array_to_string(list_filter([CASE WHEN o_custkey % 200 + 5 < 10 THEN 'image size below 10 pixels' END, CASE WHEN o_orderstatus = 'P' THEN 'invalid image format' END,
   CASE WHEN r0 THEN 'labels require 5 columns' END, CASE WHEN r1 THEN 'negative label values' END, CASE WHEN r2 THEN 'non-normalized or out of bounds coordinates' END], lambda x: x IS NOT NULL), '; ') AS reasons, labels, duplicates
   FROM orders LEFT JOIN pi ON image_id = o_orderkey),
 vv AS (SELECT image_id, CASE WHEN reasons <> '' THEN 'corrupt' WHEN labels IS NULL THEN 'missing' WHEN labels = 0 THEN 'empty' ELSE 'found' END AS status, reasons, coalesce(labels, 0) AS labels, CAST(coalesce(duplicates, 0) AS BIGINT) AS duplicates FROM vf)"""


@query("v13_c10_g4_verify", f"WITH {_VERIFY} SELECT * FROM vv")
def verify(spark, d):
    return dataset.verify(*label_file(spark, d))


@query("d27_scan_result", f"""WITH {_VERIFY} SELECT count(*) FILTER (status = 'found') AS found, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'empty') AS empty,
 count(*) FILTER (status = 'corrupt') AS corrupt, count(*) AS total, CAST(sum(duplicates) AS BIGINT) AS duplicates FROM vv""")
def scan_result(spark, d):
    return dataset.scan_result(dataset.verify(*label_file(spark, d)))


@query("d27_scan_messages", f"""WITH {_VERIFY} SELECT image_id, CASE WHEN reasons <> '' THEN 'ignoring corrupt image/label: ' || reasons ELSE duplicates || ' duplicate labels removed' END AS message
 FROM vv WHERE reasons <> '' OR duplicates > 0""")
def scan_messages(spark, d):
    return dataset.scan_messages(dataset.verify(*label_file(spark, d)))


@query("c10_orphan_labels", f"SELECT DISTINCT {_OWNER} AS image_id FROM lineitem WHERE {_OWNER} NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def orphan_labels(spark, d):
    images, lines = label_file(spark, d)
    kept = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("image_id"))
    return dataset.orphan_labels(kept, lines)


@query("v14_assign_split")
def assign_split(spark, d):
    images = table(spark, d, "pages").select(F.col("url").alias("path"), "page_id")
    return dataset.assign_split(images)


@query("v15_anchor_fit", f"""WITH {BOXES}, a AS (SELECT unnest({[list(map(float, a)) for a in ANCHORS]}::DOUBLE[][]) AS a),
 r AS (SELECT image_id, label_id, least((x2 - x1) / a[1], a[1] / (x2 - x1), (y2 - y1) / a[2], a[2] / (y2 - y1)) AS r FROM lb, a),
 b AS (SELECT image_id, label_id, max(r) AS best, count(*) FILTER (r > 0.25) AS good FROM r GROUP BY 1, 2)
 SELECT round(avg(CASE WHEN best > 0.25 THEN 1.0::DOUBLE ELSE 0 END), 6) AS bpr, round(avg(good), 6) AS aat, round(avg(CASE WHEN best > 0.25 THEN best ELSE 0 END), 6) AS anchor_fitness FROM b""")
def anchor_fit(spark, d):
    sizes = labels(spark, d).select((F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))
    return r6(dataset.anchor_fit(sizes, ANCHORS))


@query("v16_search_anchors")
def search_anchors(spark, d):
    sizes = labels(spark, d).select((F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))
    return dataset.search_anchors(sizes, 9)


def _norm():
    return B.normalise(*B.corners(), F.lit(FRAME), F.lit(FRAME))


@query("v17_crops", f"""WITH {BOXES}, n AS (SELECT image_id, label_id, (x1 + x2) / 2 / 200 AS x, (y1 + y2) / 2 / 200 AS y, (x2 - x1) / 200 AS w, (y2 - y1) / 200 AS h FROM lb)
 SELECT image_id, label_id, """ + ", ".join(f"CAST(least(greatest(CAST(trunc({c} * 200 {s} ({w} * 200 * 1.2::DOUBLE + 3) / 2) AS INT), 0), 200) AS DOUBLE) AS {n}" for n, c, s, w in (
    ("x1", "x", "-", "w"), ("y1", "y", "-", "h"), ("x2", "x", "+", "w"), ("y2", "y", "+", "h"))) + " FROM n")
def crops(spark, d):
    out = B.crop(*_norm(), F.lit(FRAME), F.lit(FRAME))
    return labels(spark, d).select("image_id", "label_id", *[c.cast("double").alias(n) for n, c in zip(detection.BOX, out)])


@query("v18_filter_targets", f"""WITH {BOXES} SELECT image_id, label_id, CAST(0 AS INT) AS cls FROM lb WHERE cls IN (0, 2) AND image_id IN (SELECT image_id FROM lb GROUP BY 1 HAVING count(*) >= 3)""")
def filter_targets(spark, d):
    return dataset.filter_targets(labels(spark, d), [0, 2], True, 3).select("image_id", "label_id", "cls")


@query("v19_pixel_corners", f"""WITH {BOXES}, n AS (SELECT image_id, label_id, (x1 + x2) / 2 / 200 AS x, (y1 + y2) / 2 / 200 AS y, (x2 - x1) / 200 AS w, (y2 - y1) / 200 AS h FROM lb)
 SELECT image_id, label_id, """ + ", ".join(f"CAST(trunc({s} * ({c} {o} {w} / 2)) AS INT) AS {n}" for n, c, o, w, s in (
    ("x1", "x", "-", "w", 333), ("y1", "y", "-", "h", 217), ("x2", "x", "+", "w", 333), ("y2", "y", "+", "h", 217))) + " FROM n")
def pixel_corners(spark, d):
    out = B.pixel_corners(*_norm(), F.lit(333), F.lit(217))
    return labels(spark, d).select("image_id", "label_id", *[c.alias(n) for n, c in zip(detection.BOX, out)])


@query("b13_filter_boxes", f"""WITH {BOXES} SELECT image_id, det_id FROM dt WHERE conf > 0.5 AND cls IN (0, 1) AND x2 - x1 > 5 AND y2 - y1 > 5
 AND greatest((x2 - x1) / (y2 - y1 + 1e-16), (y2 - y1) / (x2 - x1 + 1e-16)) < 3 AND (x2 - x1) * (y2 - y1) > 200""")
def filter_boxes(spark, d):
    return B.filter_boxes(detections(spark, d), 0.5, [0, 1], 5, 3, 200).select("image_id", "det_id")


@query("b13_box_candidates", f"""WITH {BOXES}, p AS (SELECT image_id, box_id, x2 - x1 AS w1, y2 - y1 AS h1, x2 - x1 AS w2, y2 + 3 - y1 AS h2 FROM bx)
 SELECT image_id, box_id, w2 > 12 AND h2 > 12 AND w2 * h2 / (w1 * h1 + 1e-16) > 1.1 AND greatest(w2 / (h2 + 1e-16), h2 / (w2 + 1e-16)) < 4 AS kept FROM p""")
def box_candidates(spark, d):
    return _pair(spark, d).select("image_id", "box_id", B.box_candidates(B.corners("l_"), B.corners("d_"), 12, 4, 1.1).alias("kept"))


@query("c11_class_remap", f"WITH {BOXES} SELECT image_id, label_id, CAST(CASE cls WHEN 0 THEN 18 ELSE 19 END AS INT) AS cls FROM lb WHERE cls < 2")
def class_remap(spark, d):
    return dataset.remap(labels(spark, d), {0: 18, 1: 19, 2: -1}).select("image_id", "label_id", "cls")


@query("d25_boxes_per_class", f"WITH {BOXES} SELECT image_id, cls, count(*) AS n FROM dt GROUP BY 1, 2")
def boxes_per_class(spark, d):
    return dataset.class_counts(detections(spark, d))


def split_images(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"),
                                            F.when(F.col("o_orderstatus") == "F", "train").when(F.col("o_orderstatus") == "O", "val").otherwise("test").alias("split"))


_SPLITS = "im AS (SELECT o_orderkey AS image_id, CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'val' ELSE 'test' END AS split FROM orders)"


@query("d26_dataset_stats", f"""WITH {BOXES}, {_SPLITS} SELECT s.split, CAST(c.cls AS INT) AS cls, count(lb.label_id) AS instances, count(DISTINCT lb.image_id) AS images
 FROM (SELECT DISTINCT split FROM im) s CROSS JOIN range(4) c(cls) LEFT JOIN (SELECT lb.*, split FROM lb JOIN im USING (image_id)) lb ON lb.split = s.split AND lb.cls = c.cls GROUP BY 1, 2""")
def dataset_stats(spark, d):
    classes = spark.range(4).select(F.col("id").cast("int").alias("cls"))
    return dataset.dataset_stats(split_images(spark, d), labels(spark, d), classes)


@query("d26_split_totals", f"""WITH {BOXES}, {_SPLITS}, n AS (SELECT image_id, count(*) AS n FROM lb GROUP BY 1)
 SELECT split, CAST(coalesce(sum(n), 0) AS BIGINT) AS instances, count(*) AS images, count(*) FILTER (n IS NULL) AS unlabelled FROM im LEFT JOIN n USING (image_id) GROUP BY split""")
def split_totals(spark, d):
    return dataset.split_totals(split_images(spark, d), labels(spark, d))


@query("d28_class_weights", f"WITH {BOXES}, c AS (SELECT cls, 1.0::DOUBLE / count(*) AS w FROM lb GROUP BY cls) SELECT cls, round(w / (SELECT sum(w) FROM c), 6) AS weight FROM c")
def class_weights(spark, d):
    return r6(dataset.class_weights(labels(spark, d)))


@query("d28_image_weights", f"""WITH {BOXES}, c AS (SELECT cls, 1.0::DOUBLE / count(*) AS w FROM lb GROUP BY cls), k AS (SELECT cls, w / (SELECT sum(w) FROM c) AS w FROM c)
 SELECT image_id, round(sum(w), 6) AS weight FROM lb JOIN k USING (cls) GROUP BY 1""")
def image_weights(spark, d):
    lb = labels(spark, d)
    return r6(dataset.image_weights(lb, dataset.class_weights(lb)))


@query("d29_geometry_histogram_2d", f"""WITH {BOXES}, n AS (SELECT (x1 + x2) / 2 / 200 AS x, (y1 + y2) / 2 / 200 AS y FROM lb), e AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM n)
 SELECT CAST(least(floor((x - lx) / ((hx - lx) / 50)), 49) AS INT) AS bx, CAST(least(floor((y - ly) / ((hy - ly) / 50)), 49) AS INT) AS by, count(*) AS n FROM n, e GROUP BY 1, 2""")
def geometry_histogram_2d(spark, d):
    from gearwatch.operators.prefix import histogram_2d

    x, y, _, _ = _norm()
    return histogram_2d(labels(spark, d).select(x.alias("x"), y.alias("y")), "x", "y", 50)


@query("d29_geometry_histogram", f"""WITH {BOXES}, n AS (SELECT (x2 - x1) / 200 AS w FROM lb), e AS (SELECT min(w) AS lo, max(w) AS hi FROM n)
 SELECT CAST(least(floor((w - lo) / ((hi - lo) / 50)), 49) AS INT) AS bin, count(*) AS n FROM n, e GROUP BY 1""")
def geometry_histogram(spark, d):
    from gearwatch.operators.prefix import histogram

    w = _norm()[2]
    return histogram(labels(spark, d).select(w.alias("w")), "w", 50).filter("n > 0").select("bin", "n")


@query("d24_inspection_summary", f"""WITH {BOXES}, i AS (SELECT image_id, count(*) FILTER (conf > 0.8) AS defects FROM dt GROUP BY 1)
 SELECT count(*) AS images, count(*) FILTER (defects > 0) AS defected, round(count(*) FILTER (defects > 0) * 100.0 / count(*), 6) AS defected_pct, CAST(sum(defects) AS BIGINT) AS defects FROM i""")
def inspection_summary(spark, d):
    per = detections(spark, d).groupBy("image_id").agg(F.count_if(F.col("conf") > 0.8).alias("defects"))
    return r6(dataset.inspection_summary(per.withColumn("verdict", F.when(F.col("defects") > 0, "Defected").otherwise("Non-Defected"))))


@query("a14_detection_rows", f"""WITH {BOXES} SELECT image_id AS "Image Name", CASE cls WHEN 0 THEN 'crack' WHEN 1 THEN 'dent' ELSE 'rust' END AS "Prediction", printf('%.2f', conf) AS "Confidence" FROM dt""")
def detection_rows(spark, d):
    return A.detection_rows(detections(spark, d), NAMES)


@query("a16_label_lines", f"""WITH {BOXES} SELECT image_id, printf('%g %g %g %g %g', cls::DOUBLE, (x1 + x2) / 2 / 200, (y1 + y2) / 2 / 200, (x2 - x1) / 200, (y2 - y1) / 200) AS value FROM lb""")
def label_lines(spark, d):
    return A.label_lines(labels(spark, d), F.lit(FRAME), F.lit(FRAME))


@query("a17_detection_json", f"""WITH {BOXES} SELECT image_id, CASE cls WHEN 0 THEN 18 WHEN 1 THEN 19 ELSE 20 END AS category_id, [round(x1, 3), round(y1, 3), round(x2 - x1, 3), round(y2 - y1, 3)] AS bbox, round(conf, 5) AS score FROM dt""")
def detection_json(spark, d):
    return dataset.to_detection_json(detections(spark, d), {0: 18, 1: 19, 2: 20})


@query("a18_label_paths", r"""SELECT page_id, regexp_replace('/data/images/' || page_id || '/images/a.' || page_id || '.jpg', '^(.*)/images/(.*)\.[^./]*$', '\1/labels/\2.txt') AS label_path FROM pages""")
def label_paths(spark, d):
    p = F.concat(F.lit("/data/images/"), F.col("page_id").cast("string"), F.lit("/images/a."), F.col("page_id").cast("string"), F.lit(".jpg"))
    return table(spark, d, "pages").select("page_id", A.label_path(p).alias("label_path"))


def _text_lines(spark, d):
    """Label text made from the boxes: plain boxes, and polygons for class 2."""
    b = base_boxes(spark, d)
    plain = F.concat_ws(" ", *[c.cast("string") for c in (F.col("cls"), *_norm())])
    poly = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("cls", "x1", "y1", "x2", "y1", "x2", "y2")])
    return b.select("image_id", "box_id", F.when(F.col("cls") == 2, poly).otherwise(plain).alias("value"))


@query("a15_parse_labels", f"""WITH {BOXES} SELECT image_id, box_id, cls, CASE WHEN cls = 2 THEN (x1 + x2) / 2 ELSE (x1 + x2) / 2 / 200 END AS x, CASE WHEN cls = 2 THEN (y1 + y2) / 2 ELSE (y1 + y2) / 2 / 200 END AS y,
 CASE WHEN cls = 2 THEN x2 - x1 ELSE (x2 - x1) / 200 END AS w, CASE WHEN cls = 2 THEN y2 - y1 ELSE (y2 - y1) / 200 END AS h FROM bx""")
def parse_labels(spark, d):
    return A.labels_from_fields(A.parse_label_lines(_text_lines(spark, d))).drop("polygon")


@query("a19_voc", f"""WITH {BOXES} SELECT image_id, CAST(cls AS INT) AS cls, round(((x1 + x2) / 2 - 1) / 200, 6) AS x, round(((y1 + y2) / 2 - 1) / 100, 6) AS y, round((x2 - x1) / 200, 6) AS w, round((y2 - y1) / 100, 6) AS h FROM bx WHERE conf <= 0.5 AND cls <> 2""")
def voc(spark, d):
    b = base_boxes(spark, d)
    name = F.when(F.col("cls") == 0, "crack").when(F.col("cls") == 1, "dent").otherwise("other")
    xml = F.format_string(
        "<annotation><size><width>200</width><height>100</height></size><object><name>%s</name><difficult>%d</difficult><bndbox>"
        "<xmin>%s</xmin><xmax>%s</xmax><ymin>%s</ymin><ymax>%s</ymax></bndbox></object></annotation>",
        name, (F.col("conf") > 0.5).cast("int"), *[F.col(c).cast("string") for c in ("x1", "x2", "y1", "y2")])
    return r6(A.convert_annotations(b.select("image_id", xml.alias("xml")), "voc", ["crack", "dent"]))


@query("a19_detection_json", f"""WITH {BOXES} SELECT image_id, CAST(cls AS INT) AS cls, round((least(x1, 120) + least(x2, 120)) / 2 / 120, 5) AS x, round((least(y1, 90) + least(y2, 90)) / 2 / 90, 5) AS y,
 round((least(x2, 120) - least(x1, 120)) / 120, 5) AS w, round((least(y2, 90) - least(y1, 90)) / 90, 5) AS h FROM bx WHERE conf <= 0.5""")
def detection_json_in(spark, d):
    b = base_boxes(spark, d)
    x1, y1, x2, y2 = B.corners()
    ann = b.select("image_id", (F.col("cls") + 10).alias("category_id"), F.array(x1, y1, x2 - x1, y2 - y1).alias("bbox"), (F.col("conf") > 0.5).cast("int").alias("iscrowd"))
    images = table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"), F.lit(120.0).alias("width"), F.lit(90.0).alias("height"))
    cats = spark.range(3).select((F.col("id") + 10).cast("int").alias("category_id"), F.col("id").cast("int").alias("cls"))
    return A.convert_annotations(ann, "detection_json", images, cats)


@query("a19_fixed_frame", f"WITH {BOXES} SELECT image_id, cls, (x1 + (x2 - x1) / 2) / 1920 AS x, (y1 + (y2 - y1) / 2) / 1200 AS y, (x2 - x1) / 1920 AS w, (y2 - y1) / 1200 AS h FROM bx")
def fixed_frame(spark, d):
    x1, y1, x2, y2 = B.corners()
    ann = base_boxes(spark, d).select("image_id", "cls", F.array(x1, y1, x2 - x1, y2 - y1).alias("bbox"))
    return A.convert_annotations(ann, "fixed_frame")


@query("a19_drone_csv", f"""WITH {BOXES} SELECT image_id, CAST(cls AS INT) AS cls, round((x1 + (x2 - x1) / 2) / 300, 6) AS x, round((y1 + (y2 - y1) / 2) / 170, 6) AS y, round((x2 - x1) / 300, 6) AS w, round((y2 - y1) / 170, 6) AS h FROM bx WHERE conf > 0.3""")
def drone_csv(spark, d):
    x1, y1, x2, y2 = B.corners()
    parts = [c.cast("int").cast("string") for c in (x1, y1, x2 - x1, y2 - y1, (F.col("conf") > 0.3).cast("int"), F.col("cls") + 1)]
    lines = base_boxes(spark, d).select("image_id", F.concat_ws(",", *parts).alias("value"))
    images = table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"), F.lit(300).alias("width"), F.lit(170).alias("height"))
    return A.convert_annotations(lines, "drone_csv", images)


@query("a19_overhead_geojson", f"""WITH {BOXES} SELECT image_id, CASE cls WHEN 0 THEN 0 ELSE 1 END AS cls, round((least(x1, 120) + least(x2, 120)) / 2 / 120, 6) AS x, round((least(y1, 90) + least(y2, 90)) / 2 / 90, 6) AS y,
 round((least(x2, 120) - least(x1, 120)) / 120, 6) AS w, round((least(y2, 90) - least(y1, 90)) / 90, 6) AS h FROM bx WHERE cls < 2""")
def overhead_geojson(spark, d):
    text = F.concat_ws(",", *[c.cast("int").cast("string") for c in B.corners()])
    features = base_boxes(spark, d).select("image_id", F.when(F.col("cls") == 2, 14).otherwise(F.col("cls") + 11).alias("type_id"), text.alias("bounds"))
    images = table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"), F.lit(120.0).alias("width"), F.lit(90.0).alias("height"))
    return A.convert_annotations(features, "overhead_geojson", images)


@query("a19_shelf_csv", f"WITH {BOXES} SELECT image_id, CAST(0 AS INT) AS cls, round((x1 / 200 + x2 / 200) / 2, 5) AS x, round((y1 / 100 + y2 / 100) / 2, 5) AS y, round(x2 / 200 - x1 / 200, 5) AS w, round(y2 / 100 - y1 / 100, 5) AS h FROM bx")
def shelf_csv(spark, d):
    rows = base_boxes(spark, d).select(F.col("image_id").alias("image"), *detection.BOX, F.lit(200).alias("image_width"), F.lit(100).alias("image_height"))
    return A.convert_annotations(rows, "shelf_csv")
