"""Detection datasets: label verification, scan results, statistics, weights, splits, anchors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gearwatch.functions import boxes as B

# Accepted image formats, smallest side, split shares.
IMAGE_FORMATS = ["bmp", "dng", "jpeg", "jpg", "mpo", "png", "tif", "tiff", "webp", "pfm"]
MIN_SIDE = 10
SPLIT_SHARES = {"train": 0.9, "val": 0.1, "test": 0.0}


def line_reasons(fields: Column) -> Column:
    """What is wrong with one parsed label line (class, x, y, w, h); empty when it is fine."""
    return F.array_compact(F.array(
        F.when(F.size(fields) != 5, "labels require 5 columns"),
        F.when(F.exists(fields, lambda v: v < 0), "negative label values"),
        F.when(F.exists(F.slice(fields, 2, 100), lambda v: v > 1), "non-normalized or out of bounds coordinates"),
    ))


def image_reasons(width: Column, height: Column, fmt: Column) -> Column:
    """What is wrong with an image."""
    return F.array_compact(F.array(
        F.when((width < MIN_SIDE) | (height < MIN_SIDE), "image size below 10 pixels"),
        F.when(~F.lower(fmt).isin(IMAGE_FORMATS), "invalid image format"),
    ))


def verify(images: DataFrame, lines: DataFrame) -> DataFrame:
    """V13 + C10 + G4: one status row per image.

    ``images`` holds (image_id, width, height, format), ``lines`` holds (image_id, fields); an image whose label
    file exists but is empty has one line with null fields. Status is missing, empty, corrupt or found; repeated
    label lines are counted and dropped from ``labels``.
    """
    distinct = lines.groupBy("image_id", "fields").agg(F.count("*").alias("copies"))
    known = F.col("fields").isNotNull()
    per = distinct.withColumn("_bad", F.when(known, line_reasons(F.col("fields")))).groupBy("image_id").agg(
        F.count_if(known).alias("labels"),
        F.coalesce(F.sum(F.when(known, F.col("copies") - 1)), F.lit(0)).alias("duplicates"),
        *[F.max(F.when(known & F.array_contains("_bad", r), F.lit(r))).alias(f"_r{i}")
          for i, r in enumerate(("labels require 5 columns", "negative label values", "non-normalized or out of bounds coordinates"))],
    )
    out = images.join(per, "image_id", "left")
    reasons = F.concat(
        image_reasons(F.col("width"), F.col("height"), F.col("format")),
        F.array_compact(F.array("_r0", "_r1", "_r2")),
    )
    status = (
        F.when(F.size("reasons") > 0, "corrupt").when(F.col("labels").isNull(), "missing")
        .when(F.col("labels") == 0, "empty").otherwise("found")
    )
    return out.withColumn("reasons", reasons).select(
        "image_id", status.alias("status"), F.array_join("reasons", "; ").alias("reasons"),
        F.coalesce("labels", F.lit(0)).alias("labels"), F.coalesce("duplicates", F.lit(0)).alias("duplicates"))


def orphan_labels(images: DataFrame, lines: DataFrame) -> DataFrame:
    """Label files without an image."""
    return lines.select("image_id").distinct().join(images, "image_id", "left_anti")


def scan_result(verified: DataFrame) -> DataFrame:
    """Images found, missing, empty, corrupt and in total, and labels dropped as duplicates."""
    kinds = ("found", "missing", "empty", "corrupt")
    return verified.agg(*[F.count_if(F.col("status") == k).alias(k) for k in kinds], F.count("*").alias("total"),
                        F.sum("duplicates").alias("duplicates"))


def scan_messages(verified: DataFrame) -> DataFrame:
    """One message row per image with something to report."""
    dup = F.when(F.col("duplicates") > 0, F.concat(F.col("duplicates").cast("string"), F.lit(" duplicate labels removed")))
    bad = F.when(F.col("reasons") != "", F.concat(F.lit("ignoring corrupt image/label: "), F.col("reasons")))
    return verified.select("image_id", F.coalesce(bad, dup).alias("message")).filter("message IS NOT NULL")


def class_counts(labels: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Boxes per class per image."""
    return labels.groupBy(*keys, "cls").agg(F.count("*").alias("n"))


def dataset_stats(images: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """Per split and class: instances, and images that contain the class; absent classes show zero.

    ``classes`` is the class list of the dataset, a small fixed table.
    """
    inst = labels.join(images.select("image_id", "split"), "image_id").groupBy("split", "cls", "image_id").agg(F.count("*").alias("n"))
    per = inst.groupBy("split", "cls").agg(F.sum("n").alias("instances"), F.count("*").alias("images"))
    known = classes.agg(F.collect_set("cls")).scalar()
    spine = images.select("split").distinct().select("split", F.explode(known).alias("cls"))
    return spine.join(per, ["split", "cls"], "left").fillna(0, ["instances", "images"])


def split_totals(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Instances, images and unlabelled images per split."""
    n = labels.groupBy("image_id").agg(F.count("*").alias("n"))
    return images.join(n, "image_id", "left").groupBy("split").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("instances"), F.count("*").alias("images"),
        F.count_if(F.col("n").isNull()).alias("unlabelled"))


def class_weights(labels: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Inverse class counts (an absent class counts as one), scaled to sum to one."""
    counts = labels.groupBy("cls").agg(F.count("*").alias("n"))
    if classes is not None:
        counts = classes.join(counts, "cls", "left")
    inverse = counts.select("cls", (F.lit(1.0) / F.greatest(F.coalesce("n", F.lit(1)), F.lit(1))).alias("w"))
    return inverse.select("cls", (F.col("w") / inverse.agg(F.sum("w")).scalar()).alias("weight"))


def image_weights(labels: DataFrame, weights: DataFrame) -> DataFrame:
    """Sum of the class weights of the boxes of each image."""
    return class_counts(labels).join(weights, "cls").groupBy("image_id").agg(F.sum(F.col("n") * F.col("weight")).alias("weight"))


def assign_split(images: DataFrame, key: str = "path", shares: dict[str, float] = SPLIT_SHARES, seed: int = 0) -> DataFrame:
    """Split by a hash of the path: the same image always lands in the same split."""
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(10_000))
    total, out = 0.0, F.lit(None).cast("string")
    bounds = []
    for name, share in shares.items():
        total += share
        bounds.append((round(total * 10_000), name))
    for edge, name in reversed(bounds):
        out = F.when(draw < edge, name).otherwise(out)
    return images.withColumn("split", out)


def filter_targets(labels: DataFrame, include: Sequence[int] | None = None, single_class: bool = False, min_items: int = 0) -> DataFrame:
    """Keep images with enough labels, then listed classes, then optionally merge all classes into 0."""
    if min_items:
        enough = labels.groupBy("image_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_items)
        labels = labels.join(enough.select("image_id"), "image_id", "left_semi")
    if include:
        labels = labels.filter(F.col("cls").isin(list(include)))
    return labels.withColumn("cls", F.lit(0)) if single_class else labels


def anchor_fit(sizes: DataFrame, anchors: Sequence[tuple[float, float]], limit: float = 4.0) -> DataFrame:
    """Best possible recall and mean anchors above threshold for box sizes (w, h), plus mean best ratio."""
    pairs = F.array(*[F.struct(F.lit(float(w)).alias("w"), F.lit(float(h)).alias("h")) for w, h in anchors])
    w, h = F.col("w"), F.col("h")
    ratio = F.transform(pairs, lambda a: F.least(w / a["w"], a["w"] / w, h / a["h"], a["h"] / h))
    good = F.size(F.filter("_r", lambda v: v > 1 / limit))
    best = F.array_max("_r")
    return sizes.withColumn("_r", ratio).agg(
        F.avg((best > 1 / limit).cast("double")).alias("bpr"),
        F.avg(good.cast("double")).alias("aat"),
        F.avg(F.when(best > 1 / limit, best).otherwise(0.0)).alias("anchor_fitness"),
    )


def search_anchors(sizes: DataFrame, n: int = 9, seed: int = 42, min_px: float = 2.0):
    """N anchor sizes by k-means on sizes whitened by their deviation; boxes below ``min_px`` on both sides are left out."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    usable = sizes.filter((F.col("w") >= min_px) | (F.col("h") >= min_px))
    s = usable.agg(F.struct(F.stddev_pop("w").alias("w"), F.stddev_pop("h").alias("h")).alias("s")).scalar()
    white = usable.withColumn("_s", s).select(
        (F.col("w") / F.col("_s")["w"]).alias("_w"), (F.col("h") / F.col("_s")["h"]).alias("_h"), "w", "h")
    data = VectorAssembler(inputCols=["_w", "_h"], outputCol="features").transform(white)
    model = KMeans(k=n, seed=seed, maxIter=30).fit(data.select("features"))
    assigned = model.transform(data).groupBy("prediction").agg(F.avg("w").alias("w"), F.avg("h").alias("h"))
    return assigned.orderBy(F.col("w") * F.col("h")).select("w", "h")


def inspection_summary(images: DataFrame) -> DataFrame:
    """Images, defected images and %, total defects (``verdict``, ``defects`` per image)."""
    bad = F.count_if(F.col("verdict") == "Defected")
    return images.agg(F.count("*").alias("images"), bad.alias("defected"),
                      F.coalesce(F.try_divide(bad * 100.0, F.count("*")), F.lit(0.0)).alias("defected_pct"),
                      F.sum("defects").alias("defects"))


def remap(df: DataFrame, mapping: dict[int, int], column: str = "cls") -> DataFrame:
    """C11: map class ids through a fixed table; ids outside it, or mapped below zero, are dropped."""
    table = F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])
    return df.withColumn(column, F.try_element_at(table, F.col(column))).filter(F.col(column) >= 0)


# The ids in the 91-class list of the 80 classes, in order.
IDS_91 = [
    1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 27, 28, 31,
    32, 33, 34, 35, 36, 37, 38, 39, 40, 41, 42, 43, 44, 46, 47, 48, 49, 50, 51, 52, 53, 54, 55, 56, 57, 58, 59,
    60, 61, 62, 63, 64, 65, 67, 70, 72, 73, 74, 75, 76, 77, 78, 79, 80, 81, 82, 84, 85, 86, 87, 88, 89, 90,
]
CLASS_80_TO_91 = dict(enumerate(IDS_91))


def to_detection_json(dets: DataFrame, mapping: dict[int, int] | None = None) -> DataFrame:
    """Rows (image_id, category_id, bbox, score): top-left box to three places, score to five.

    A numeric image name becomes a number in the JSON text.
    """
    x1, y1, x2, y2 = B.corners()
    bbox = F.array(*[F.round(c.cast("double"), 3) for c in (x1, y1, x2 - x1, y2 - y1)])
    base = dets if mapping is None else remap(dets, mapping)
    return base.select("image_id", F.col("cls").alias("category_id"), bbox.alias("bbox"), F.round("conf", 5).alias("score"))
