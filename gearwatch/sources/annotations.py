"""Label files, detection sinks, image lists, annotation formats and run histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gearwatch.functions import boxes as B
from gearwatch.operators.dataset import IMAGE_FORMATS, remap


def stem(path: Column) -> Column:
    """File name without folder and extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def read_label_lines(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, fields) per label line."""
    text = spark.read.option("recursiveFileLookup", True).text(path)
    return parse_label_lines(text.select(stem(F.col("_metadata.file_path")).alias("image_id"), "value"))


def parse_label_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """Numbers of each label line; blank lines carry nothing."""
    parts = F.split(F.trim(F.col(text)), r"\s+")
    rest = [c for c in lines.columns if c != text]
    return lines.filter(F.length(F.trim(F.col(text))) > 0).select(
        *rest, F.transform(parts, lambda v: v.try_cast("double")).alias("fields"))


def labels_from_fields(lines: DataFrame) -> DataFrame:
    """Class and normalised box; a line with more than six fields is a polygon and takes its bounding box."""
    f = F.col("fields")
    poly = F.transform(F.sequence(F.lit(1), ((F.size(f) - 1) / 2).cast("int")),
                       lambda i: B.point(F.get(f, i * 2 - 1), F.get(f, i * 2)))
    is_poly = F.size(f) > 6
    out = lines.withColumn("polygon", F.when(is_poly, poly))
    box = B.to_centre(*B.polygon_box(F.col("polygon")))
    rest = [c for c in lines.columns if c != "fields"]
    return out.select(*rest, F.get(f, F.lit(0)).cast("int").alias("cls"),
                      *[F.when(is_poly, b).otherwise(F.get(f, F.lit(i + 1))).alias(n) for i, (n, b) in enumerate(zip("xywh", box))],
                      "polygon")


def shortest(value: Column) -> Column:
    """Six significant digits without trailing zeros, the way printf %g prints a number in C."""
    padded = F.format_string("%.6g", value)
    return F.regexp_replace(F.regexp_replace(padded, r"(\.\d*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")


def label_lines(dets: DataFrame, width, height, with_conf: bool = False) -> DataFrame:
    """One text line per detection: class and normalised centre box, optionally the confidence."""
    box = B.normalise(*B.corners(), width, height)
    parts = [F.col("cls").cast("double"), *box] + ([F.col("conf")] if with_conf else [])
    return dets.select("image_id", F.concat_ws(" ", *[shortest(p) for p in parts]).alias("value"))


def write_labels(dets: DataFrame, path: str, width, height, with_conf: bool = False, mode: str = "append") -> None:
    """Label text files in one folder per image."""
    lines = label_lines(dets, width, height, with_conf).hint("rebalance", "image_id")  # else every task writes a file per image
    lines.write.mode(mode).partitionBy("image_id").text(path)


def detection_rows(dets: DataFrame, names: dict[int, str]) -> DataFrame:
    """(image, prediction, confidence with two decimals)."""
    table = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
    return dets.select(F.col("image_id").alias("Image Name"), F.try_element_at(table, F.col("cls")).alias("Prediction"),
                       F.format_string("%.2f", "conf").alias("Confidence"))


def write_detections(dets: DataFrame, path: str, names: dict[int, str]) -> None:
    """Append detections as CSV."""
    detection_rows(dets, names).write.mode("append").option("header", True).csv(path)


def list_images(spark: SparkSession, folder: str, formats: Sequence[str] = IMAGE_FORMATS) -> DataFrame:
    """Images below a folder by extension (any case), without reading their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    return files.filter(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(list(formats)))


def list_from_file(spark: SparkSession, path: str, base: str) -> DataFrame:
    """Images named in a list file; ``./`` means below ``base``."""
    lines = spark.read.text(path).select(F.trim("value").alias("path")).filter(F.length("path") > 0)
    return lines.select(F.regexp_replace("path", r"^\./", base.rstrip("/").replace("\\", "\\\\").replace("$", "\\$") + "/").alias("path"))


def label_path(path: Column) -> Column:
    """Path of the label file of an image: the last ``/images/`` becomes ``/labels/``, the extension ``.txt``."""
    return F.regexp_replace(F.regexp_replace(path, r"^(.*)/images/", "$1/labels/"), r"\.[^./]*$", ".txt")


def from_voc(docs: DataFrame, names: Sequence[str]) -> DataFrame:
    """VOC XML documents (image_id, xml); known classes that are not difficult, centre shifted by one pixel."""
    schema = T.StructType.fromDDL(
        "size struct<width int, height int>, "
        "object array<struct<name string, difficult int, bndbox struct<xmin double, xmax double, ymin double, ymax double>>>")
    rows = docs.select("image_id", F.from_xml("xml", schema, {"rowTag": "annotation"}).alias("a"))
    obj = rows.select("image_id", F.col("a.size.width").alias("w"), F.col("a.size.height").alias("h"), F.explode("a.object").alias("o"))
    cls = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("o.name")) - 1
    b = F.col("o.bndbox")
    return obj.filter((cls >= 0) & (F.col("o.difficult") != 1)).select(
        "image_id", cls.cast("int").alias("cls"),
        (((b["xmin"] + b["xmax"]) / 2 - 1) / F.col("w")).alias("x"), (((b["ymin"] + b["ymax"]) / 2 - 1) / F.col("h")).alias("y"),
        ((b["xmax"] - b["xmin"]) / F.col("w")).alias("w"), ((b["ymax"] - b["ymin"]) / F.col("h")).alias("h"))


def from_detection_json(annotations: DataFrame, images: DataFrame, categories: DataFrame) -> DataFrame:
    """COCO-style rows: (image_id, category_id, bbox, iscrowd), (image_id, width, height), (category_id, cls)."""
    rows = annotations.filter(F.coalesce("iscrowd", F.lit(0)) == 0).join(images, "image_id").join(categories, "category_id")
    x, y, w, h = (F.get("bbox", F.lit(i)) for i in range(4))
    box = B.normalise(x, y, x + w, y + h, F.col("width"), F.col("height"), do_clip=True)
    return rows.select("image_id", "cls", *[F.round(c, 5).alias(n) for n, c in zip("xywh", box)])


def from_fixed_frame(annotations: DataFrame, width: float = 1920.0, height: float = 1200.0) -> DataFrame:
    """Boxes (image_id, cls, bbox top-left) of a camera with a fixed frame."""
    x, y, w, h = (F.get("bbox", F.lit(i)) for i in range(4))
    return annotations.select("image_id", "cls", ((x + w / 2) / width).alias("x"), ((y + h / 2) / height).alias("y"),
                              (w / width).alias("w"), (h / height).alias("h"))


def from_drone_csv(lines: DataFrame, images: DataFrame) -> DataFrame:
    """Lines left, top, width, height, score, class (from 1); score 0 marks ignored regions."""
    p = F.split("value", ",")
    rows = lines.withColumn("p", p).filter(F.col("p")[4] != "0").join(images, "image_id")
    x, y, w, h = (F.col("p")[i].cast("int") for i in range(4))
    return rows.select("image_id", (F.col("p")[5].cast("int") - 1).alias("cls"),
                       *[F.round(c, 6).alias(n) for n, c in zip("xywh", (
                           (x + w / 2) / F.col("width"), (y + h / 2) / F.col("height"), w / F.col("width"), h / F.col("height")))])


# Class index of the overhead-imagery type ids 0 to 94; -1 is not used.
OVERHEAD_CLASSES = [
    -1, -1, -1, -1, -1, -1, -1, -1, -1, -1, -1, 0, 1, 2, -1, 3, -1, 4, 5, 6, 7, 8, -1, 9, 10, 11,
    12, 13, 14, 15, -1, -1, 16, 17, 18, 19, 20, 21, 22, -1, 23, 24, 25, -1, 26, 27, -1, 28, -1,
    29, 30, 31, 32, 33, 34, 35, 36, 37, -1, 38, 39, 40, 41, 42, 43, 44, 45, -1, -1, -1, -1, 46,
    47, 48, 49, -1, 50, 51, -1, 52, -1, -1, -1, 53, 54, -1, 55, -1, -1, 56, -1, 57, -1, 58, 59,
]


def from_overhead_geojson(features: DataFrame, images: DataFrame) -> DataFrame:
    """Features (image_id, type_id, bounds 'x1,y1,x2,y2'); unusable bounds or types are skipped."""
    b = F.transform(F.split("bounds", ","), lambda v: v.try_cast("int"))
    ok = features.withColumn("b", b).filter((F.size("b") == 4) & ~F.exists("b", lambda v: v.isNull()))
    rows = remap(ok.withColumn("cls", F.col("type_id").cast("int")), dict(enumerate(OVERHEAD_CLASSES))).join(images, "image_id")
    box = B.normalise(*[F.col("b")[i].cast("double") for i in range(4)], F.col("width"), F.col("height"), do_clip=True)
    return rows.select("image_id", "cls", *[F.round(c, 6).alias(n) for n, c in zip("xywh", box)])


def from_shelf_csv(rows: DataFrame) -> DataFrame:
    """Rows image, x1, y1, x2, y2, class, image_width, image_height; everything is class 0."""
    w, h = F.col("image_width"), F.col("image_height")
    box = B.to_centre(F.col("x1") / w, F.col("y1") / h, F.col("x2") / w, F.col("y2") / h)
    return rows.select(F.col("image").alias("image_id"), F.lit(0).alias("cls"), *[F.round(c, 5).alias(n) for n, c in zip("xywh", box)])


CONVERTERS = {
    "voc": from_voc, "detection_json": from_detection_json, "fixed_frame": from_fixed_frame, "drone_csv": from_drone_csv,
    "overhead_geojson": from_overhead_geojson, "shelf_csv": from_shelf_csv,
}


def convert_annotations(df: DataFrame, fmt: str, *tables, **options) -> DataFrame:
    """Any supported format to (image_id, cls, x, y, w, h)."""
    if fmt not in CONVERTERS:
        raise ValueError(f"unknown format {fmt}; choose one of {sorted(CONVERTERS)}")
    return CONVERTERS[fmt](df, *tables, **options)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Metric history CSV whose header names are padded with blanks."""
    df = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    named = df.toDF(*[c.strip() for c in df.columns])
    return named.select(*[F.col(f"`{c}`").try_cast("double").alias(c) for c in named.columns])
