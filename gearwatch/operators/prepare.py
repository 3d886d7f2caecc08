"""Imputation, scaling, encoding, class weights and oversampling."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from gearwatch.operators import vectors
from gearwatch.operators.prefix import quantiles
from gearwatch.operators.series import numbered


def _row_of(stats: DataFrame, columns: Sequence[str], value: str) -> Column:
    """One struct (a field per sensor) out of a long (sensor, value) table, as a scalar subquery."""
    return stats.agg(
        F.struct(*[F.max(F.when(F.col("sensor") == c, F.col(value))).alias(c) for c in columns]).alias("s")
    ).scalar()


def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "sensor", "value")


def fill_mean(df: DataFrame, columns: Sequence[str], fitted_on: DataFrame | None = None) -> DataFrame:
    """Nulls become the mean of the training rows."""
    s = (fitted_on or df).agg(F.struct(*[F.avg(c).alias(c) for c in columns]).alias("s")).scalar()
    return df.withColumn("_s", s).withColumns({c: F.coalesce(F.col(c), F.col("_s")[c]) for c in columns}).drop("_s")


def fill_median(df: DataFrame, columns: Sequence[str], fitted_on: DataFrame | None = None, exact: bool = True) -> DataFrame:
    """Nulls become the median."""
    q = quantiles(_long(fitted_on or df, columns), "value", {"m": 0.5}, ["sensor"], exact)
    return df.withColumn("_s", _row_of(q, columns, "m")).withColumns(
        {c: F.coalesce(F.col(c), F.col("_s")[c]) for c in columns}).drop("_s")


def fill_mode(df: DataFrame, columns: Sequence[str], fitted_on: DataFrame | None = None) -> DataFrame:
    """I4: nulls become the most frequent value, the smallest one on ties."""
    base = fitted_on or df
    for c in columns:
        mode = base.filter(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(1).select(c).scalar()
        df = df.withColumn(c, F.coalesce(F.col(c), mode))
    return df


def scale(df: DataFrame, columns: Sequence[str], kind: str = "standard", fitted_on: DataFrame | None = None, exact: bool = True) -> DataFrame:
    """Standard (population deviation), robust (median and interquartile range) or min-max scaling.

    A column without spread keeps a divisor of one.
    """
    base = fitted_on or df
    if kind == "robust":
        q = quantiles(_long(base, columns), "value", {"q1": 0.25, "m": 0.5, "q3": 0.75}, ["sensor"], exact)
        centre, spread = _row_of(q, columns, "m"), _row_of(q.withColumn("iqr", F.col("q3") - F.col("q1")), columns, "iqr")
    else:
        pair = {"standard": lambda c: (F.avg(c), F.stddev_pop(c)), "minmax": lambda c: (F.min(c), F.max(c) - F.min(c))}
        if kind not in pair:
            raise ValueError("kind must be standard, robust or minmax")
        centre = base.agg(F.struct(*[pair[kind](c)[0].alias(c) for c in columns]).alias("s")).scalar()
        spread = base.agg(F.struct(*[pair[kind](c)[1].alias(c) for c in columns]).alias("s")).scalar()
    out = df.withColumns({"_c": centre, "_d": spread})
    cols = {c: (F.col(c) - F.col("_c")[c]) / F.coalesce(F.nullif(F.col("_d")[c], F.lit(0.0)), F.lit(1.0)) for c in columns}
    return out.withColumns(cols).drop("_c", "_d")


def one_hot(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """One 0/1 column per known value; an unknown value gives zeros everywhere."""
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values})


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """Code of each value in sorted order, null as the text ``nan``."""
    named = df.withColumn(column, F.coalesce(F.col(column).cast("string"), F.lit("nan")))
    codes = numbered(named.select(column).distinct(), [column], "_code")
    return named.join(codes, column).withColumn(f"{column}_code", (F.col("_code") - 1).cast("int")).drop("_code")


def class_weight(df: DataFrame, label: str = "y") -> DataFrame:
    """I8: balanced weight n / (2 n_c) per row."""
    n = df.agg(F.struct(F.count("*").alias("n"), F.sum(label).alias("pos")).alias("s")).scalar()
    size = F.when(F.col(label) == 1, F.col("_s")["pos"]).otherwise(F.col("_s")["n"] - F.col("_s")["pos"])
    return df.withColumn("_s", n).withColumn("weight", F.col("_s")["n"] / (2.0 * size)).drop("_s")


def neighbours(df: DataFrame, features: Sequence[str], key: str, k: int = 5) -> DataFrame:
    """k nearest rows of each row by Euclidean distance, as (key, rank, neighbour).

    Exact at every size: by strips for few features (``near_rows``), else blocks of rows meet every slice. Smaller keys come first at equal
    distance; a row with a null feature is no one's neighbour.
    """
    vec = F.array(*[F.col(f).cast("double") for f in features])
    rows = df.dropna(subset=list(features)).select(F.col(key).alias("id"), vec.alias("v"))
    return near_rows(rows, k, len(features)).select(F.col("q").alias(key), "rank", F.col("id").alias("neighbour"))


#: Widest vectors whose neighbours are looked for by strips: each further number makes the bound reach more of them.
STRIP_WIDTH = 3


def near_rows(rows: DataFrame, k: int, width: int | None = None) -> DataFrame:
    """(q, id, score, rank): the ``k`` nearest other rows of each of ``rows`` (id, v), whose vectors hold ``width`` numbers."""
    if width and width <= STRIP_WIDTH:
        return vectors.near_in_strips(rows, k)
    return vectors.search(rows, rows.withColumnRenamed("id", "q"), k, metric="euclid", exclude_self=True)


def oversample(df: DataFrame, features: Sequence[str], key: str, label: str = "y", k: int = 5, seed: int = 42) -> DataFrame:
    """New minority rows between a row and one of its k neighbours until both classes are equal in size.

    Which neighbour and how far along the line come from a hash of (row, copy, seed), so reruns agree. Returns
    (key, features, label, synthetic) with the given rows first class citizens and synthetic rows keyed by their origin.
    """
    given = df.select(key, *[F.col(f).cast("double").alias(f) for f in features], label)
    rows = given.select(F.col(key).alias("id"), F.array(*features).alias("v"), F.col(label).alias("y"))
    made = between_neighbours(rows, k, seed, len(features)).select(
        F.col("id").alias(key), *[F.col("v")[i].alias(f) for i, f in enumerate(features)], F.col("y").alias(label), F.lit(True).alias("synthetic"))
    return given.withColumn("synthetic", F.lit(False)).unionByName(made)


def smallest_hashes(rows: DataFrame, n: int, seed: int, cells: int = 4096) -> Column:
    """Whether a row is one of the ``n`` with the smallest hashes of its ``id``, without sorting all rows: counts of ``cells``
    cells tell in which of them the border lies, and only its rows are ranked."""
    draw = F.xxhash64("id", F.lit(seed))
    cell = F.pmod(draw, F.lit(cells))
    sizes = {r["c"]: r["count"] for r in rows.groupBy(cell.alias("c")).count().collect()} if n else {}
    border, left = -1, n
    for border in sorted(sizes):
        if sizes[border] > left:
            break
        left -= sizes[border]
    place = F.struct(draw.alias("d"), F.col("id").alias("id"))
    edge = rows.filter(cell == border).select(place.alias("e")).orderBy("e").offset(left).limit(1).select("e").scalar()
    return F.coalesce((cell < border) | ((cell == border) & (place < edge)), F.lit(False))


def between_neighbours(rows: DataFrame, k: int = 5, seed: int = 42, width: int | None = None) -> DataFrame:
    """The synthetic rows (id, v, y) that make both classes of ``rows`` (id, v, y) equal in size; ``id`` is the origin."""
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(counts) != 2:
        raise ValueError("oversampling needs two classes")
    minority = min(counts, key=lambda c: (counts[c], c))
    few, many = counts[minority], max(counts.values())
    small = rows.filter(F.col("y") == minority)
    each, extra = divmod(many - few, few)
    copies = small.withColumn("_n", F.lit(each) + smallest_hashes(small, extra, seed + 2).cast("int")).filter(F.col("_n") > 0)
    made = copies.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    if few == 1:
        return made.select("id", "v", "y")  # without a neighbour a copy is all there can be
    widest = F.lit(min(k, few - 1))
    made = made.withColumns({
        "rank": (F.pmod(F.xxhash64("id", "_copy", F.lit(seed)), widest) + 1).cast("int"),
        "_u": F.pmod(F.xxhash64("id", "_copy", F.lit(seed + 1)), F.lit(1 << 30)) / F.lit(float(1 << 30)),
    })
    near = near_rows(small, k, width).select(F.col("q").alias("id"), "rank", F.col("id").alias("_other"))
    other = small.select(F.col("id").alias("_other"), F.col("v").alias("_to"))
    mixed = made.join(near, ["id", "rank"]).join(other, "_other")
    line = F.zip_with("v", "_to", lambda a, b: a + F.col("_u") * (b - a))
    return mixed.select("id", line.alias("v"), "y")


def principal_components(df: DataFrame, features: Sequence[str], k: int = 3) -> DataFrame:
    """Centred projection on k principal components (pc1..pck); nulls count as zero, no scaling.

    The sign of a component is fixed by making its largest loading positive.
    """
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    filled = df.fillna(0.0, list(features))
    data = VectorAssembler(inputCols=list(features), outputCol="_v").transform(filled)
    centred = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(data).transform(data)
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(centred)
    loads = model.pc.toArray()
    signs = [1.0 if loads[np.abs(loads[:, i]).argmax(), i] >= 0 else -1.0 for i in range(k)]
    out = model.transform(centred).withColumn("_p", vector_to_array("_p"))
    return out.withColumns({f"pc{i + 1}": F.col("_p")[i] * signs[i] for i in range(k)}).drop("_v", "_c", "_p")
