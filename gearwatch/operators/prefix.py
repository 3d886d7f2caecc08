"""Running totals, exact quantiles and histograms that never sort a whole table in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from gearwatch.operators.series import BLOCK, split_blocks
from gearwatch.session import materialise

#: Rows of different values that one task adds up.
RANGE_ROWS = 500_000


def prefix_sums(
    df: DataFrame, order: str, sums: Sequence[str], by: Sequence[str] = (), rows: int = RANGE_ROWS
) -> DataFrame:
    """Add ``cum_<c>``, the running total of each column in ascending ``order`` inside ``by``, and ``all_<c>``, its total.

    ``df`` must hold one row per (by, order), so equal values are already combined and no range can be made of one
    repeated value. It is computed once and written, cut into ranges of about ``rows`` rows, and added up inside each
    range; the totals of the ranges, a few rows each, give what lies before. The number of ranges follows the data.
    """
    by = list(by)
    blocked = split_blocks(materialise(df, "prefix"), by, [order], rows)
    totals = blocked.groupBy(*by, BLOCK).agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    group = W.partitionBy(*by).orderBy(BLOCK)
    earlier, whole = group.rowsBetween(W.unboundedPreceding, -1), group.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    starts = totals.select(
        *[F.col(c).alias(f"_k_{c}") for c in (*by, BLOCK)],
        *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_s_{c}") for c in sums],
        *[F.sum(f"_t_{c}").over(whole).alias(f"all_{c}") for c in sums],
    )
    inside = W.partitionBy(*by, BLOCK).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in (*by, BLOCK)])
    return (
        blocked.withColumns({f"_l_{c}": F.sum(c).over(inside) for c in sums})
        .join(starts, same)
        .withColumns({f"cum_{c}": F.col(f"_s_{c}") + F.col(f"_l_{c}") for c in sums})
        .drop(BLOCK, *[f"_k_{c}" for c in (*by, BLOCK)], *[f"_{p}_{c}" for p in "sl" for c in sums])
    )


def quantiles(
    df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = (), exact: bool = True
) -> DataFrame:
    """Quantiles with linear interpolation, one row per ``by`` group and one column per entry of ``probs``.

    The exact form counts equal values first and picks order statistics from running counts, so no task ever
    holds all values of a group. ``exact=False`` uses the built-in sketch.
    """
    by = list(by)
    known = df.filter(F.col(value).isNotNull())
    if not exact:
        return known.groupBy(*by).agg(*[F.percentile_approx(value, p, 10_000).alias(n) for n, p in probs.items()])
    counts = known.groupBy(*by, value).agg(F.count("*").alias("n"))
    ranked = prefix_sums(counts, value, ["n"], by).withColumnRenamed("all_n", "_total")
    picks, finals = [], []
    for name, p in probs.items():
        rank = F.lit(p) * (F.col("_total") - 1)
        low = F.floor(rank)
        high = F.least(low + 1, F.col("_total") - 1)
        picks += [
            F.min(F.when(F.col("cum_n") > low, F.col(value))).alias(f"_lo_{name}"),
            F.min(F.when(F.col("cum_n") > high, F.col(value))).alias(f"_hi_{name}"),
            F.max(rank - low).alias(f"_fr_{name}"),
        ]
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        finals.append((lo + (hi - lo) * F.col(f"_fr_{name}")).alias(name))
    return ranked.groupBy(*by).agg(*picks).select(*by, *finals)


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins over [min, max], the last bin closed on the right, empty bins kept.

    Returns (bin, lo, hi, n). A constant column widens its range by half on both sides.
    """
    x = F.col(value).cast("double")
    known = df.select(x.alias("_x")).filter(F.col("_x").isNotNull())
    edges = known.agg(F.struct(F.min("_x").alias("lo"), F.max("_x").alias("hi")).alias("e"))
    flat = F.col("e")["lo"] == F.col("e")["hi"]
    span = edges.select(
        F.struct(
            (F.col("e")["lo"] - F.when(flat, 0.5).otherwise(0.0)).alias("lo"),
            (F.col("e")["hi"] + F.when(flat, 0.5).otherwise(0.0)).alias("hi"),
        ).alias("e")
    )
    e = span.scalar()
    counts = (
        known.withColumn("_e", e)
        .select(
            F.least(
                F.floor((F.col("_x") - F.col("_e")["lo"]) / ((F.col("_e")["hi"] - F.col("_e")["lo"]) / bins)),
                F.lit(bins - 1),
            ).cast("int").alias("bin")
        )
        .groupBy("bin")
        .agg(F.count("*").alias("n"))
    )
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).withColumn("_e", span.scalar())
    step = (F.col("_e")["hi"] - F.col("_e")["lo"]) / bins
    return spine.join(counts, "bin", "left").select(
        "bin",
        (F.col("_e")["lo"] + F.col("bin") * step).alias("lo"),
        (F.col("_e")["lo"] + (F.col("bin") + 1) * step).alias("hi"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def histogram_2d(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """2-D equal-width counts (bx, by, n) of non-empty cells."""
    known = df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna()
    e = known.agg(
        F.struct(*[f(c).alias(f"{n}{c}") for c in ("_x", "_y") for n, f in (("lo", F.min), ("hi", F.max))]).alias("e")
    ).scalar()

    def cell(c: str):
        lo, hi = F.col("_e")[f"lo{c}"], F.col("_e")[f"hi{c}"]
        return F.least(F.floor((F.col(c) - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")

    return known.withColumn("_e", e).groupBy(cell("_x").alias("bx"), cell("_y").alias("by")).agg(F.count("*").alias("n"))
