"""Windows over machine time series: row features, running fills, last-N buffers.

The usual layout is one hash exchange on the machine key. When one machine holds more than ``HOT_ROWS`` rows the
series is range-partitioned on (key, order) instead, so a single machine spreads over many blocks; each block then
receives the rows (or the running values) it needs from the blocks before it. Both layouts give the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gearwatch import schemas as S
from gearwatch.session import materialise

BLOCK = "_block"
HALO = "_halo"
HOT_ROWS = 4_000_000
#: Rows that one task numbers.
NUMBERED_ROWS = 500_000
HOUR = 3_600_000_000


def micros(col: str | Column) -> Column:
    """Microseconds since the epoch of a timestamp column, as a long."""
    return F.unix_micros(F.col(col) if isinstance(col, str) else col)


def has_hot_key(df: DataFrame, key: Sequence[str], hot_rows: int | None = HOT_ROWS) -> bool:
    """True when some key owns more than ``hot_rows`` rows (one column scan, combined before the shuffle)."""
    if hot_rows is None:
        return False
    top = df.groupBy(*key).count().agg(F.max("count")).first()[0]
    return (top or 0) > hot_rows


def split_blocks(df: DataFrame, key: Sequence[str], order: Sequence[str], rows: int) -> DataFrame:
    """Range-partition on (key, order) and store the block number with each row.

    The block number is written to the shared folder, so a lost executor can never change it.
    """
    blocks = max(1, math.ceil(df.count() / max(rows, 1)))
    ranged = df.repartitionByRange(blocks, *key, *order).withColumn(BLOCK, F.spark_partition_id())
    return materialise(ranged, "blocks")


def add_halo(blocked: DataFrame, key: Sequence[str], order: Sequence[str], depth: int) -> DataFrame:
    """Give every block the ``depth`` rows of the same key that come before it, marked by ``_halo``.

    Only block tails travel. Looking back over ``depth`` non-empty blocks always reaches ``depth`` rows.
    """
    rest = [c for c in blocked.columns if c not in {*key, BLOCK, *order}]
    newest = W.partitionBy(*key, BLOCK).orderBy(*[F.desc(c) for c in order])
    before = W.partitionBy(*key).orderBy(BLOCK).rowsBetween(-depth, -1)
    tails = (
        blocked.withColumn("_rn", F.row_number().over(newest))
        .filter(F.col("_rn") <= depth)
        .groupBy(*key, BLOCK)
        .agg(F.sort_array(F.collect_list(F.struct(*order, *rest))).alias("_tail"))
    )
    halo = (
        tails.withColumn("_prev", F.flatten(F.collect_list("_tail").over(before)))
        .withColumn("_row", F.explode(F.expr(f"slice(_prev, greatest(size(_prev) - {depth - 1}, 1), {depth})")))
        .select(*key, BLOCK, *[F.col(f"_row.`{c}`").alias(c) for c in (*order, *rest)], F.lit(True).alias(HALO))
    )
    return blocked.withColumn(HALO, F.lit(False)).unionByName(halo)


def over_rows(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    depth: int,
    build: Callable[[DataFrame, W], DataFrame],
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Add window columns that look back at most ``depth`` rows; ``build`` gets the rows and the window."""
    if not has_hot_key(df, key, hot_rows):
        return build(df, W.partitionBy(*key).orderBy(*order))
    padded = add_halo(split_blocks(df, key, order, hot_rows), key, order, depth)
    return build(padded, W.partitionBy(*key, BLOCK).orderBy(*order)).filter(~F.col(HALO)).drop(HALO, BLOCK)


def running_fill(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    back: dict[str, str] | None = None,
    ahead: dict[str, str] | None = None,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Latest non-null value at or before each row (``back``) and next one at or after it (``ahead``).

    ``back`` and ``ahead`` map new column -> source column. Look-ahead sorts descending, because a frame that
    only grows is linear while an ascending frame to the end is recomputed for every row.
    """
    back, ahead = back or {}, ahead or {}
    hot = has_hot_key(df, key, hot_rows)
    rows = split_blocks(df, key, order, hot_rows) if hot else df
    part = [*key, BLOCK] if hot else list(key)
    up = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(*part).orderBy(*[F.desc(c) for c in order]).rowsBetween(W.unboundedPreceding, 0)
    out = rows.select(
        "*",
        *[F.last(src, ignorenulls=True).over(up).alias(dst) for dst, src in back.items()],
        *[F.last(src, ignorenulls=True).over(down).alias(dst) for dst, src in ahead.items()],
    )
    if not hot:
        return out

    def known(src: str) -> Column:
        return F.when(F.col(src).isNotNull(), F.struct(*order))

    edges = rows.groupBy(*part).agg(
        *[F.max_by(src, known(src)).alias(dst) for dst, src in back.items()],
        *[F.min_by(src, known(src)).alias(dst) for dst, src in ahead.items()],
    )
    earlier = W.partitionBy(*key).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy(*key).orderBy(F.desc(BLOCK)).rowsBetween(W.unboundedPreceding, -1)
    carried = edges.select(
        *part,
        *[F.last(d, ignorenulls=True).over(earlier).alias(f"_in_{d}") for d in back],
        *[F.last(d, ignorenulls=True).over(later).alias(f"_in_{d}") for d in ahead],
    )
    filled = {d: F.coalesce(F.col(d), F.col(f"_in_{d}")) for d in (*back, *ahead)}
    return (
        out.join(carried, part, "left").withColumns(filled).drop(BLOCK, *[f"_in_{d}" for d in (*back, *ahead)])
    )


def add_features(
    df: DataFrame,
    window: W,
    sensors: Sequence[str],
    lags: Sequence[int] = S.LAGS,
    means: Sequence[int] = S.ROLL_MEANS,
    stds: Sequence[int] = S.ROLL_STDS,
    slopes: Sequence[int] = S.SLOPES,
) -> DataFrame:
    """Lag, rolling mean, rolling population std and slope per sensor (all in rows).

    A rolling value needs k non-null readings in its k-row frame, else it is null. A sliding frame would be read
    again for every row, so the windows grow by doubling: mean and squared deviation of k rows come from those of the
    last k/2 rows and of the k/2 rows before them (a lag). Merging keeps deviations from the mean, so nothing
    cancels, and a missing value or row makes the result null by itself. All steps share one sort.
    """
    sizes = sorted({*means, *stds})
    chain = _doubling(sizes)
    short = [k for k in chain if k // 2 not in chain or k % 2]
    reach = sorted({*lags, *slopes, *range(1, max(short, default=1))})
    out = df.select("*", *[F.lag(s, k).over(window).alias(f"_{s}_l{k}") for s in sensors for k in reach])
    cols = []
    for s in sensors:
        for k in short:
            rows = [F.col(s).cast("double"), *[F.col(f"_{s}_l{i}") for i in range(1, k)]]
            mean = sum(rows[1:], rows[0]) / k
            dev = [(x - mean) * (x - mean) for x in rows]
            cols += [mean.alias(f"_{s}_m{k}"), sum(dev[1:], dev[0]).alias(f"_{s}_d{k}")]
    out = out.select("*", *cols)
    for k in [k for k in chain if k not in short]:
        h = k // 2
        out = out.select("*", *[F.lag(f"_{s}_{v}{h}", h).over(window).alias(f"_{s}_p{v}") for s in sensors for v in "md"])
        merged = []
        for s in sensors:
            m, pm, d, pd_ = (F.col(f"_{s}_{v}") for v in (f"m{h}", "pm", f"d{h}", "pd"))
            merged += [((m + pm) / 2).alias(f"_{s}_m{k}"), (d + pd_ + (m - pm) * (m - pm) * (h / 2)).alias(f"_{s}_d{k}")]
        out = out.select("*", *merged).drop(*[f"_{s}_p{v}" for s in sensors for v in "md"])
    final = []
    for s in sensors:
        final += [F.col(f"_{s}_l{k}").alias(f"{s}_lag_{k}h") for k in lags]
        for k in means:
            frame = window.rowsBetween(-(k - 1), 0)
            slow = F.when(F.count(s).over(frame) == k, F.avg(s).over(frame))
            final.append((F.col(f"_{s}_m{k}") if k in chain else slow).alias(f"{s}_mean_{k}h"))
        for k in stds:
            frame = window.rowsBetween(-(k - 1), 0)
            slow = F.when(F.count(s).over(frame) == k, F.stddev_pop(s).over(frame))
            final.append((F.sqrt(F.col(f"_{s}_d{k}") / k) if k in chain else slow).alias(f"{s}_std_{k}h"))
        final += [((F.col(s) - F.col(f"_{s}_l{k}")) / F.lit(k)).alias(f"{s}_slope_{k}h") for k in slopes]
    return out.select(*df.columns, *final)


def _doubling(sizes: Sequence[int]) -> list[int]:
    """Sizes reachable from a short window by doubling, with the halves they need; others keep a sliding frame."""
    chain: set[int] = set()
    for k in sizes:
        path = [k]
        while path[-1] > 3 and path[-1] % 2 == 0:
            path.append(path[-1] // 2)
        if path[-1] <= 7:
            chain.update(path)
    return sorted(chain)


def max_depth(lags=S.LAGS, means=S.ROLL_MEANS, stds=S.ROLL_STDS, slopes=S.SLOPES) -> int:
    """Rows of history the widest feature needs."""
    return max([0, *lags, *slopes, *[k - 1 for k in (*means, *stds)]])


def sensor_features(
    df: DataFrame,
    sensors: Sequence[str] = S.SENSORS,
    key: Sequence[str] = ("machineID",),
    order: Sequence[str] = ("datetime",),
    hot_rows: int | None = HOT_ROWS,
    **sizes: Sequence[int],
) -> DataFrame:
    """E1-E4 for all sensors over one exchange and one sort."""
    return over_rows(df, key, order, max_depth(**sizes), lambda rows, w: add_features(rows, w, sensors, **sizes), hot_rows)


def time_features(
    df: DataFrame,
    sensors: Sequence[str],
    hours: Sequence[int] = S.ROLL_MEANS,
    key: Sequence[str] = ("machineID",),
    ts: str = "datetime",
    bucket_hours: int = 24 * 7,
) -> DataFrame:
    """Gap-safe features over hours instead of rows.

    Mean and std cover (t - k h, t]; the lag is the newest reading in [t - 2k h, t - k h]. The series is cut into
    time buckets and each row is also sent to the following bucket when it is within reach of it, so one busy
    machine never forms one partition.
    """
    reach = 2 * max(hours) * HOUR
    width = max(bucket_hours * HOUR, reach)
    t = F.col("_t")
    first, last = F.floor(t / width), F.floor((t + reach) / width)
    spread = (
        df.withColumn("_t", micros(ts))
        .withColumn("_own", F.floor(F.col("_t") / width))
        .withColumn("_bucket", F.explode(F.sequence(first, last)))
    )
    base = W.partitionBy(*key, "_bucket").orderBy("_t")
    cols = []
    for s in sensors:
        for k in hours:
            frame = base.rangeBetween(-k * HOUR + 1, 0)
            cols += [F.avg(s).over(frame).alias(f"{s}_tmean_{k}h"), F.stddev_pop(s).over(frame).alias(f"{s}_tstd_{k}h")]
            ago = base.rangeBetween(-2 * k * HOUR, -k * HOUR)
            cols.append(F.max_by(s, "_t").over(ago).alias(f"{s}_tlag_{k}h"))
    return spread.select("*", *cols).filter(F.col("_own") == F.col("_bucket")).drop("_t", "_own", "_bucket")


def ols_slopes(
    df: DataFrame,
    sensors: Sequence[str],
    ks: Sequence[int] = S.SLOPES,
    key: Sequence[str] = ("machineID",),
    order: Sequence[str] = ("datetime",),
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """E5: least-squares slope over the k rows before the current one (null until k rows exist).

    With x = 0..k-1 the slope is a weighted sum of the lags, so no row number is needed.
    """

    def build(rows: DataFrame, w: W) -> DataFrame:
        cols = []
        for s in sensors:
            for k in ks:
                centre, total = (k - 1) / 2, k * (k * k - 1) / 12
                terms = [F.lag(s, k - i).over(w) * F.lit((i - centre) / total) for i in range(k)]
                cols.append(sum(terms[1:], terms[0]).alias(f"{s}_ols_{k}h"))
        return rows.select("*", *cols)

    return over_rows(df, key, order, max(ks), build, hot_rows)


def step_delta(df, sensors, key=("machineID",), order=("datetime",), hot_rows=HOT_ROWS) -> DataFrame:
    """Change of each sensor since the previous reading of the machine."""
    return over_rows(
        df, key, order, 1,
        lambda rows, w: rows.select("*", *[(F.col(s) - F.lag(s, 1).over(w)).alias(f"{s}_delta") for s in sensors]), hot_rows
    )


def fill_gaps(
    df: DataFrame,
    sensors: Sequence[str],
    limit: int = 5,
    key: Sequence[str] = ("machineID",),
    order: Sequence[str] = ("datetime",),
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Carry the last value forward up to ``limit`` rows, then interpolate by row, then use the mean.

    Gaps longer than ``limit`` are interpolated between the last carried row and the next known value; what is
    still open (a series that starts with a gap, or ends with a long one) takes the sensor mean.
    """
    key, order = list(key), list(order)
    numbered = row_positions(df, key, order, "_pos", hot_rows)
    for s in sensors:
        numbered = numbered.withColumn(f"_k_{s}", F.when(F.col(s).isNotNull(), F.struct(F.col("_pos"), F.col(s).alias("v"))))
    near = running_fill(
        numbered,
        key,
        ["_pos"],
        back={f"_b_{s}": f"_k_{s}" for s in sensors},
        ahead={f"_a_{s}": f"_k_{s}" for s in sensors},
        hot_rows=hot_rows,
    )
    means = df.agg(F.struct(*[F.avg(s).alias(s) for s in sensors]).alias("m")).scalar()
    cols = {}
    for s in sensors:
        prev, nxt = F.col(f"_b_{s}"), F.col(f"_a_{s}")
        start = prev["_pos"] + F.lit(limit)
        line = prev["v"] + (nxt["v"] - prev["v"]) * (F.col("_pos") - start) / (nxt["_pos"] - start)
        carried = F.when(F.col("_pos") - prev["_pos"] <= limit, prev["v"])
        cols[s] = F.coalesce(F.col(s), carried, line, F.when(nxt.isNull(), prev["v"]), means[s])
    return near.withColumns(cols).drop("_pos", *[f"_{p}_{s}" for s in sensors for p in "kba"])


def numbered(df: DataFrame, order: Sequence[str], name: str = "_pos", rows: int = NUMBERED_ROWS) -> DataFrame:
    """1-based position of each row of a whole table: ranges of ``order`` are numbered by a task each and get the rows before them.

    ``order`` tells all rows apart. Only the counts of the ranges, one row each, meet in one task.
    """
    blocked = split_blocks(df, [], order, rows)
    earlier = W.orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    offsets = blocked.groupBy(BLOCK).count().select(BLOCK, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_offset"))
    local = blocked.withColumn("_local", F.row_number().over(W.partitionBy(BLOCK).orderBy(*order)))
    return local.join(offsets, BLOCK).withColumn(name, F.col("_offset") + F.col("_local")).drop("_local", "_offset", BLOCK)


def row_positions(df, key, order, name="_pos", hot_rows=HOT_ROWS) -> DataFrame:
    """1-based position of each row inside its key, also when a key spans several blocks."""
    key, order = list(key), list(order)
    if not has_hot_key(df, key, hot_rows):
        return df.withColumn(name, F.row_number().over(W.partitionBy(*key).orderBy(*order)).cast("long"))
    blocked = split_blocks(df, key, order, hot_rows)
    earlier = W.partitionBy(*key).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    offsets = blocked.groupBy(*key, BLOCK).count().select(
        *key, BLOCK, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_offset")
    )
    local = F.row_number().over(W.partitionBy(*key, BLOCK).orderBy(*order))
    return (
        blocked.withColumn("_local", local)
        .join(offsets, [*key, BLOCK])
        .withColumn(name, F.col("_offset") + F.col("_local"))
        .drop("_local", "_offset", BLOCK)
    )


def last_n(df: DataFrame, n: int, key: Sequence[str] = ("machineID",), order: Sequence[str] = ("datetime",)) -> DataFrame:
    """The newest ``n`` rows per key; Spark keeps n rows per key before the shuffle."""
    newest = W.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= n).drop("_rn")


def latest(df: DataFrame, key: Sequence[str] = ("machineID",), order: Sequence[str] = ("datetime",)) -> DataFrame:
    """The newest row per key as a plain aggregate, combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*key).agg(best).select(*key, "_row.*").select(*df.columns)


def cold_start(df: DataFrame, sensors: Sequence[str] = S.SENSORS) -> DataFrame:
    """E7 + E8: features of a reading without history.

    Repeating one value makes every lag and mean equal to it, and every std and slope zero.
    """
    cols = {}
    for s in sensors:
        cols |= {f"{s}_lag_{k}h": F.col(s) for k in S.LAGS}
        cols |= {f"{s}_mean_{k}h": F.col(s) for k in S.ROLL_MEANS}
        cols |= {f"{s}_std_{k}h": F.lit(0.0) for k in S.ROLL_STDS}
        cols |= {f"{s}_slope_{k}h": F.lit(0.0) for k in S.SLOPES}
    return assume_healthy(df.withColumns(cols))


def assume_healthy(df: DataFrame, errors: Sequence[str] = S.ERROR_TYPES, comps: Sequence[str] = S.COMPONENTS) -> DataFrame:
    """Fixed history for serving: no recent errors, last maintenance 48 h ago."""
    flags = {f"{e}_last_{h}h": F.lit(0) for e in errors for h in S.HORIZONS}
    ages = {f"time_since_maint_{c}_h": F.lit(48.0) for c in comps} | {f"time_since_maint_{c}_d": F.lit(2.0) for c in comps}
    return df.withColumns(flags | ages)
