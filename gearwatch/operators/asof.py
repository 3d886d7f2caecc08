"""Joins between readings and event logs: failure horizons, error flags, maintenance ages, general as-of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gearwatch import schemas as S
from gearwatch.operators.series import HOT_ROWS, HOUR, micros, running_fill

# Position of a row among rows of the same instant: past events, the reading itself, future events.
PAST, READING, FUTURE = 0, 1, 2


def with_machines(telemetry: DataFrame, machines: DataFrame, key: str = "machineID") -> DataFrame:
    """Left join of machine metadata. The optimizer broadcasts ``machines`` when its size allows."""
    return telemetry.join(machines, key, "left")


def duplicate_keys(df: DataFrame, key: str = "machineID") -> DataFrame:
    """Keys that would fan out a lookup join (empty when the table is a proper dimension)."""
    return df.groupBy(key).count().filter(F.col("count") > 1)


def _events(df: DataFrame, key: str, ts: str, kind: int, label: str | None) -> DataFrame:
    name = F.col(label).cast("string") if label else F.lit(None).cast("string")
    return df.select(key, micros(ts).alias("_t"), F.lit(kind).alias("_kind"), name.alias("_type"))


def stack_events(readings, key, ts, errors=None, maint=None, failures=None, errors_col="errorID", maint_col="comp"):
    """Union of readings and event logs with a shared clock; readings keep all their columns."""
    rows = readings.withColumns(
        {"_t": micros(ts), "_kind": F.lit(READING), "_type": F.lit(None).cast("string"), "_log": F.lit("reading")}
    )
    for log, df, kind, label in (
        ("error", errors, PAST, errors_col), ("maint", maint, PAST, maint_col), ("failure", failures, FUTURE, None),
    ):
        if df is not None:
            events = _events(df, key, ts, kind, label).withColumn("_log", F.lit(log))
            rows = rows.unionByName(events, allowMissingColumns=True)
    return rows


def event_columns(rows: DataFrame, error_types: Sequence[str], comps: Sequence[str]) -> DataFrame:
    """One clock column per event type, null on other rows."""
    t, kind, log = F.col("_t"), F.col("_type"), F.col("_log")
    cols = {f"_e_{e}": F.when((log == "error") & (kind == e), t) for e in error_types}
    cols |= {f"_m_{c}": F.when((log == "maint") & (kind == c), t) for c in comps}
    return rows.withColumns(cols | {"_f": F.when(log == "failure", t)})


def history_exprs(error_types, comps, horizons=S.HORIZONS, failures: bool = True) -> dict[str, Column]:
    """C2-C4 outputs from the filled clock columns (compared in microseconds, both interval ends inclusive)."""
    t = F.col("_t")
    cols = {}
    if failures:
        for h in horizons:
            cols[f"will_fail_in_{h}h"] = F.coalesce((F.col("_next_f") - t <= h * HOUR).cast("int"), F.lit(0))
    for e in error_types:
        for h in horizons:
            cols[f"{e}_last_{h}h"] = F.coalesce((t - F.col(f"_last_e_{e}") <= h * HOUR).cast("int"), F.lit(0))
    for c in comps:
        age = (t - F.col(f"_last_m_{c}")) / F.lit(float(HOUR))
        cols |= {f"time_since_maint_{c}_h": age, f"time_since_maint_{c}_d": age / F.lit(24.0)}
    return cols


def add_history(
    telemetry: DataFrame,
    errors: DataFrame | None = None,
    maint: DataFrame | None = None,
    failures: DataFrame | None = None,
    error_types: Sequence[str] = S.ERROR_TYPES,
    comps: Sequence[str] = S.COMPONENTS,
    horizons: Sequence[int] = S.HORIZONS,
    key: str = "machineID",
    ts: str = "datetime",
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """C2 + C3 + C4 in one pass: union with the event logs, then running fills by machine.

    Failure within h hours ahead, error of each type within h hours back (0 when none), and hours / days since
    the last maintenance of each component (null when none). Never fans out, whatever repeats in the logs.
    """
    error_types = error_types if errors is not None else []
    comps = comps if maint is not None else []
    rows = event_columns(stack_events(telemetry, key, ts, errors, maint, failures), error_types, comps)
    back = {f"_last_e_{e}": f"_e_{e}" for e in error_types} | {f"_last_m_{c}": f"_m_{c}" for c in comps}
    ahead = {"_next_f": "_f"} if failures is not None else {}
    filled = running_fill(rows, [key], ["_t", "_kind"], back, ahead, hot_rows)
    cols = history_exprs(error_types, comps, horizons, failures is not None)
    return filled.filter(F.col("_kind") == READING).select(*telemetry.columns, *[v.alias(k) for k, v in cols.items()])


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    by: Sequence[str],
    payload: Sequence[str],
    direction: str = "backward",
    tolerance_us: int | None = None,
    tiebreak: Sequence[str] = (),
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Nearest right row by time per left row; an exact time match counts.

    Among right rows of one instant ``backward`` takes the last and ``forward`` the first in ``tiebreak`` order;
    ``nearest`` prefers the earlier side on equal distance. Unmatched payload is null.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError("direction must be backward, forward or nearest")
    by = list(by)
    ties = [f"_tie{i}" for i in range(len(tiebreak))]
    hit = F.struct(micros(on).alias("t"), *payload)
    rows = left.withColumns({"_t": micros(on), "_kind": F.lit(READING)})
    sides = []
    if direction != "forward":
        sides.append(("_back", PAST))
    if direction != "backward":
        sides.append(("_ahead", FUTURE))
    for name, kind in sides:
        part = right.select(*by, micros(on).alias("_t"), F.lit(kind).alias("_kind"),
                            *[F.col(c).alias(t) for c, t in zip(tiebreak, ties)], hit.alias(name))
        rows = rows.unionByName(part, allowMissingColumns=True)
    names = [n for n, _ in sides]
    filled = running_fill(
        rows, by, ["_t", "_kind", *ties],
        back={"_hit_back": "_back"} if "_back" in names else {},
        ahead={"_hit_ahead": "_ahead"} if "_ahead" in names else {},
        hot_rows=hot_rows,
    ).filter(F.col("_kind") == READING)
    back, ahead, t = F.col("_hit_back"), F.col("_hit_ahead"), F.col("_t")
    if direction == "backward":
        chosen = back
    elif direction == "forward":
        chosen = ahead
    else:
        chosen = F.when(ahead.isNull() | (t - back["t"] <= ahead["t"] - t), back).otherwise(ahead)
    if tolerance_us is not None:
        chosen = F.when(F.abs(t - chosen["t"]) <= tolerance_us, chosen)
    out = filled.withColumn("_hit", chosen)
    return out.select(*left.columns, *[F.col("_hit")[c].alias(c) for c in payload])
