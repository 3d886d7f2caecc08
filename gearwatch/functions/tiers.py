"""Risk tiers, decisions and labels as column expressions. Each scheme keeps its own edges and closed sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def steps(value: Column, rules: Sequence[tuple[float | Column, str]], otherwise: str, op: str = "gt") -> Column:
    """First matching rule wins; ``op`` is gt (>), ge (>=), lt (<) or le (<=). Null stays null."""
    test = {"gt": lambda e: value > e, "ge": lambda e: value >= e, "lt": lambda e: value < e, "le": lambda e: value <= e}[op]
    out = F.when(value.isNull(), F.lit(None))
    for edge, label in rules:
        out = out.when(test(edge), label)
    return out.otherwise(otherwise)


def bins(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins (e0, e1], (e1, e2], ...; values outside, the lowest edge included, give null."""
    out = F.when(value <= edges[0], F.lit(None))
    for upper, label in zip(edges[1:], labels):
        out = out.when(value <= upper, label)
    return out


# The tier schemes and their texts.
def risk_level(p: Column) -> Column:
    """B6a."""
    return bins(p, [0.0, 0.3, 0.7, 1.0], ["Low", "Medium", "High"])


def api_tier(p: Column) -> Column:
    """B6b."""
    return steps(p, [(0.8, "Critical"), (0.6, "Warning")], "Normal", "ge")


def mail_tier(p: Column) -> Column:
    """B6c."""
    return steps(p, [(0.8, "CRITICAL"), (0.6, "HIGH")], "MEDIUM")


def threshold_tier(p: Column, t) -> Column:
    """B6d."""
    return steps(p, [(t, "CRITICAL"), (t * 0.7, "WARNING")], "NORMAL")


def heat_tier(p: Column, t) -> Column:
    """B6e."""
    return steps(p, [(t, "HIGH"), (t * 0.6, "MEDIUM")], "LOW", "ge")


def heat_action(p: Column, t) -> Column:
    """B6e: recommended action."""
    return steps(p, [(t, "Immediate Inspection"), (t * 0.6, "Schedule Maintenance")], "Normal Operation", "ge")


def live_tier(p: Column, t) -> Column:
    """B6f."""
    return steps(p, [(t, "Critical"), (t * 0.5, "Warning")], "Normal")


def component_tier(days: Column) -> Column:
    """B6g."""
    return steps(days, [(80, "Critical"), (60, "Warning"), (40, "Check Soon")], "Good")


def whole_days(later: Column, earlier: Column) -> Column:
    """Days between two timestamps, floored (minus one hour is minus one day)."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / 86_400_000_000).cast("int")


def maintenance_urgency(days: Column) -> Column:
    """B6h."""
    return F.when(days < 0, "Overdue").otherwise(steps(days, [(7, "Critical"), (30, "Soon")], "Scheduled", "le"))


def asset_age(years: Column) -> Column:
    """B6i."""
    return bins(years, [0, 1, 3, 5, 10, 100], ["< 1 year", "1-3 years", "3-5 years", "5-10 years", "> 10 years"])


def simple_tier(p: Column) -> Column:
    """B6j."""
    return steps(p, [(0.7, "High"), (0.4, "Medium")], "Low")


def decide(p: Column, t) -> Column:
    """Decision at threshold, boundary included."""
    return (p >= t).cast("int")


def status_label(decision: Column) -> Column:
    """Display text of a decision."""
    return F.when(decision == 1, "High Risk").when(decision == 0, "Normal")


def effect_label(impact: Column) -> Column:
    """Direction text of an impact."""
    return F.when(impact > 0, "Increases Risk").otherwise("Decreases Risk")


def image_verdict(p: Column, t: float = 0.5) -> tuple[Column, Column]:
    """Verdict and its confidence from the score of the good class."""
    good = p >= t
    return F.when(good, "Non-Defected").otherwise("Defected"), F.when(good, p).otherwise(1 - p)


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Fill nulls, and add columns that are missing."""
    cols = {c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()}
    return df.withColumns(cols)


def parse_ts(df: DataFrame, columns: Sequence[str], fmt: str | None = None) -> DataFrame:
    """B2: lenient parse; text that is not a timestamp becomes null."""
    args = (F.lit(fmt),) if fmt else ()
    return df.withColumns({c: F.try_to_timestamp(F.col(c), *args) for c in columns})


def to_float32(df: DataFrame) -> DataFrame:
    """Numeric columns as 32-bit floats."""
    from pyspark.sql.types import NumericType

    return df.select(*[
        F.col(f.name).cast("float").alias(f.name) if isinstance(f.dataType, NumericType) else F.col(f.name)
        for f in df.schema.fields
    ])


def filter_in(df: DataFrame, choices: dict[str, Sequence]) -> DataFrame:
    """Membership filters; an empty choice does not filter."""
    for column, allowed in choices.items():
        if allowed:
            df = df.filter(F.col(column).isin(list(allowed)))
    return df


def require(df: DataFrame, columns: Sequence[str], positive: Sequence[str] = ()) -> DataFrame:
    """Drop rows with a null in ``columns`` and rows not above zero in ``positive``."""
    df = df.dropna(subset=list(columns)) if columns else df
    for c in positive:
        df = df.filter(F.col(c) > 0)
    return df
