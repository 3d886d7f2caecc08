"""Table schemas and the fixed parameters of the computation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

# Sensor names, window sizes (in rows), event types and cut-off dates.
SENSORS = ["volt", "rotate", "pressure", "vibration"]
LAGS = [1, 3, 6, 12, 24]
ROLL_MEANS = [3, 6, 12, 24, 48]
ROLL_STDS = [6, 24, 48]
SLOPES = [3, 6, 12]
HORIZONS = [24, 48]
ERROR_TYPES = ["error1", "error2", "error3", "error4", "error5"]
COMPONENTS = ["comp1", "comp2", "comp3", "comp4"]
TRAIN_END = "2015-09-30 23:59:59"
VALID_END = "2015-11-15 23:59:59"
DEFAULT_MODEL = "model1"
DEFAULT_AGE = 18

_ts, _s, _d, _i, _l = T.TimestampType(), T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()


def _schema(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in cols.items()])


TELEMETRY = _schema(datetime=_ts, machineID=_i, volt=_d, rotate=_d, pressure=_d, vibration=_d)
ERRORS = _schema(datetime=_ts, machineID=_i, errorID=_s)
MAINT = _schema(datetime=_ts, machineID=_i, comp=_s)
FAILURES = _schema(datetime=_ts, machineID=_i, failure=_s)
MACHINES = _schema(machineID=_i, model=_s, age=_i)
RAW_TABLES = {"telemetry": TELEMETRY, "errors": ERRORS, "maint": MAINT, "failures": FAILURES, "machines": MACHINES}
SCORING_INPUT = _schema(machineID=_i, datetime=_ts, volt=_d, rotate=_d, pressure=_d, vibration=_d, model=_s, age=_i)
REGISTRY = T.StructType(
    [T.StructField("id", _l), T.StructField("machine_id", _i)]
    + [T.StructField(c, _s) for c in ("serial_number", "model", "manufacturer", "vendor", "location", "status",
                                      "currency", "oil_type", "notes")]
    + [T.StructField("price", T.DecimalType(18, 2))]
    + [T.StructField(c, T.DateType()) for c in ("purchase_date", "warranty_until", "last_maintenance",
                                                "next_maintenance", "last_oil_date")]
    + [T.StructField("oil_interval_days", _i), T.StructField("maintenance_interval_days", _i)]
)
PROBLEMS = T.StructType(
    [T.StructField(c, _s) for c in ("id", "title", "description", "summary")]
    + [T.StructField(c, T.ArrayType(_s)) for c in ("symptoms", "causes", "solutions")]
    + [T.StructField("notes", _s), T.StructField("raw_text", _s), T.StructField("embedding", T.ArrayType(T.FloatType()))]
)


def normalise(df: DataFrame) -> DataFrame:
    """Load-boundary rule: zone-less timestamps become UTC timestamps and NaN becomes NULL."""
    fixed = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.TimestampNTZType):
            col = col.cast("timestamp")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            col = F.when(~F.isnan(col), col)
        fixed.append(col.alias(field.name))
    return df.select(*fixed)
