"""Structured Streaming jobs: live metrics, alerts, digests, enrichment, buffers, stateful features, rate limits.

Aggregations, joins and duplicate removal use watermarks and built-in state. Row-exact state (last readings, accepted
calls) is a small table: every micro-batch reads the version of the batch before it, computes with the same operators
as batch jobs, and writes its own version, so a replayed batch writes the same files again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gearwatch.functions import tiers
from gearwatch.operators import series
from gearwatch.session import scratch_path

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*", fmt: str = "parquet",
                files_per_batch: int | None = None, ts: Sequence[str] = ("datetime",)) -> DataFrame:
    """File stream; event times become UTC timestamps, which watermarks need."""
    reader = spark.readStream.schema(schema).format(fmt).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    df = reader.load(folder)
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ts if c in df.columns})


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process everything available and return the sink. Update mode keeps the newest row per batch folder."""
    spark = df.sparkSession
    writer = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer.outputMode("append").format("parquet").option("path", path).start().awaitTermination()
        return spark.read.schema(df.schema).parquet(path)

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/b={number}")

    writer.outputMode(mode).foreachBatch(save).start().awaitTermination()
    return spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_batch", T.LongType())])).parquet(f"{path}/b=*")


def newest_update(sink: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Current value per key of an update-mode sink."""
    rest = [c for c in sink.columns if c not in {*keys, "_batch"}]
    return sink.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*keys, "_r.*")


def live_metrics(stream: DataFrame, threshold: float, window: str = "1 hour", slide: str | None = None,
                 late: str = "2 hours", prob: str = "p", ts: str = "datetime") -> DataFrame:
    """Per window readings, readings above the threshold and their %, health, and an estimate of machines."""
    over = F.count_if(F.col(prob) > threshold)
    frame = F.window(ts, window, slide) if slide else F.window(ts, window)
    return stream.withWatermark(ts, late).groupBy(frame.alias("w")).agg(
        F.count("*").alias("readings"), over.alias("high_risk"),
        (over * 100.0 / F.greatest(F.count("*"), F.lit(1))).alias("high_risk_pct"),
        ((1 - F.avg(prob)) * 100).alias("health"), F.approx_count_distinct("machineID").alias("machines"),
    ).select(F.col("w.start").alias("window_start"), "readings", "high_risk", "high_risk_pct", "health", "machines")


def critical_alerts(stream: DataFrame, threshold: float, every: str = "1 hour", late: str = "2 hours",
                    prob: str = "p", ts: str = "datetime") -> DataFrame:
    """Readings above the threshold, at most one per machine and window."""
    hot = stream.withWatermark(ts, late).filter(F.col(prob) > threshold)
    return hot.withColumn("window_start", F.window(ts, every).getField("start")).dropDuplicatesWithinWatermark(
        ["machineID", "window_start"])


def alert_digest(stream: DataFrame, frequency: str, late: str = "2 hours", prob: str = "p", ts: str = "datetime") -> DataFrame:
    """Immediate passes alerts through; Hourly and Daily count levels and keep the highest score."""
    levels = stream.withColumn("risk_level", tiers.api_tier(F.col(prob)))
    if frequency == "Immediate":
        return levels.filter("risk_level <> 'Normal'")
    sizes = {"Hourly": "1 hour", "Daily": "1 day"}
    if frequency not in sizes:
        raise ValueError("frequency must be Immediate, Hourly or Daily")
    return levels.withWatermark(ts, late).groupBy(F.window(ts, sizes[frequency]).alias("w")).agg(
        *[F.count_if(F.col("risk_level") == n).alias(n.lower()) for n in ("Critical", "Warning", "Normal")],
        F.max(prob).alias("max_p")).select(F.col("w.start").alias("window_start"), "critical", "warning", "normal", "max_p")


def silence_sessions(df: DataFrame, gap: str = "12 hours", late: str | None = None, ts: str = "datetime", key: str = "machineID") -> DataFrame:
    """Activity sessions per machine that end after a silence of ``gap``; works on streams and tables."""
    timed = df.withWatermark(ts, late) if late else df
    return timed.groupBy(key, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("readings")).select(
        key, F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "readings")


def enrich(stream: DataFrame, machines: DataFrame, key: str = "machineID") -> DataFrame:
    """Stream with static machine metadata; the table is broadcast only if the optimizer finds it small."""
    return stream.join(machines, key, "left")


def join_events(readings: DataFrame, events: DataFrame, hours: int = 24, late: str = "2 hours", how: str = "inner") -> DataFrame:
    """Readings with the events of the same machine in the ``hours`` before them; time bounds let state expire.

    ``events`` holds (machineID, event_time, ...).
    """
    left = readings.withWatermark("datetime", late)
    right = events.withColumnRenamed("machineID", "_m").withWatermark("event_time", late)
    near = F.expr(f"machineID = _m AND event_time <= datetime AND event_time >= datetime - INTERVAL {hours} HOURS")
    return left.join(right, near, "left_outer" if how == "left" else how).drop("_m")


def without_repeats(stream: DataFrame, keys: Sequence[str], late: str = "2 hours", ts: str = "datetime") -> DataFrame:
    """Drop repeated readings that arrive within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def with_state(
    stream: DataFrame,
    step: Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame]],
    folder: str,
    checkpoint: str,
) -> None:
    """Run ``step(batch, state) -> (output, new state)`` per micro-batch with the state kept as a table.

    Output goes to ``folder/out``, state to ``folder/state``, one sub-folder per batch; a batch reads the state of
    the batch before it, whatever happens in between.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        state = spark.read.parquet(f"{folder}/state/b={number - 1}") if number > 0 else None
        out, new = step(batch, state)
        out.write.mode("overwrite").parquet(f"{folder}/out/b={number}")
        new.write.mode("overwrite").parquet(f"{folder}/state/b={number}")
        batch.unpersist()

    (stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
     .foreachBatch(handle).start().awaitTermination())


def stateful_features(sensors: Sequence[str], order: Sequence[str] = ("datetime",), **sizes) -> Callable:
    """E1-E4 on new readings; the state is the last rows of each machine that a feature can reach."""
    depth = series.max_depth(**sizes)

    def step(batch: DataFrame, state: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        columns = batch.columns
        rows = batch.withColumn("_new", F.lit(True))
        if state is not None:
            rows = state.select(*columns).withColumn("_new", F.lit(False)).unionByName(rows)
        out = series.sensor_features(rows, sensors, ["machineID"], list(order), **sizes)
        return out.filter("_new").drop("_new"), series.last_n(rows.drop("_new"), depth, ["machineID"], list(order))

    return step


def count_late(late_hours: float, ts: str = "datetime") -> Callable:
    """Pass readings with a late flag: older than the newest time of earlier batches minus the allowance."""

    def step(batch: DataFrame, state: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        newest = batch.agg(F.max(ts).alias("newest"))
        if state is None:
            return batch.withColumn("late", F.lit(False)), newest
        edge = state.select((F.col("newest") - F.expr(f"INTERVAL {int(late_hours * 3600)} SECONDS")).alias("e")).scalar()
        marked = batch.withColumn("late", F.coalesce(F.col(ts) < edge, F.lit(False)))
        return marked, newest.unionByName(state).agg(F.max("newest").alias("newest"))

    return step


def score_batches(model, prepare: Callable[[DataFrame], DataFrame], prob: str = "p") -> Callable:
    """Features and model score for every reading of a micro-batch (no state)."""
    from gearwatch.plans.training import score

    def step(batch: DataFrame, state: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        return score(model, prepare(batch), prob), batch.limit(0)

    return step


def rate_limit(calls: DataFrame, max_calls: int = 30, period: float = 60.0, key: str = "key", ts: str = "datetime",
               tie: Sequence[str] = (), prior: DataFrame | None = None) -> DataFrame:
    """Mark each call allowed or denied: at most ``max_calls`` accepted calls in the last ``period`` seconds.

    Denied calls do not count, so the decision follows the order of calls inside a key. After a silence of one
    period nothing is remembered; such stretches are independent and run in parallel. Rows arrive sorted and the
    task keeps at most ``max_calls`` times per stretch. ``prior`` holds accepted calls of an earlier batch.
    """
    micros = int(period * 1_000_000)
    rows = calls.withColumns({"_t": series.micros(ts), "_given": F.lit(False)})
    if prior is not None:
        old = prior.select(*calls.columns).withColumns({"_t": series.micros(ts), "_given": F.lit(True)})
        rows = rows.unionByName(old)
    order = ["_t", *tie]

    def edges(df: DataFrame, w: W) -> DataFrame:
        quiet = F.coalesce(F.col("_t") - F.lag("_t", 1).over(w) >= micros, F.lit(True))
        return df.withColumn("_edge", F.when(quiet, F.col("_t")))

    gaps = series.over_rows(rows, [key], order, 1, edges)
    stretches = series.running_fill(gaps, [key], order, back={"_stretch": "_edge"})
    ready = stretches.drop("_edge").repartition(key, "_stretch").sortWithinPartitions(key, "_stretch", *order)
    schema = T.StructType([*ready.schema.fields, T.StructField("allowed", T.BooleanType())])

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, accepted = None, []
        for pdf in batches:
            verdicts = []
            for k, s, t, given in zip(pdf[key], pdf["_stretch"], pdf["_t"], pdf["_given"]):
                if (k, s) != current:
                    current, accepted = (k, s), []
                accepted = [a for a in accepted if t - a < micros]
                ok = bool(given) or len(accepted) < max_calls
                if ok:
                    accepted.append(t)
                verdicts.append(ok)
            yield pdf.assign(allowed=verdicts)

    return ready.mapInPandas(decide, schema).filter(~F.col("_given")).select(*calls.columns, "allowed")


def rate_limit_step(max_calls: int = 30, period: float = 60.0, key: str = "key", ts: str = "datetime", tie: Sequence[str] = ()) -> Callable:
    """J7 on a stream: the state is the accepted calls of the last period per key."""

    def step(batch: DataFrame, state: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        from gearwatch.session import materialise

        out = materialise(rate_limit(batch, max_calls, period, key, ts, tie, state), "calls")
        kept = out.filter("allowed").drop("allowed")
        if state is not None:
            kept = kept.unionByName(state.select(*kept.columns))
        newest = F.max(series.micros(ts)).over(W.partitionBy(key))
        recent = kept.withColumn("_n", newest).filter(F.col("_n") - series.micros(ts) < int(period * 1_000_000)).drop("_n")
        return out, recent

    return step


class LastReadings(StatefulProcessor):
    """Keeps the newest ``size`` readings of a machine; merging needs no order, so chunks are folded one by one."""

    def __init__(self, size: int, columns: Sequence[str], state_schema: str):
        self.size, self.columns, self.state_schema = size, list(columns), state_schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", self.state_schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = pd.DataFrame(list(self.rows.get()), columns=self.columns) if self.rows.exists() else None
        for pdf in rows:
            part = pdf[self.columns]
            kept = part if kept is None else pd.concat([kept, part])
            kept = kept.sort_values(self.columns[:2]).tail(self.size)
        if kept is not None:
            self.rows.put([tuple(r) for r in kept.itertuples(index=False)])
            yield kept.assign(machineID=key[0])

    def close(self) -> None:
        pass


def last_readings(stream: DataFrame, size: int = 100, columns: Sequence[str] = ("t", "event_id", "volt")) -> DataFrame:
    """Buffer of the newest readings per machine (update output: the whole buffer of every machine that changed).

    ``columns`` are long or double fields; the first two order the readings.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    kinds = dict(stream.dtypes)
    inner = ", ".join(f"{c} {kinds[c]}" for c in columns)
    return stream.groupBy("machineID").transformWithStateInPandas(
        statefulProcessor=LastReadings(size, columns, inner), outputStructType=f"{inner}, machineID {kinds['machineID']}",
        outputMode="Update", timeMode="None")


def work_folder(spark: SparkSession, name: str) -> tuple[str, str]:
    """A fresh sink and checkpoint folder in the shared folder."""
    base = scratch_path(spark, name)
    return f"{base}/sink", f"{base}/checkpoint"
