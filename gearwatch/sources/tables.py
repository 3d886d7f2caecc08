"""Reading and writing the raw tables, scoring input, JSON lines, chunks and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from gearwatch import schemas as S
from gearwatch.functions.tiers import with_defaults
from gearwatch.session import materialise

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """A1: one raw table with its declared schema; text files need no inference pass."""
    if fmt == "csv":
        df = spark.read.schema(schema).option("header", True).option("timestampFormat", TIMESTAMP_FORMAT).csv(path)
    else:
        df = spark.read.schema(schema).format(fmt).load(path)
    return S.normalise(df)


def load_tables(spark: SparkSession, folder: str, fmt: str = "csv") -> dict[str, DataFrame]:
    """A1: the five raw tables by name."""
    suffix = {"csv": ".csv", "parquet": ".parquet", "json": ".json", "orc": ".orc"}[fmt]
    return {n: read_table(spark, f"{folder}/{n}{suffix}", schema, fmt) for n, schema in S.RAW_TABLES.items()}


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files below a folder with path, name and size; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"))


def expected_files(spark: SparkSession, folder: str, names: Sequence[str]) -> DataFrame:
    """A2: presence and size of every expected file (missing or empty ones are not complete)."""
    want = spark.createDataFrame([(n,) for n in names], "name string")
    have = list_files(spark, folder).groupBy("name").agg(F.sum("bytes").alias("bytes"))
    return want.join(have, "name", "left").select("name", "bytes", (F.coalesce("bytes", F.lit(0)) > 0).alias("complete"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", ts: str | None = None, order: Sequence[str] = (),
                mode: str = "errorifexists") -> None:
    """A5: write a cleaned or processed table, by month when it has a time column, rows in order inside each file.

    Months are rebalanced before the write: small ones share a task, and adaptive execution cuts a busy one into
    several files of ordinary size.
    """
    out = df
    if ts:
        out = out.withColumn("month", F.date_format(ts, "yyyy-MM")).hint("rebalance", F.col("month"))
    if order:
        out = out.sortWithinPartitions(*(["month"] if ts else []), *order)
    writer = out.write.mode(mode)
    if ts:
        writer = writer.partitionBy("month")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def read_scoring_input(spark: SparkSession, path: str) -> DataFrame:
    """Scoring CSV; a missing model or age, as a column or as a value, takes its default."""
    header = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([next((f for f in S.SCORING_INPUT.fields if f.name == c), T.StructField(c, T.StringType())) for c in header])
    df = spark.read.schema(schema).option("header", True).option("timestampFormat", TIMESTAMP_FORMAT).csv(path)
    return with_defaults(S.normalise(df), {"model": S.DEFAULT_MODEL, "age": S.DEFAULT_AGE})


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = S.PROBLEMS) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected lines) of a JSON-lines file; blank lines belong to neither.

    Lines are read as text and parsed as an expression, so both outputs come from any projection of one scan.
    """
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = lines.select("value", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    good = parsed.filter("r._bad IS NULL").select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields])
    return good, parsed.filter("r._bad IS NOT NULL").select(F.col("value").alias("line"))


def write_chunks(chunks: DataFrame, path: str) -> dict[str, float]:
    """Append chunk rows with a default source; returns written and failed counts and success % of this write.

    A chunk without content or vector counts as failed and is not written. The counts are observed while the rows are
    written, so vectors are computed once and nothing is stored in between.
    """
    ok = F.col("content").isNotNull() & (F.length("content") > 0) & F.col("embedding").isNotNull()
    given = F.nullif("source", F.lit("")) if "source" in chunks.columns else F.lit(None).cast("string")
    rows = chunks.withColumns({
        "source": F.coalesce(given, F.concat(F.lit("chunk_"), F.col("chunk_index").cast("string"))),
        "_ok": F.coalesce(ok, F.lit(False)),
    })
    seen = Observation()
    rows = rows.observe(seen, F.count(F.lit(1)).alias("total"), F.count_if(F.col("_ok")).alias("written"))
    rows.filter("_ok").drop("_ok").write.mode("append").parquet(path)
    total, written = seen.get.get("total", 0), seen.get.get("written", 0)
    return {"written": written, "failed": total - written, "success_pct": 100.0 * written / total if total else 0.0}


def read_registry(spark: SparkSession, path: str | None = None, url: str | None = None, dbtable: str = "machines",
                  partition: tuple[str, object, object, int] | None = None, **options: str) -> DataFrame:
    """A10: the machine registry from Parquet or over JDBC; equality filters, columns and limits go to the source.

    ``partition`` = (column, lower bound, upper bound, parts) reads a JDBC table in that many range queries; the
    bounds only set the ranges, no row is left out.
    """
    if partition:
        names = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")
        options |= {n: str(v) for n, v in zip(names, partition, strict=True)}
    if url:
        return spark.read.format("jdbc").options(url=url, dbtable=dbtable, **options).load()
    return spark.read.schema(S.REGISTRY).parquet(path)


def export_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV export with header."""
    df.write.mode(mode).option("header", True).csv(path)


def export_report(summary: DataFrame, data: DataFrame, folder: str) -> None:
    """The two report tables as CSV folders ``Summary`` and ``Data``."""
    export_csv(summary, f"{folder}/Summary")
    export_csv(data, f"{folder}/Data")
