"""Spark session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Plans here have hundreds of columns; recording the Python call site of each costs more than planning them.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "gearwatch", master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC timestamps and adaptive execution.

    On a cluster leave ``master`` unset and let the submit command size shuffle partitions.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; a cluster without the setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="gearwatch-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Scratch paths that this process has handed out.
SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    SCRATCH.append(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return SCRATCH[-1]


def clear_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables of this process; call it once no result that reads them is needed any more."""
    files, jvm = 0, spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(SCRATCH.pop())
        files += path.getFileSystem(conf).delete(path, True)
    return files


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back, so later stages never recompute ``df``."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
