"""Scratch tables, checks of inputs and the registry reader."""

import pytest

from gearwatch import session
from gearwatch.functions import text
from gearwatch.operators import quality
from gearwatch.plans import training


def test_scratch_is_deleted_on_request(spark, monkeypatch):
    monkeypatch.setattr(session, "SCRATCH", [])
    kept = session.materialise(spark.range(3), "scratch-test")
    assert kept.count() == 3 and len(session.SCRATCH) == 1
    path = session.SCRATCH[0]
    assert session.clear_scratch(spark) == 1 and session.SCRATCH == []
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_empty_tables_are_refused_on_request(spark):
    empty = spark.range(0)
    assert quality.require_columns(empty, ["id"]) is empty
    with pytest.raises(ValueError, match="no rows"):
        quality.require_columns(empty, ["id"], rows=True)
    assert quality.require_columns(spark.range(1), ["id"], rows=True).count() == 1


def test_ids_and_spaces_of_every_script(spark):
    df = spark.createDataFrame([("ماكينة رقم ٥٦",), ("machine id 77",), ("Machine #5 and #12",), (None,)], "t string")
    got = [r["ids"] for r in df.select(text.machine_ids(df.t).alias("ids")).collect()]
    assert got == [["٥٦"], ["77"], ["12", "5"], None]


def test_sql_chunks_are_those_of_the_column_function(spark):
    text.register_sql(spark)
    df = spark.createDataFrame([("  hello \x1c",), ("a" * 25 + "　",), ("",)], "t string")
    rows = df.selectExpr("t", "chunk_text(t, 10, 4) AS c").withColumn("d", text.chunks(df.t, 10, 4)).collect()
    assert all(r["c"] == r["d"] for r in rows) and rows[0]["c"][0] == "hello"


def test_penalty_of_a_callers_pipeline_stays(spark):
    pipeline = training.get_model("logistic_regression", ["x"])
    spread = training.spread_penalty(pipeline, 100)
    assert pipeline.getStages()[-1].getRegParam() == 1.0 and spread.getStages()[-1].getRegParam() == 0.01
