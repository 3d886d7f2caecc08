"""Plan shape: shared exchanges, pushed filters, no nested-loop joins, no Python where SQL functions do."""

import re

import pytest

from gearwatch.catalog import QUERIES, features
from gearwatch.catalog.base import telemetry
from gearwatch.operators import series

PYTHON_OPERATORS = ("c7_", "t6_", "i9_", "j7_", "j3_")


def plan(df):
    """Physical plan text without expression ids."""
    return re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())


@pytest.fixture
def static(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_row_features_share_one_exchange(static, sf):
    text = plan(series.sensor_features(telemetry(static, sf), ["volt", "rotate"], ["machineID"], ["datetime", "event_id"]))
    assert text.count("Exchange hashpartitioning") == 1 and text.count("Sort [") == 1


def test_feature_table_has_one_hash_exchange(static, sf):
    text = plan(features.flagship(static, sf))
    assert text.count("Exchange hashpartitioning") == 1
    assert "BroadcastHashJoin" in text and "PushedFilters: [In(event_type" in text
    assert "value,props" in text and "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string>" in text


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n[:2] in ("c1", "c2", "c3", "c4", "c5", "c6", "v5", "v6", "v7", "e1", "i1", "i2", "d4")))
def test_no_nested_loops_and_no_row_python(static, sf, name):
    if name.startswith(("i1", "i2")) and name[:3] not in ("i16", "i17", "i19", "i27", "i28", "i29"):
        pytest.skip("fits a model")
    text = plan(QUERIES[name](static, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if not name.startswith(PYTHON_OPERATORS):
        assert "BatchEvalPython" not in text and "MapInPandas" not in text


@pytest.mark.parametrize("name", ["v5_c8_match", "v6_v8_e14_evaluate", "v7_c9_confusion"])
def test_exploded_boxes_are_never_broadcast(static, sf, name):
    """Below a broadcast no box is copied to its cells: how many rows that makes is not known while the plan is made."""
    lines = plan(QUERIES[name](static, sf)).splitlines()
    depth = lambda line: len(re.match(r"[ :|+*()\-0-9]*", line).group())
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            for below in lines[i + 1 :]:
                if depth(below) <= depth(line):
                    break
                assert not ("Generate explode" in below and ("_g" in below or "_l" in below)), name


def test_running_totals_plan_their_input_once(static, sf):
    text = plan(QUERIES["i17_i18_auc_and_ap"](static, sf))
    assert "events" not in text  # only the written ranges are read
    assert len(re.findall(r"(?<!Broadcast)Exchange (?:hash|range|Single)", text)) < 5
