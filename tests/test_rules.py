from datetime import datetime

import pytest
from helpers import txns
from pyspark.sql import functions as F

from txnguard.operators import detect, merge
from txnguard.operators import patterns as P
from txnguard.operators import rules as R

LOG = "rule_id string, rule_name string, enabled boolean, threshold_amount double, threshold_amount_high double, window_seconds int, min_occurrences int, severity string, rule_ts timestamp, rule_seq long"


def log(spark, *rows):
    """(rule id, enabled, threshold, at ms, seq)"""
    data = [(r, f"name {r}", on, limit, None, 60, 3, "HIGH", datetime.fromtimestamp(ms / 1000), seq) for r, on, limit, ms, seq in rows]
    return spark.createDataFrame(data, LOG)


HISTORY = [("P002", True, 10.0, 1000, 1), ("P002", False, 10.0, 3000, 2), ("P002", True, 90.0, 5000, 3), ("P002", True, 50.0, 5000, 4), ("P9", True, 1.0, 0, 5)]


@pytest.mark.parametrize("chunk_ms", [1, 700, 3_600_000])
def test_as_of_over_chunks(spark, chunk_ms):
    df = txns(spark, [(ms, "u", 60, "SUCCESS") for ms in (500, 1000, 2999, 3000, 4999, 5000, 9000)])
    got = R.rule_as_of(df, log(spark, *HISTORY), "P002", chunk_ms=chunk_ms, slots=3)
    assert sorted((r.event_ms, r.threshold_amount) for r in got.collect()) == [(1000, 10.0), (2999, 10.0), (5000, 50.0), (9000, 50.0)]


def test_current_takes_the_newest_then_drops_disabled(spark):
    history = log(spark, ("A", True, 1.0, 1, 1), ("A", False, 1.0, 2, 2), ("B", False, 1.0, 1, 3), ("B", True, 2.0, 2, 4))
    assert [(r.rule_id, r.threshold_amount) for r in R.rule_current(history).collect()] == [("B", 2.0)]


def test_countries_are_remembered_while_the_rule_is_off(spark):
    rows = [(3500, "u", 80, "SUCCESS", "VN"), (6000, "u", 80, "SUCCESS", "VN"), (7000, "u", 80, "SUCCESS", "US")]
    got = R.new_country_dynamic(txns(spark, rows), log(spark, *HISTORY)).collect()
    assert [r.transaction_id for r in got] == ["t2"]
    assert got[0].pattern_name == "name P002"


def test_dynamic_mode_follows_and_disables(spark):
    df = txns(spark, [(i, "u", 5, "SUCCESS") for i in range(3)])
    on = log(spark, ("P001", True, 6.0, 0, 1))
    off = log(spark, ("P001", True, 6.0, 0, 1), ("P001", False, 6.0, 1, 2))
    assert [r.pattern_name for r in detect.detect_all(df, changelog=on, mode="dynamic").collect()] == ["name P001"]
    assert detect.detect_all(df, changelog=off, mode="dynamic").count() == 0
    assert detect.detect_all(df, changelog=off, mode="static").filter("pattern_id = 'P001'").count() == 1


def test_as_of_plan_has_no_nested_loop(spark):
    got = R.rule_as_of(txns(spark, [(1, "u", 1, "SUCCESS")]), log(spark, *HISTORY), "P002")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_dynamic_settings_that_are_absent_keep_the_built_in(spark):
    row = ("P001", None, True, 0.0, None, 0, 0, None, datetime.fromtimestamp(0), 1)
    other = ("P003", "x", True, 0.0, None, 0, 3, "LOW", datetime.fromtimestamp(0), 2)
    got = R.pattern_rules(spark.createDataFrame([row, other], LOG))
    assert got["P001"] == P.BUILTIN["P001"]
    assert got["P003"] == P.BUILTIN["P003"].with_(name="x", times=3, severity="LOW")
    with pytest.raises(ValueError, match="positive"):
        P.BUILTIN["P001"].with_(times=0)


def test_profiles():
    assert P.BUILTIN["P001"].high == 50.0 and P.RULES_FILE["P001"].high == 20.0


def test_first_writer_wins(spark):
    batch = spark.createDataFrame([("a", 2, 1), ("a", 1, 2), ("b", 3, 3), ("c", 4, 4)], "id string, arrival int, v int")
    target = spark.createDataFrame([("b", 1)], "id string, day int")
    assert sorted((r.id, r.v) for r in merge.new_rows(batch, target).collect()) == [("a", 2), ("c", 4)]
    dated = batch.withColumn("day", F.lit(1))
    assert sorted(r.id for r in merge.new_rows(dated, target, day="day").collect()) == ["a", "c"]
