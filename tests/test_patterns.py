import pytest
from helpers import brute_force, failed, midrange, random_rows, small, success, txns
from pyspark.sql import functions as F

from txnguard.functions import alerts as A
from txnguard.operators import detect
from txnguard.operators import patterns as P

P001, P003, P004 = P.BUILTIN["P001"], P.BUILTIN["P003"], P.BUILTIN["P004"]
S, X = "SUCCESS", "FRAUD"


def pairs(df):
    return sorted((r.first_id, r.id) for r in df.select("first_id", "id").collect())


def test_three_small_rows_match(spark):
    rule = P001.with_(high=10.0)
    assert pairs(P.rapid_small(txns(spark, [(1000, "u1", 5.0, S), (2000, "u1", 3.0, S), (3000, "u1", 8.0, S)]), rule)) == [("t0", "t2")]


def test_a_large_row_in_between_leaves_two(spark):
    rule = P001.with_(high=10.0)
    assert pairs(P.rapid_small(txns(spark, [(1000, "u1", 5.0, S), (2000, "u1", 15.0, S), (3000, "u1", 8.0, S)]), rule)) == []


def test_small_rows_overlap_and_skip_others(spark):
    rows = [(0, "c", 1, S), (1, "c", 99, S), (2, "c", 1, S), (3, "c", 1, X), (4, "c", 1, S), (5, "c", 1, S)]
    assert pairs(P.rapid_small(txns(spark, rows))) == [("t0", "t4"), ("t2", "t5")]
    five = [(i, "c", 1, S) for i in range(5)]
    assert len(pairs(P.rapid_small(txns(spark, five)))) == 3


@pytest.mark.parametrize("gap,hits", [(60_000, 0), (59_999, 1)])
def test_window_is_strict(spark, gap, hits):
    rows = [(0, "c", 1, S), (10, "c", 1, S), (gap, "c", 1, S)]
    assert len(pairs(P.rapid_small(txns(spark, rows)))) == hits


def test_limits(spark):
    at = [(0, "c", 50, S), (1, "c", 500, S), (2, "c", 500.01, S), (3, "c", 49.99, S)]
    assert pairs(P.rapid_small(txns(spark, [(i, "c", 50, S) for i in range(3)]))) == []
    assert pairs(P.midrange_velocity(txns(spark, at))) == [("t0", "t1")]
    assert pairs(P.midrange_velocity(txns(spark, at), P004.with_(high=None))) == [("t0", "t1"), ("t1", "t2")]


@pytest.mark.parametrize(
    "statuses,expected",
    [
        ([X, X, S], [("t0", "t2")]),
        ([X, S, S], []),
        ([X, X, X, S], [("t0", "t3"), ("t1", "t3")]),
        ([X, S, X, S], [("t0", "t3")]),
        ([X, "OTHER", X, "OTHER", S], [("t0", "t4")]),
    ],
)
def test_failed_then_success(spark, statuses, expected):
    rows = [(1000 * (i + 1), "u1", 10, s) for i, s in enumerate(statuses)]
    assert pairs(P.fail_then_success(txns(spark, rows))) == expected


def test_equal_times_are_ordered_by_arrival(spark):
    assert pairs(P.fail_then_success(txns(spark, [(5, "u", 1, X), (5, "u", 1, X), (5, "u", 1, S)]))) == [("t0", "t2")]
    assert pairs(P.fail_then_success(txns(spark, [(5, "u", 1, S), (5, "u", 1, X), (5, "u", 1, X)]))) == []


def test_null_keys_are_left_out(spark):
    rows = [(i, None, 1, S) for i in range(4)]
    df = txns(spark, rows)
    assert pairs(P.rapid_small(df)) == []
    assert P.first_in_country(df).count() == 0
    counted = detect.null_key_rows(df).first()
    assert (counted.null_user, counted.null_card) == (4, 4)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("chunk_ms", [None, 7_000, 60_000])
def test_random_rows_against_brute_force(spark, seed, chunk_ms):
    rows = random_rows(seed)
    df = txns(spark, rows).cache()
    kw = {"chunk_ms": chunk_ms}
    assert pairs(P.rapid_small(df, P001, **kw)) == brute_force(rows, [(small, 3)], 60_000)
    assert pairs(P.midrange_velocity(df, P004.with_(window_s=30), **kw)) == brute_force(rows, [(midrange, 2)], 30_000)
    assert pairs(P.fail_then_success(df, P003.with_(window_s=40), **kw)) == brute_force(rows, [(failed, 2), (success, 1)], 40_000)
    both = P.repeated_patterns(df, "card_number", [(P001, P.is_small(P001)), (P004.with_(window_s=30), P.is_midrange(P004))], **kw)
    assert pairs(both.filter("pattern_id = 'P001'")) == brute_force(rows, [(small, 3)], 60_000)
    assert pairs(both.filter("pattern_id = 'P004'")) == brute_force(rows, [(midrange, 2)], 30_000)
    df.unpersist()


@pytest.mark.parametrize("chunk_ms", [None, 11_000])
def test_general_sequence_against_brute_force(spark, chunk_ms):
    rows = random_rows(7)
    df = txns(spark, rows)
    stages = [("a", P.is_failed(), 2), ("b", P.is_success(), 2), ("c", P.is_failed(), 1)]
    found = P.match_sequence(df, "user_id", stages, 90, chunk_ms=chunk_ms)
    got = found.select(F.element_at("a", 1)["id"].alias("first_id"), F.element_at("c", -1)["id"].alias("id"))
    assert pairs(got) == brute_force(rows, [(failed, 2), (success, 2), (failed, 1)], 90_000)


def test_sequence_stages_may_overlap(spark):
    rows = random_rows(8, n=200)
    found = P.match_sequence(txns(spark, rows), "user_id", [("a", P.is_success(), 1), ("b", P.is_small(P001), 2)], 50)
    got = found.select(F.element_at("a", 1)["id"].alias("first_id"), F.element_at("b", -1)["id"].alias("id"))
    assert pairs(got) == brute_force(rows, [(success, 1), (small, 2)], 50_000)


def test_new_country(spark):
    rows = [(2000, "u1", 100, S, "VN"), (3000, "u1", 1000, S, "VN"), (4000, "u1", 800, S, "US")]
    rule = P.BUILTIN["P002"].with_(low=500.0, severity="HIGH")
    found = A.new_country_alerts(P.new_country(txns(spark, rows), rule), rule).collect()
    assert [(r.transaction_id, r.pattern_id, r.severity) for r in found] == [("t2", "P002", "HIGH")]
    assert found[0].description == "800.00 EUR in new country 'US' for user u1"


def test_new_country_first_row_null_country_and_limit(spark):
    rows = [(1, "u1", 900, S, None), (2, "u1", 200, S, "VN"), (3, "u1", 900, S, "VN"), (4, "u2", 200.01, X, "VN")]
    assert [r.id for r in P.new_country(txns(spark, rows)).collect()] == ["t3"]


def test_detect_all_is_repeatable(spark):
    df = txns(spark, random_rows(3))
    first = {r.id for r in detect.detect_all(df).collect()}
    again = [r.id for r in detect.detect_all(df.repartition(3)).collect()]
    assert first == set(again) and len(again) == len(first)


def test_texts(spark):
    df = txns(spark, [(i, "c9", 60, S) for i in range(3)])
    rows = detect.detect_all(df, {"P001": P001.with_(high=100.0, window_s=5), "P004": P004}).collect()
    texts = {r.description for r in rows}
    assert texts == {
        "3 transactions under 100 EUR within 5s on card c9",
        "2 transactions between 50-500 EUR within 600s on card c9",
    }


def test_model_alert(spark):
    df = txns(spark, [(1, "u", 5, S), (2, "u", 5, S), (3, "u", 5, S)]).withColumn(
        "fraud_probability", F.element_at(F.array(F.lit(0.49), F.lit(0.5), F.lit(0.9125)), (F.col("arrival") + 1).cast("int"))
    )
    got = {r.transaction_id: (r.severity, r.description, r.source) for r in A.model_alerts(df).collect()}
    assert got == {"t1": ("HIGH", "XGBoost fraud probability 50.0%", "ML"), "t2": ("CRITICAL", "XGBoost fraud probability 91.3%", "ML")}
