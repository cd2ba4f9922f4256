import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from txnguard import schemas
from txnguard.functions import alerts as A
from txnguard.functions import decode as D
from txnguard.functions.conform import conform
from txnguard.functions.features import skip_reason

GOOD = {"id": "1", "userId": "u", "cardNumber": "c", "amount": 12.5, "currency": "EUR", "merchantId": "m", "country": "VN",
        "status": "SUCCESS", "eventTime": "2024-01-01T00:00:07.5Z", "mlFeatures": {"V1": 1.5, "Amount": "2"}}


def raw(spark, *values):
    rows = [(None, None if v is None else bytearray(v, "utf8"), datetime(2024, 5, 1)) for v in values]
    return spark.createDataFrame(rows, schemas.RAW_RECORD)


def record(**changes):
    body = {**GOOD, **changes}
    return json.dumps({k: v for k, v in body.items() if v is not ...})


CASES = [
    (None, "null_value"),
    ("{broken", "bad_json"),
    ("", "bad_json"),
    ("null", "bad_json"),
    ("[1]", "bad_json"),
    ('"text"', "bad_json"),
    (record(extra=1), "unknown_field"),
    (record(amount={"v": 1}), "bad_type"),
    (record(amount="much"), "bad_type"),
    (record(amount=True), "bad_type"),
    (record(id={"a": 1}), "bad_type"),
    (record(userId=["a"]), "bad_type"),
    (record(eventTime="yesterday"), "bad_type"),
    (record(mlFeatures=[1]), "bad_type"),
    (record(mlFeatures={"V1": "x"}), "bad_type"),
    (record(mlFeatures={"V1": {"a": 1}}), "bad_type"),
    (record(id=...), "missing_required"),
    (record(id=None), "missing_required"),
    (record(amount=...), "missing_required"),
    (record(amount=""), "missing_required"),
    (record(), None),
    (record(amount="12.5"), None),
    (record(id=5), None),
    (record(id="{curly"), None),
    (record(id='{"a": 1}'), None),
    (record(eventTime=1704067207.5), None),
    (record(eventTime="2024-01-01T02:00:07.5+02:00"), None),
    (record(eventTime=None), None),
    (record(mlFeatures=None), None),
    (record(mlFeatures={"V1": None}), None),
]


def test_every_reason(spark):
    df = raw(spark, *[v for v, _ in CASES]).coalesce(1).withColumn("n", F.monotonically_increasing_id())
    got = {r.n: r.reason for r in D.classify_transactions(df).collect()}
    wrong = [(CASES[n][0], CASES[n][1], reason) for n, reason in got.items() if CASES[n][1] != reason]
    assert not wrong and len(got) == len(CASES)


def test_values_and_time_fallback(spark):
    valid, malformed = D.decode_transactions(raw(spark, record(), record(id=5, amount="0.123456789", eventTime=None), record(eventTime=1704067207.5), None))
    rows = D.with_event_ms(valid).orderBy("event_ms").collect()
    assert [r.event_ms for r in rows] == [1704067207500, 1704067207500, 1714521600000]
    late = rows[2]
    assert late.id == "5" and str(late.amount) == "0.123456789000000000"
    assert rows[0].features == {"V1": 1.5, "Amount": 2.0}
    assert malformed.count() == 1


def test_rules(spark):
    df = raw(
        spark, None, "{oops", '{"ruleName":"x"}', '{"ruleId":"P1","extra":1}', '{"ruleId":"P1","thresholdAmount":{}}',
        '{"ruleId":"P1"}', '{"ruleId":"P2","enabled":true,"thresholdAmount":"7.5","thresholdAmountHigh":9,"windowSeconds":60,"minOccurrences":2,"severity":"LOW","ruleName":"n"}',
    )
    got = {r.rule_id: r for r in D.decode_rules(df).collect()}
    assert set(got) == {"P1", "P2"}
    p1 = got["P1"]
    assert (p1.enabled, p1.threshold_amount, p1.threshold_amount_high, p1.window_seconds, p1.min_occurrences) == (False, 0.0, None, 0, 0)
    p2 = got["P2"]
    assert (p2.enabled, p2.threshold_amount, p2.threshold_amount_high, p2.window_seconds, p2.min_occurrences) == (True, 7.5, 9.0, 60, 2)


def test_conform(spark):
    rows = [
        ("1", "u", "c", "1.005", "EUR", None, "VN", "SUCCESS"),
        (None, "u", "c", "1", "EUR", None, "VN", "SUCCESS"),
        ("2", "u" * 51, "c", "1", "EUR", None, "VN", "SUCCESS"),
        ("3", "u", "c", "99999999999", "EUR", None, "VN", "SUCCESS"),
        ("4", "u", "c", "1", "EURO", None, "VN", "SUCCESS"),
    ]
    df = spark.createDataFrame(rows, "id string, user_id string, card_number string, amount string, currency string, merchant_id string, country string, status string")
    df = df.withColumn("event_time", F.current_timestamp())
    good, bad = conform(df, schemas.TRANSACTIONS_TABLE, {"ingested_at": F.current_timestamp()})
    row = good.first()
    assert good.count() == 1 and str(row.amount) == "1.01" and row.ingested_at is not None
    assert good.schema.simpleString() == spark.createDataFrame([], schemas.ddl(schemas.TRANSACTIONS_TABLE)).schema.simpleString()
    assert sorted(r.reject_reason for r in bad.collect()) == ["amount_not_storable", "currency_too_long", "id_null", "user_id_too_long"]


def test_alert_record(spark):
    alerts = spark.createDataFrame(
        [("a", "t", "u", "P001", "n", "HIGH", 1.5, "d", "CEP", 0.0, datetime(2024, 1, 1, 0, 0, 0, 250000)), ("b", "t", None, "P001", "n", "HIGH", 1.5, None, None, 0.0, None)],
        schemas.ddl(schemas.ALERTS_TABLE).replace("decimal(12,2)", "double").replace("decimal(6,4)", "double"),
    )
    rows = A.to_records(alerts).collect()
    assert len(rows) == 1 and bytes(rows[0].key) == b"u"
    body = json.loads(rows[0].value)
    assert body["transactionId"] == "t" and body["mlProbability"] == 0.0 and body["detectedAt"] == 1704067200.25
    assert A.null_keys(alerts).first().null_keys == 1


def test_skip_reason(spark):
    full = {n: 1.0 for n in schemas.FEATURE_NAMES}
    cases = [
        (None, "no_features"), ({}, "no_features"), ({**full, "V9": None}, "missing_feature"), ({"V1": 1.0}, "missing_feature"),
        ({**full, "Amount": -0.1}, "out_of_range"), ({**full, "Time": -1.0}, "out_of_range"), ({**full, "Amount": 0.0}, None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "n int, f map<string,double>")
    assert [r.r for r in df.select("n", skip_reason(F.col("f")).alias("r")).orderBy("n").collect()] == [c[1] for c in cases]


@pytest.mark.parametrize("text,micros", [("2024-01-01T00:00:00Z", 0), ("1704067200", 0), ("1704067200.000001", 1), ("2024-01-01", None), ("2024-01-01T00:00Z", None)])
def test_instant(spark, text, micros):
    got = spark.createDataFrame([(text,)], "t string").select(F.unix_micros(D.instant(F.col("t"))).alias("m")).first().m
    assert got == (None if micros is None else 1704067200000000 + micros)
