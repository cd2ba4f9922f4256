"""Registered queries: record decoding, feature checks, table constraints, replay, file and table reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnguard import schemas
from txnguard.functions import decode as D
from txnguard.functions import features as X
from txnguard.functions.conform import conform
from txnguard.functions.once import with_once
from txnguard.operators import replay
from txnguard.plans.inputs import TX_SQL, table, tx
from txnguard.plans.pattern_queries import ALL_SQL, alerts
from txnguard.sources import files, tables
from txnguard.workdir import materialize, run_dir

# Fault per remainder of event_id % 97; every other record is sound.
FAULTS = {
    3: "null_value", 5: "bad_json", 7: "missing_id", 11: "missing_amount", 13: "unknown_field", 17: "amount_object",
    19: "amount_word", 23: "amount_text", 29: "epoch_time", 31: "null_time", 37: "json_array", 41: "bad_time",
    43: "single_quotes", 47: "country_object", 53: "feature_word",
}
REASON_SQL = """CASE event_id % 97 WHEN 3 THEN 'null_value' WHEN 5 THEN 'bad_json' WHEN 37 THEN 'bad_json'
  WHEN 13 THEN 'unknown_field' WHEN 17 THEN 'bad_type' WHEN 19 THEN 'bad_type' WHEN 41 THEN 'bad_type' WHEN 43 THEN 'bad_json' WHEN 47 THEN 'bad_type' WHEN 53 THEN 'bad_type'
  WHEN 7 THEN 'missing_required' WHEN 11 THEN 'missing_required' END"""


def raw_records(spark: SparkSession, d: str) -> DataFrame:
    """The transactions as JSON records, with one kind of fault per remainder."""
    t = tx(spark, d)
    fault = F.lit(None).cast("string")
    for remainder, kind in FAULTS.items():
        fault = F.when(F.col("arrival") % 97 == remainder, kind).otherwise(fault)
    iso = F.concat(F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))
    amount = F.col("amount").cast("string")
    epoch = (F.unix_micros("event_time").cast("decimal(20,0)") / 1000000).cast("decimal(20,6)").cast("string")

    def text(name, value):
        return F.concat(F.lit(f'"{name}":"'), value, F.lit('"'))

    amount_json = (
        F.when(F.col("fault") == "amount_object", F.concat(F.lit('{"v":'), amount, F.lit("}")))
        .when(F.col("fault") == "amount_word", F.lit('"a lot"'))
        .when(F.col("fault") == "amount_text", F.concat(F.lit('"'), amount, F.lit('"')))
        .when(F.col("fault") == "missing_amount", F.lit("null"))
        .otherwise(amount)
    )
    time_json = (
        F.when(F.col("fault") == "epoch_time", epoch)
        .when(F.col("fault") == "null_time", F.lit("null"))
        .when(F.col("fault") == "bad_time", F.lit('"yesterday"'))
        .otherwise(F.concat(F.lit('"'), iso, F.lit('"')))
    )
    body = F.concat(
        F.lit("{"),
        F.when(F.col("fault") == "missing_id", F.lit("")).otherwise(F.concat(text("id", F.col("id")), F.lit(","))),
        text("userId", F.col("user_id")), F.lit(","),
        text("cardNumber", F.col("card_number")), F.lit(","),
        F.lit('"amount":'), amount_json, F.lit(","),
        text("currency", F.col("currency")), F.lit(","),
        text("merchantId", F.col("merchant_id")), F.lit(","),
        F.when(F.col("fault") == "country_object", F.lit('"country":{"code":"VN"}')).otherwise(text("country", F.col("country"))), F.lit(","),
        text("status", F.col("status")), F.lit(","),
        F.lit('"eventTime":'), time_json,
        F.when(F.col("fault") == "unknown_field", F.lit(',"extra":1'))
        .when(F.col("fault") == "feature_word", F.lit(',"mlFeatures":{"V1":"much"}')).otherwise(F.lit("")),
        F.lit("}"),
    )
    value = (
        F.when(F.col("fault") == "null_value", F.lit(None))
        .when(F.col("fault") == "bad_json", F.concat(F.lit("{"), body))
        .when(F.col("fault") == "single_quotes", F.translate(body, '"', "'"))
        .when(F.col("fault") == "json_array", F.concat(F.lit("["), body, F.lit("]")))
        .otherwise(body)
    )
    marked = t.withColumn("fault", F.coalesce(fault, F.lit("none")))
    return with_once(marked, "value", value.cast("binary")).select(
        F.col("user_id").cast("binary").alias("key"),
        "value",
        F.col("event_time").alias("timestamp"),
        "arrival",
    )


def decode_valid(spark, d):
    valid, _ = D.decode_transactions(raw_records(spark, d))
    return D.with_event_ms(valid).select(
        "id", "user_id", "card_number", F.col("amount").cast("double").alias("amount"), "currency", "merchant_id",
        "country", "status", "event_ms",
    )


def decode_malformed_by_reason(spark, d):
    _, malformed = D.decode_transactions(raw_records(spark, d))
    return malformed.groupBy("reason").agg(F.count("*").alias("n"))


def quality_counts(spark, d):
    seen = D.classify_transactions(raw_records(spark, d))
    return seen.agg(
        F.count_if(F.col("reason").isNull()).alias("valid"),
        F.count_if(F.col("reason").isNotNull()).alias("malformed"),
    )


def stream_like_rules(spark, d) -> DataFrame:
    """A rule record per event; some without an id, some broken, some with absent flags and numbers."""
    t = tx(spark, d)
    text = F.concat(
        F.lit('{"ruleName":"limit","thresholdAmount":'), F.col("amount").cast("string"),
        F.when(F.col("status") == "FRAUD", F.lit("")).otherwise(F.lit(',"enabled":true,"windowSeconds":60')),
        F.when(F.col("country") == "MY", F.lit("")).otherwise(F.concat(F.lit(',"ruleId":"R'), F.col("user_id"), F.lit('"'))),
        F.when(F.col("country") == "TH", F.lit("")).otherwise(F.lit("}")),
    )
    value = F.when(F.col("country") != "AU", text)
    return with_once(t, "value", value.cast("binary")).select(F.lit(None).cast("binary").alias("key"), "value",
                    F.col("event_time").alias("rule_ts"), F.col("arrival").alias("rule_seq"))


def decode_rules(spark, d):
    return D.decode_rules(stream_like_rules(spark, d)).select(
        "rule_id", "rule_name", "enabled", "threshold_amount", "threshold_amount_high", "window_seconds",
        "min_occurrences", "severity", "rule_seq",
    )


def rules_file_scan(spark, d):
    """Rules made from every part, written as JSON lines and read back with the declared schema."""
    p = table(spark, d, "part")
    path = run_dir(spark, "rules")
    p.select(
        F.concat(F.lit("R"), "p_partkey").alias("ruleId"), F.col("p_name").alias("ruleName"),
        (F.col("p_size") > 10).alias("enabled"), F.col("p_retailprice").alias("thresholdAmount"),
        F.col("p_size").alias("windowSeconds"),
    ).write.json(path)
    return files.read_rules(spark, path).select(
        "ruleId", "ruleName", "enabled", "thresholdAmount", "thresholdAmountHigh", "windowSeconds"
    )


def card_rows(spark, d) -> DataFrame:
    """The events in the shape of the card table: 28 components, amount, elapsed seconds, class and row index."""
    ms0 = 1704067200000  # 2024-01-01 UTC, the start of the tables
    return tx(spark, d).select(
        F.col("arrival").alias("idx"),
        ((F.col("event_ms") - ms0) / 1000.0).alias("Time"),
        F.array(*[(F.col("amount").cast("double") * (i - 14) / 100) for i in range(1, 29)]).alias("components"),
        F.col("amount").cast("double").alias("Amount"),
        F.when(F.col("status") == "FRAUD", 1).otherwise(0).alias("Class"),
    )


CARD_SQL = """card AS (
  SELECT arrival AS idx, (event_ms - 1704067200000) / 1000.0 AS t, CAST(amount AS DOUBLE) AS a, amount AS dec_amount,
         CASE WHEN status = 'FRAUD' THEN 1 ELSE 0 END AS cls, event_ms FROM tx)"""


def derive_transactions(spark, d):
    out = replay.card_rows_to_transactions(card_rows(spark, d), F.timestamp_seconds(F.lit(1704067200)))
    return out.select(
        "arrival", "user_id", "card_number", F.col("amount").cast("double").alias("amount"), "currency", "merchant_id",
        "country", "status", F.unix_millis("event_time").alias("event_ms"), "event_time_text",
    )


def feature_map(spark, d):
    rows = replay.card_rows_to_transactions(card_rows(spark, d), F.timestamp_seconds(F.lit(1704067200)))
    return rows.select(
        "arrival", F.size("features").alias("n"), F.round(F.col("features")["V1"], 6).alias("v1"),
        F.round(F.col("features")["V28"], 6).alias("v28"), F.col("features")["Amount"].alias("amount"),
        F.round(F.col("features")["Time"], 3).alias("time"),
    )


def feature_vector(spark, d):
    rows = replay.card_rows_to_transactions(card_rows(spark, d), F.timestamp_seconds(F.lit(1704067200)))
    vec = rows.select("arrival", F.posexplode(X.feature_array(F.col("features"), {"Amount": (20.0, 4.0), "Time": (100.0, 50.0)})))
    return vec.select("arrival", "pos", F.round("col", 6).alias("value"))


def feature_validation(spark, d):
    """Features with one kind of fault per country, and why each row would get no score."""
    rows = card_rows(spark, d).join(tx(spark, d).select(F.col("arrival").alias("idx"), "country", "id"), "idx")
    full = X.feature_map(F.col("components"), F.col("Amount"), F.col("Time"))
    features = (
        F.when(F.col("country") == "VN", F.lit(None))
        .when(F.col("country") == "US", F.map_filter(full, lambda k, _: F.lit(False)))
        .when(F.col("country") == "SG", F.map_filter(full, lambda k, _: k != "V7"))
        .when(F.col("country") == "JP", F.transform_values(full, lambda k, v: F.when(k == "Amount", -v - 1).otherwise(v)))
        .when(F.col("country") == "GB", F.transform_values(full, lambda k, v: F.when(k == "V3", F.lit(None)).otherwise(v)))
        .otherwise(full)
    )
    rows = with_once(rows, "features", features)
    return rows.select("id", F.coalesce(X.skip_reason(F.col("features")), F.lit("scored")).alias("outcome"))


def _storable(spark, d):
    return tx(spark, d).select(
        F.when(F.col("country") == "VN", F.lit(None)).otherwise(F.col("id")).alias("id"),
        F.when(F.col("country") == "US", F.repeat(F.col("user_id"), 60)).otherwise(F.col("user_id")).alias("user_id"),
        "card_number",
        F.when(F.col("country") == "SG", F.lit("123456789012.00")).otherwise(F.col("amount").cast("string")).alias("amount"),
        "currency", "merchant_id", "country",
        F.when(F.col("country") != "JP", F.col("status")).alias("status"),
        "event_time", "arrival",
    )


def conform_rejects(spark, d):
    _, bad = conform(_storable(spark, d), schemas.TRANSACTIONS_TABLE, {"ingested_at": F.current_timestamp()})
    return bad.groupBy("reject_reason").agg(F.count("*").alias("n"))


def transactions_sink_rows(spark, d):
    good, _ = conform(_storable(spark, d), schemas.TRANSACTIONS_TABLE, {"ingested_at": F.current_timestamp()})
    return good.select(
        "id", "user_id", "card_number", F.col("amount").cast("double").alias("amount"), "currency", "merchant_id",
        "country", "status", F.unix_millis("event_time").alias("event_ms"),
    )


def replay_schedule(spark, d):
    out = replay.schedule(card_rows(spark, d).select("idx", "Time"), speed=50.0)
    return out.select("idx", F.round("replay_delay_s", 5).alias("replay_delay_s"), F.round("send_at_s", 5).alias("send_at_s"))


def replay_head(spark, d):
    return replay.head(card_rows(spark, d), 25, fraud_only=True).select("idx", "Amount", "Class")


def replay_span(spark, d):
    return replay.span(card_rows(spark, d)).select("n", F.round("max_time_s", 3).alias("max_time_s"))


def running_fraud_total(spark, d):
    return replay.progress(card_rows(spark, d).select("idx", "Class")).select("idx", "sent", "fraud_total")


def _stored_alerts(spark, d):
    """The alert table written by day and source and read back; detection time stands at the trigger's event time."""
    rows = alerts(spark, d).withColumn("detected_at", F.timestamp_millis("event_ms"))
    path = run_dir(spark, "alerts")
    tables.write_alerts(materialize(rows.drop("event_ms"), "found-alerts"), path)  # ranges read their rows twice
    return tables.read_alerts(spark, path)


def alerts_recent(spark, d):
    return tables.alerts_recent(_stored_alerts(spark, d), 5).withColumn("amount", F.col("amount").cast("double"))


def alerts_by_user(spark, d):
    return tables.alerts_by_user(_stored_alerts(spark, d), "7").select("id", "pattern_id", "source")


def alerts_by_time(spark, d):
    found = tables.alerts_by_time(_stored_alerts(spark, d), "2024-01-10T00:00:00Z", "2024-01-12T00:00:00Z")
    return found.select("id", "pattern_id", F.unix_millis("detected_at").alias("detected_ms"))


def alerts_by_source(spark, d):
    return tables.alerts_by_source(_stored_alerts(spark, d), "ML").select("id", "severity", "user_id")


def txn_by_user_time(spark, d):
    """The transaction table written by day and read back for one user and time span."""
    rows, _ = conform(tx(spark, d), schemas.TRANSACTIONS_TABLE, {"ingested_at": F.current_timestamp()})
    path = run_dir(spark, "transactions")
    tables.write_transactions(rows, path)
    found = tables.transactions_by_user_time(spark.read.parquet(path), "7", "2024-01-05T00:00:00Z", "2024-01-25T00:00:00Z")
    return found.select("id", F.col("amount").cast("double").alias("amount"), F.unix_millis("event_time").alias("event_ms"))


DEC = f"""WITH {TX_SQL}, marked AS (SELECT t.*, e.event_id, {REASON_SQL.replace('event_id', 'e.event_id')} AS reason FROM tx t JOIN events e ON t.arrival = e.event_id)"""
STORE_SQL = f"""WITH {TX_SQL}, s AS (SELECT *, CASE country WHEN 'VN' THEN 'id_null' WHEN 'US' THEN
  CASE WHEN length(user_id) * 60 > 50 THEN 'user_id_too_long' END WHEN 'SG' THEN 'amount_not_storable' WHEN 'JP' THEN 'status_null' END AS reject_reason FROM tx)"""
QUERIES = {
    "decode_valid": (
        decode_valid,
        f"{DEC} SELECT id, user_id, card_number, CAST(amount AS DOUBLE) AS amount, currency, merchant_id, country, status, event_ms FROM marked WHERE reason IS NULL",
    ),
    "decode_malformed_by_reason": (decode_malformed_by_reason, f"{DEC} SELECT reason, count(*) AS n FROM marked WHERE reason IS NOT NULL GROUP BY reason"),
    "quality_counts": (quality_counts, f"{DEC} SELECT count(*) FILTER (WHERE reason IS NULL) AS valid, count(*) FILTER (WHERE reason IS NOT NULL) AS malformed FROM marked"),
    "decode_rules": (
        decode_rules,
        f"""WITH {TX_SQL} SELECT 'R' || user_id AS rule_id, 'limit' AS rule_name, status <> 'FRAUD' AS enabled,
        CAST(amount AS DOUBLE) AS threshold_amount, CAST(NULL AS DOUBLE) AS threshold_amount_high,
        CASE WHEN status = 'FRAUD' THEN 0 ELSE 60 END AS window_seconds, 0 AS min_occurrences,
        CAST(NULL AS VARCHAR) AS severity, arrival AS rule_seq FROM tx WHERE country NOT IN ('MY','TH','AU')""",
    ),
    "rules_file_scan": (
        rules_file_scan,
        """SELECT 'R' || p_partkey AS "ruleId", p_name AS "ruleName", p_size > 10 AS enabled, p_retailprice AS "thresholdAmount",
        CAST(NULL AS DOUBLE) AS "thresholdAmountHigh", p_size AS "windowSeconds" FROM part""",
    ),
    "derive_transactions": (
        derive_transactions,
        f"""WITH {TX_SQL}, {CARD_SQL} SELECT idx AS arrival, printf('user_%04d', idx % 500) AS user_id,
        printf('4%03d-xxxx-xxxx-%04d', idx % 500, CAST(floor(dec_amount) AS BIGINT) % 9999) AS card_number,
        a AS amount, 'EUR' AS currency, printf('MER-%04d', idx % 1000) AS merchant_id,
        ['VN','US','SG','JP','GB','DE','FR','AU','TH','MY'][idx % 10 + 1] AS country,
        CASE WHEN cls = 1 THEN 'FRAUD' ELSE 'SUCCESS' END AS status, event_ms,
        strftime(make_timestamp(event_ms * 1000), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS event_time_text FROM card""",
    ),
    "feature_map": (
        feature_map,
        f"""WITH {TX_SQL}, {CARD_SQL} SELECT idx AS arrival, 30 AS n, round(a * -13 / 100, 6) AS v1, round(a * 14 / 100, 6) AS v28,
        a AS amount, round(t, 3) AS time FROM card""",
    ),
    "feature_vector": (
        feature_vector,
        f"""WITH {TX_SQL}, {CARD_SQL} SELECT idx AS arrival, p AS pos, round(CASE WHEN p < 28 THEN a * (p - 13) / 100
        WHEN p = 28 THEN (a - 20.0) / 4.0 ELSE (t - 100.0) / 50.0 END, 6) AS value FROM card, range(30) r(p)""",
    ),
    "feature_validation": (
        feature_validation,
        f"""WITH {TX_SQL} SELECT id, CASE country WHEN 'VN' THEN 'no_features' WHEN 'US' THEN 'no_features' WHEN 'SG' THEN 'missing_feature'
        WHEN 'JP' THEN 'out_of_range' WHEN 'GB' THEN 'missing_feature' ELSE 'scored' END AS outcome FROM tx""",
    ),
    "conform_rejects": (conform_rejects, f"{STORE_SQL} SELECT reject_reason, count(*) AS n FROM s WHERE reject_reason IS NOT NULL GROUP BY reject_reason"),
    "transactions_sink_rows": (
        transactions_sink_rows,
        f"""{STORE_SQL} SELECT id, user_id, card_number, CAST(amount AS DOUBLE) AS amount, currency, merchant_id, country, status, event_ms
        FROM s WHERE reject_reason IS NULL""",
    ),
    "replay_schedule": (
        replay_schedule,
        f"""WITH {TX_SQL}, {CARD_SQL}, g AS (SELECT idx, (t - lag(t) OVER (ORDER BY idx)) / 50.0 AS gap FROM card),
        k AS (SELECT idx, CASE WHEN gap > 0 AND gap < 5 THEN CAST(gap AS DOUBLE) ELSE 0.0 END AS delay FROM g)
        SELECT idx, round(delay, 5) AS replay_delay_s, round(sum(delay) OVER (ORDER BY idx), 5) AS send_at_s FROM k""",
    ),
    "replay_head": (replay_head, f'WITH {TX_SQL}, {CARD_SQL} SELECT idx, a AS "Amount", cls AS "Class" FROM card WHERE cls = 1 ORDER BY idx LIMIT 25'),
    "replay_span": (replay_span, f"WITH {TX_SQL}, {CARD_SQL} SELECT count(*) AS n, round(max(t), 3) AS max_time_s FROM card"),
    "running_fraud_total": (
        running_fraud_total,
        f"WITH {TX_SQL}, {CARD_SQL} SELECT idx, count(*) OVER (ORDER BY idx) AS sent, CAST(sum(cls) OVER (ORDER BY idx) AS BIGINT) AS fraud_total FROM card",
    ),
    "alerts_recent": (
        alerts_recent,
        f"""{ALL_SQL} SELECT pattern_name, severity, amount, source FROM (SELECT a.*, t.event_ms FROM alerts a JOIN tx t ON t.id = a.transaction_id)
        ORDER BY event_ms DESC, id LIMIT 5""",
    ),
    "alerts_by_user": (alerts_by_user, f"{ALL_SQL} SELECT id, pattern_id, source FROM alerts WHERE user_id = '7'"),
    "alerts_by_time": (
        alerts_by_time,
        f"""{ALL_SQL} SELECT a.id, pattern_id, event_ms AS detected_ms FROM alerts a JOIN tx t ON t.id = a.transaction_id
        WHERE event_ms >= epoch_ms(TIMESTAMP '2024-01-10') AND event_ms < epoch_ms(TIMESTAMP '2024-01-12')""",
    ),
    "alerts_by_source": (alerts_by_source, f"{ALL_SQL} SELECT id, severity, user_id FROM alerts WHERE source = 'ML'"),
    "txn_by_user_time": (
        txn_by_user_time,
        f"""WITH {TX_SQL} SELECT id, CAST(amount AS DOUBLE) AS amount, event_ms FROM tx WHERE user_id = '7'
        AND event_time >= TIMESTAMP '2024-01-05' AND event_time < TIMESTAMP '2024-01-25'""",
    ),
}
