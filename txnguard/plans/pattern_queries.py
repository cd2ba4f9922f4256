"""Registered queries: patterns, rules, alert rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnguard.functions import alerts as A
from txnguard.operators import detect, merge
from txnguard.operators import patterns as P
from txnguard.operators import rules as R
from txnguard.plans.inputs import TX_SQL, WIDE, tx

# Columns of an alert that do not depend on the clock.
ALERT = [
    "id", "transaction_id", "user_id", "pattern_id", "pattern_name", "severity", "amount", "description", "source",
    "ml_probability",
]


def changelog(spark: SparkSession) -> DataFrame:
    """Control data: on at day 3, raised at day 10, off at day 20, on again at day 25."""
    return spark.sql(
        """
        SELECT rule_id, rule_name, enabled, threshold_amount, severity, to_timestamp(at) AS rule_ts, rule_seq
        FROM VALUES
          ('P002', 'High Value New Location', true, 50D, 'CRITICAL', '2024-01-03T00:00:00Z', 1L),
          ('P002', 'High Value New Location', true, 100D, 'HIGH', '2024-01-10T00:00:00Z', 2L),
          ('P002', 'High Value New Location', false, 100D, 'HIGH', '2024-01-20T00:00:00Z', 3L),
          ('P002', 'High Value New Location', true, 20D, 'MEDIUM', '2024-01-25T00:00:00Z', 4L)
          AS log(rule_id, rule_name, enabled, threshold_amount, severity, at, rule_seq)
        """
    )


CHANGELOG_SQL = """rule_log AS (
  SELECT * FROM (VALUES
    ('P002','High Value New Location',true,50.0,'CRITICAL',TIMESTAMP '2024-01-03',1),
    ('P002','High Value New Location',true,100.0,'HIGH',TIMESTAMP '2024-01-10',2),
    ('P002','High Value New Location',false,100.0,'HIGH',TIMESTAMP '2024-01-20',3),
    ('P002','High Value New Location',true,20.0,'MEDIUM',TIMESTAMP '2024-01-25',4))
  v(rule_id,rule_name,enabled,threshold_amount,severity,rule_ts,rule_seq))"""


def derived_changelog(events: DataFrame) -> DataFrame:
    """A rule per user whose settings change with every event of that user."""
    return events.select(
        F.concat(F.lit("R"), "user_id").alias("rule_id"),
        F.col("value").alias("threshold_amount"),
        (F.col("status") != "FRAUD").alias("enabled"),
        "severity",
        F.col("event_time").alias("rule_ts"),
        F.col("arrival").alias("rule_seq"),
    )


def _user_rules(spark, d):
    log = tx(spark, d).withColumn("value", F.col("amount").cast("double")).withColumn(
        "severity", F.when(F.col("amount") >= 100, "HIGH").otherwise("LOW")
    )
    return derived_changelog(log)


USER_RULES_SQL = """user_rules AS (
  SELECT 'R' || user_id AS rule_id, CAST(amount AS DOUBLE) AS threshold_amount, status <> 'FRAUD' AS enabled,
         CASE WHEN amount >= 100 THEN 'HIGH' ELSE 'LOW' END AS severity, arrival AS rule_seq FROM tx)"""

P001_SQL = """p001 AS (
  SELECT *, lag(id, 2) OVER w AS first_id, event_ms - lag(event_ms, 2) OVER w AS gap
  FROM tx WHERE amount < 50 AND status = 'SUCCESS'
  WINDOW w AS (PARTITION BY card_number ORDER BY event_ms, arrival) QUALIFY gap < 86400000)"""
P004_SQL = """p004 AS (
  SELECT *, lag(id) OVER w AS first_id, event_ms - lag(event_ms) OVER w AS gap
  FROM tx WHERE amount BETWEEN 50 AND 500 AND status = 'SUCCESS'
  WINDOW w AS (PARTITION BY card_number ORDER BY event_ms, arrival) QUALIFY gap < 21600000)"""
P003_SQL = """p003 AS (
  SELECT s.*, f.first_id FROM (
    SELECT user_id, nxt, lag(id) OVER (PARTITION BY user_id ORDER BY event_ms, arrival) AS first_id,
           lag(event_ms) OVER (PARTITION BY user_id ORDER BY event_ms, arrival) AS first_ms
    FROM (SELECT *, lead(CASE WHEN status = 'SUCCESS' THEN arrival END IGNORE NULLS)
                      OVER (PARTITION BY user_id ORDER BY event_ms, arrival) AS nxt FROM tx)
    WHERE status = 'FRAUD') f
  JOIN tx s ON s.arrival = f.nxt WHERE s.event_ms - f.first_ms < 86400000)"""
P002_SQL = """seen AS (
  SELECT * FROM tx WHERE country IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY user_id, country ORDER BY arrival) = 1)"""


def alert_sql(src: str, pid: str, name: str, severity: str, text: str, trigger: str, source="'CEP'", prob="0.0") -> str:
    return f"""SELECT md5(concat_ws('|', {pid}, {trigger})) AS id, id AS transaction_id, user_id,
  {pid} AS pattern_id, {name} AS pattern_name, {severity} AS severity, CAST(amount AS DOUBLE) AS amount,
  {text} AS description, {source} AS source, CAST({prob} AS DOUBLE) AS ml_probability FROM {src}"""


A001 = alert_sql(
    "p001", "'P001'", "'Rapid Small Transactions'", "'HIGH'",
    "'3 transactions under 50 EUR within 86400s on card ' || card_number", "first_id, id",
)
A003 = alert_sql(
    "p003", "'P003'", "'Multiple Fraud Then Success'", "'HIGH'",
    "'2 fraud attempts followed by success for ' || user_id", "first_id, id",
)
A004 = alert_sql(
    "p004", "'P004'", "'Mid-Range Velocity'", "'MEDIUM'",
    "'2 transactions between 50-500 EUR within 21600s on card ' || card_number", "first_id, id",
)
NEW_TEXT = "printf('%.2f EUR in new country ''%s'' for user %s', amount, country, user_id)"
A002 = alert_sql(
    "(SELECT * FROM seen WHERE amount > 50)", "'P002'", "'High Value New Location'", "'CRITICAL'", NEW_TEXT, "id"
)
ML_BAND = "CASE WHEN score >= 0.9 THEN 'CRITICAL' ELSE 'HIGH' END"
# Percent text: the double product's shortest decimal form, rounded half up, as the formatter does.
ML_TEXT = "'XGBoost fraud probability ' || CAST(CAST(CAST(score * 100 AS VARCHAR) AS DECIMAL(18,1)) AS VARCHAR) || '%'"
AML = alert_sql(
    "(SELECT * FROM tx WHERE score >= 0.5)", "'ML001'", "'XGBoost ML Detection'", ML_BAND,
    ML_TEXT, "id", "'ML'", "score",
)
WITH_ALL = f"WITH {TX_SQL}, {P001_SQL}, {P003_SQL}, {P004_SQL}, {P002_SQL}"
ALL_SQL = f"{WITH_ALL}, alerts AS ({A001} UNION ALL {A003} UNION ALL {A004} UNION ALL {A002} UNION ALL {AML})"


def scored(spark, d) -> DataFrame:
    return tx(spark, d).withColumn("fraud_probability", F.col("score"))


def alerts(spark: SparkSession, d: str) -> DataFrame:
    """The whole alert table, with ``event_ms``."""
    return detect.detect_all(tx(spark, d), WIDE, scored=scored(spark, d))


def all_alerts(spark, d):
    return alerts(spark, d).select(*ALERT)


def p001(spark, d):
    return A.rapid_small_alerts(P.rapid_small(tx(spark, d), WIDE["P001"]), WIDE["P001"]).select(*ALERT)


def p003(spark, d):
    return A.fail_success_alerts(P.fail_then_success(tx(spark, d), WIDE["P003"]), WIDE["P003"]).select(*ALERT)


def p004(spark, d):
    return A.midrange_alerts(P.midrange_velocity(tx(spark, d), WIDE["P004"]), WIDE["P004"]).select(*ALERT)


def p002(spark, d):
    return A.new_country_alerts(P.new_country(tx(spark, d), WIDE["P002"]), WIDE["P002"]).select(*ALERT)


def sequence_generic(spark, d):
    found = P.match_sequence(
        tx(spark, d), "user_id", [("failed", P.is_failed(), 2), ("success", P.is_success(), 1)], 86_400
    )
    return found.select(
        "user_id",
        F.element_at("failed", 1)["id"].alias("first_failed"),
        F.element_at("failed", 2)["id"].alias("second_failed"),
        F.element_at("success", 1)["id"].alias("success_id"),
    )


SEQUENCE_SQL = f"""WITH {TX_SQL}
SELECT f.user_id, f.first_failed, f.second_failed, s.id AS success_id FROM (
  SELECT user_id, nxt, id AS second_failed, lag(id) OVER (PARTITION BY user_id ORDER BY event_ms, arrival) AS first_failed,
         lag(event_ms) OVER (PARTITION BY user_id ORDER BY event_ms, arrival) AS first_ms
  FROM (SELECT *, lead(CASE WHEN status = 'SUCCESS' THEN arrival END IGNORE NULLS)
                    OVER (PARTITION BY user_id ORDER BY event_ms, arrival) AS nxt FROM tx)
  WHERE status = 'FRAUD') f
JOIN tx s ON s.arrival = f.nxt WHERE s.event_ms - f.first_ms < 86400000"""


def filter_small_success(spark, d):
    return tx(spark, d).filter(P.is_small(WIDE["P001"])).select("id", "user_id", F.col("amount").cast("double").alias("amount"))


def filter_midrange(spark, d):
    return tx(spark, d).filter(P.is_midrange(WIDE["P004"])).select("id", "user_id", F.col("amount").cast("double").alias("amount"))


def filter_midrange_open(spark, d):
    rule = WIDE["P004"].with_(high=None)
    return tx(spark, d).filter(P.is_midrange(rule)).select("id", "user_id", F.col("amount").cast("double").alias("amount"))


def filter_fraud_only(spark, d):
    return tx(spark, d).filter(P.is_failed()).select("id", "user_id", F.col("amount").cast("double").alias("amount"))


def alert_projection(spark, d):
    rows = tx(spark, d).filter(P.is_failed())
    out = A.to_alert(rows, F.lit("P000"), F.lit("Failed"), F.lit("LOW"), F.concat(F.lit("failed on "), "card_number"))
    return out.select(*ALERT)


def ml_severity_band(spark, d):
    s = scored(spark, d)
    return s.select("id", F.col("score").alias("probability"), A.severity_band(F.col("score")).alias("severity"))


def alert_ids(spark, d):
    return tx(spark, d).select(
        "id",
        A.alert_id(F.lit("P002"), F.col("id")).alias("alert_id"),
        A.alert_id(F.lit("P003"), F.col("user_id"), F.col("id")).alias("pair_alert_id"),
    )


def write_defaults(spark, d):
    rows = tx(spark, d).select("id", F.when(F.col("score") >= 0.5, "ML").alias("source"))
    return A.write_defaults(rows).select("id", "source")


def alert_json(spark, d):
    """The outgoing records, parsed back into columns so that the text form does not matter."""
    records = A.to_records(alerts(spark, d))
    body = F.from_json(
        "value",
        "id string, transactionId string, userId string, patternId string, patternName string, severity string, "
        "amount double, description string, source string, mlProbability double, detectedAt double",
    )
    fields = ["id", "transactionId", "userId", "patternId", "patternName", "severity", "amount", "description", "source"]
    rec = records.select(F.col("key").cast("string").alias("key"), body.alias("b"))
    return rec.select("key", *[F.col(f"b.{f}").alias(f) for f in fields],
                      F.round("b.mlProbability", 6).alias("mlProbability"),
                      (F.col("b.detectedAt") > 1.7e9).alias("has_time"))


def rule_current(spark, d):
    return R.rule_current(_user_rules(spark, d)).select("rule_id", "threshold_amount", "severity", "rule_seq")


def rule_changelog_collapse(spark, d):
    return R.rule_latest(_user_rules(spark, d)).select("rule_id", "enabled", "threshold_amount", "severity", "rule_seq")


def rule_asof_join(spark, d):
    joined = R.rule_as_of(tx(spark, d), changelog(spark), "P002")
    return joined.select("id", "severity", "threshold_amount")


def event_changelog(spark, d) -> DataFrame:
    """A version of one rule with every event, so that the log is as long as the table."""
    t = tx(spark, d)
    return t.select(
        F.lit("P002").alias("rule_id"), F.col("user_id").alias("rule_name"), (F.col("status") != "FRAUD").alias("enabled"),
        F.col("amount").cast("double").alias("threshold_amount"), F.lit("LOW").alias("severity"),
        F.timestamp_millis("event_ms").alias("rule_ts"), F.col("arrival").alias("rule_seq"),
    )


def rule_asof_large(spark, d):
    joined = R.rule_as_of(tx(spark, d), event_changelog(spark, d), "P002")
    return joined.select("id", "rule_name", "threshold_amount")


def detect_dynamic(spark, d):
    """All patterns under a log that omits numbers (decoded as 0), switches one pattern off and changes another."""
    log = spark.sql(
        """
        SELECT rule_id, rule_name, enabled, threshold_amount, CAST(NULL AS DOUBLE) AS threshold_amount_high, 0 AS window_seconds,
               0 AS min_occurrences, severity, to_timestamp('2024-01-01T00:00:00Z') AS rule_ts, rule_seq
        FROM VALUES ('P001', CAST(NULL AS STRING), true, 0D, CAST(NULL AS STRING), 1L), ('P003', 'Off', false, 0D, 'LOW', 2L),
          ('P004', 'Midrange', true, 80D, 'LOW', 3L), ('P002', 'Place', true, 60D, 'HIGH', 4L)
          AS log(rule_id, rule_name, enabled, threshold_amount, severity, rule_seq)
        """
    )
    found = detect.detect_all(tx(spark, d), WIDE, changelog=log, mode="dynamic")
    return found.groupBy("pattern_id", "pattern_name", "severity").agg(F.count("*").alias("n"))


def p002_dynamic(spark, d):
    return R.new_country_dynamic(tx(spark, d), changelog(spark)).select(*ALERT)


def split_for_merge(spark, d):
    """A target that already holds the failed rows, and a batch with every row twice in arrival order."""
    t = tx(spark, d).select("id", "arrival", "user_id", "status", F.col("amount").cast("double").alias("amount"))
    again = t.withColumn("arrival", F.col("arrival") + 1_000_000_000).withColumn("amount", -F.col("amount"))
    return t.filter(P.is_failed()), t.unionByName(again)


def upsert_ignore_anti(spark, d):
    target, batch = split_for_merge(spark, d)
    return merge.new_rows(batch, target).select("id", "user_id", "amount")


def dedupe_first(spark, d):
    _, batch = split_for_merge(spark, d)
    return merge.dedupe_first(batch).select("id", "user_id", "status", "amount")


SIMPLE = "id, user_id, CAST(amount AS DOUBLE) AS amount"
P002_DYNAMIC_SQL = (
    f"WITH {TX_SQL}, {P002_SQL}, {CHANGELOG_SQL}, hit AS (SELECT seen.*, rule_name, severity AS sev FROM seen "
    f"ASOF JOIN rule_log ON event_time >= rule_ts WHERE enabled AND amount > threshold_amount) "
    + alert_sql("hit", "'P002'", "rule_name", "sev", NEW_TEXT, "id")
)
QUERIES = {
    "all_alerts": (all_alerts, f"{ALL_SQL} SELECT * FROM alerts"),
    "p001_rapid_small": (p001, f"WITH {TX_SQL}, {P001_SQL} {A001}"),
    "p003_fail_then_success": (p003, f"WITH {TX_SQL}, {P003_SQL} {A003}"),
    "p004_midrange": (p004, f"WITH {TX_SQL}, {P004_SQL} {A004}"),
    "p002_new_country": (p002, f"WITH {TX_SQL}, {P002_SQL} {A002}"),
    "sequence_generic": (sequence_generic, SEQUENCE_SQL),
    "filter_small_success": (filter_small_success, f"WITH {TX_SQL} SELECT {SIMPLE} FROM tx WHERE amount < 50 AND status = 'SUCCESS'"),
    "filter_midrange": (filter_midrange, f"WITH {TX_SQL} SELECT {SIMPLE} FROM tx WHERE amount BETWEEN 50 AND 500 AND status = 'SUCCESS'"),
    "filter_midrange_open": (filter_midrange_open, f"WITH {TX_SQL} SELECT {SIMPLE} FROM tx WHERE amount >= 50 AND status = 'SUCCESS'"),
    "filter_fraud_only": (filter_fraud_only, f"WITH {TX_SQL} SELECT {SIMPLE} FROM tx WHERE status = 'FRAUD'"),
    "alert_projection": (
        alert_projection,
        f"WITH {TX_SQL} " + alert_sql("tx", "'P000'", "'Failed'", "'LOW'", "'failed on ' || card_number", "id") + " WHERE status = 'FRAUD'",
    ),
    "ml_severity_band": (ml_severity_band, f"WITH {TX_SQL} SELECT id, score AS probability, {ML_BAND} AS severity FROM tx"),
    "alert_ids": (
        alert_ids,
        f"WITH {TX_SQL} SELECT id, md5(concat_ws('|','P002',id)) AS alert_id, md5(concat_ws('|','P003',user_id,id)) AS pair_alert_id FROM tx",
    ),
    "write_defaults": (write_defaults, f"WITH {TX_SQL} SELECT id, coalesce(CASE WHEN score >= 0.5 THEN 'ML' END, 'CEP') AS source FROM tx"),
    "alert_json": (
        alert_json,
        f"""{ALL_SQL} SELECT user_id AS key, id, transaction_id AS "transactionId", user_id AS "userId", pattern_id AS "patternId",
        pattern_name AS "patternName", severity, amount, description, source, round(ml_probability, 6) AS "mlProbability",
        true AS has_time FROM alerts""",
    ),
    "rule_current": (
        rule_current,
        f"""WITH {TX_SQL}, {USER_RULES_SQL}, newest AS (SELECT * FROM user_rules
        QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY rule_seq DESC) = 1)
        SELECT rule_id, threshold_amount, severity, rule_seq FROM newest WHERE enabled""",
    ),
    "rule_changelog_collapse": (
        rule_changelog_collapse,
        f"""WITH {TX_SQL}, {USER_RULES_SQL} SELECT rule_id, enabled, threshold_amount, severity, rule_seq FROM user_rules
        QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY rule_seq DESC) = 1""",
    ),
    "rule_asof_join": (
        rule_asof_join,
        f"""WITH {TX_SQL}, {CHANGELOG_SQL} SELECT id, severity, CAST(threshold_amount AS DOUBLE) AS threshold_amount
        FROM tx ASOF JOIN rule_log ON event_time >= rule_ts WHERE enabled""",
    ),
    "rule_asof_large": (
        rule_asof_large,
        f"""WITH {TX_SQL}, versions AS (SELECT event_ms AS from_ms, arg_max(user_id, arrival) AS rule_name,
          arg_max(CAST(amount AS DOUBLE), arrival) AS threshold_amount, arg_max(status <> 'FRAUD', arrival) AS enabled FROM tx GROUP BY 1)
        SELECT id, rule_name, threshold_amount FROM tx ASOF JOIN versions ON event_ms >= from_ms WHERE enabled""",
    ),
    "detect_dynamic": (
        detect_dynamic,
        f"""WITH {TX_SQL}, {P001_SQL}, {P002_SQL}, mid AS (SELECT event_ms - lag(event_ms) OVER w AS gap FROM tx
          WHERE amount BETWEEN 80 AND 500 AND status = 'SUCCESS' WINDOW w AS (PARTITION BY card_number ORDER BY event_ms, arrival)
          QUALIFY gap < 21600000),
        every AS (SELECT 'P001' AS pattern_id, '{WIDE["P001"].name}' AS pattern_name, '{WIDE["P001"].severity}' AS severity FROM p001
          UNION ALL SELECT 'P004', 'Midrange', 'LOW' FROM mid UNION ALL SELECT 'P002', 'Place', 'HIGH' FROM seen WHERE amount > 60)
        SELECT pattern_id, pattern_name, severity, count(*) AS n FROM every GROUP BY ALL""",
    ),
    "p002_dynamic": (
        p002_dynamic,
        P002_DYNAMIC_SQL,
    ),
    "upsert_ignore_anti": (
        upsert_ignore_anti,
        f"WITH {TX_SQL} SELECT {SIMPLE} FROM tx WHERE status <> 'FRAUD'",
    ),
    "dedupe_first": (dedupe_first, f"WITH {TX_SQL} SELECT id, user_id, status, CAST(amount AS DOUBLE) AS amount FROM tx"),
}
