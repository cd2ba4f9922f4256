"""Alert rows: ids, texts, bands and the outgoing JSON record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnguard.operators.patterns import PatternRule

ALERT_COLUMNS = [
    "id", "transaction_id", "user_id", "pattern_id", "pattern_name", "severity", "amount", "description", "source",
    "ml_probability", "detected_at",
]
# Fixed values of model alerts.
ML_PATTERN, ML_NAME, ML_LABEL = "ML001", "XGBoost ML Detection", "XGBoost"


def alert_id(pattern_id: Column, *trigger: Column) -> Column:
    """The same match always gets the same id, so a replay cannot add a second alert."""
    return F.md5(F.concat_ws("|", pattern_id, *trigger))


def random_id() -> Column:
    return F.uuid()


def severity_band(probability: Column) -> Column:
    return F.when(probability >= 0.9, "CRITICAL").otherwise("HIGH")


def plain(value: float) -> str:
    """50.0 as ``50`` and 12.5 as ``12.5``."""
    return str(int(value)) if float(value).is_integer() else str(value)


def to_alert(
    df: DataFrame,
    pattern_id: Column,
    name: Column,
    severity: Column,
    description: Column,
    trigger: Sequence[str] = ("id",),
    source: str = "CEP",
    probability: Column | None = None,
) -> DataFrame:
    """One projection from matched transactions to alert rows; rule alerts carry probability 0.0, never null."""
    return df.select(
        alert_id(pattern_id, *[F.col(t) for t in trigger]).alias("id"),
        F.col("id").alias("transaction_id"),
        "user_id",
        pattern_id.alias("pattern_id"),
        name.alias("pattern_name"),
        severity.alias("severity"),
        F.col("amount").cast("double").alias("amount"),
        description.alias("description"),
        F.lit(source).alias("source"),
        (F.lit(0.0) if probability is None else probability).alias("ml_probability"),
        F.current_timestamp().alias("detected_at"),
        *[c for c in ("event_ms",) if c in df.columns],
    )


def _by_rule(df: DataFrame, rule: PatternRule, description: Column, trigger: Sequence[str]) -> DataFrame:
    return to_alert(df, F.lit(rule.rule_id), F.lit(rule.name), F.lit(rule.severity), description, trigger)


# The wording of the alert texts below.


def rapid_small_text(rule: PatternRule) -> Column:
    text = f"{rule.times} transactions under {plain(rule.high)} EUR within {rule.window_s}s on card "
    return F.concat(F.lit(text), "card_number")


def midrange_text(rule: PatternRule) -> Column:
    span = f"between {plain(rule.low)}-{plain(rule.high)}" if rule.high is not None else f"from {plain(rule.low)}"
    return F.concat(F.lit(f"{rule.times} transactions {span} EUR within {rule.window_s}s on card "), "card_number")


def fail_success_text(rule: PatternRule) -> Column:
    return F.concat(F.lit(f"{rule.times} fraud attempts followed by success for "), "user_id")


def sequence_alerts(matches: DataFrame, rules: dict[str, PatternRule]) -> DataFrame:
    """Alert rows from matches of any sequence pattern, told apart by ``pattern_id``, in one projection."""
    pid = F.col("pattern_id")
    name, severity, text = F.lit(None), F.lit(None), F.lit(None)
    texts = {"P001": rapid_small_text, "P003": fail_success_text, "P004": midrange_text}
    for rule_id, text_of in texts.items():
        if rule_id in rules:
            rule = rules[rule_id]
            name = F.when(pid == rule_id, rule.name).otherwise(name)
            severity = F.when(pid == rule_id, rule.severity).otherwise(severity)
            text = F.when(pid == rule_id, text_of(rule)).otherwise(text)
    return to_alert(matches, pid, name, severity, text, ("first_id", "id"))


def rapid_small_alerts(matches: DataFrame, rule: PatternRule) -> DataFrame:
    return _by_rule(matches, rule, rapid_small_text(rule), ("first_id", "id"))


def midrange_alerts(matches: DataFrame, rule: PatternRule) -> DataFrame:
    return _by_rule(matches, rule, midrange_text(rule), ("first_id", "id"))


def fail_success_alerts(matches: DataFrame, rule: PatternRule) -> DataFrame:
    return _by_rule(matches, rule, fail_success_text(rule), ("first_id", "id"))


def new_country_text() -> Column:
    return F.format_string(
        "%.2f EUR in new country '%s' for user %s", F.col("amount").cast("double"), F.col("country"), F.col("user_id")
    )


def new_country_alerts(matches: DataFrame, rule: PatternRule) -> DataFrame:
    return _by_rule(matches, rule, new_country_text(), ("id",))


def new_country_rule_alerts(matches: DataFrame) -> DataFrame:
    """Matches joined to a rule version: name and severity come from that version."""
    return to_alert(
        matches, F.lit("P002"), F.col("rule_name"), F.col("severity"), new_country_text()
    )


def model_alerts(scored: DataFrame, threshold: float = 0.5, label: str = ML_LABEL) -> DataFrame:
    p = F.col("fraud_probability")
    text = F.format_string("%s fraud probability %.1f%%", F.lit(label), p * 100)
    return to_alert(
        scored.filter(p >= threshold), F.lit(ML_PATTERN), F.lit(ML_NAME), severity_band(p), text,
        source="ML", probability=p,
    )


def write_defaults(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("source", F.coalesce("source", F.lit("CEP")))


def time_default(transactions: DataFrame) -> DataFrame:
    return transactions.withColumn("event_time", F.coalesce("event_time", F.current_timestamp()))


def to_records(alerts: DataFrame) -> DataFrame:
    """Outgoing ``key``/``value`` rows: key = user id, value = camelCase JSON, times as epoch seconds.

    Alerts without a user id cannot be keyed and are left out; ``null_keys`` counts them.
    """
    body = F.struct(
        "id",
        F.col("transaction_id").alias("transactionId"),
        F.col("user_id").alias("userId"),
        F.col("pattern_id").alias("patternId"),
        F.col("pattern_name").alias("patternName"),
        "severity",
        F.col("amount").cast("double").alias("amount"),
        "description",
        "source",
        F.col("ml_probability").cast("double").alias("mlProbability"),
        (F.unix_micros("detected_at").cast("decimal(20,0)") / F.lit(1000000)).cast("decimal(20,6)").alias("detectedAt"),
    )
    keyed = alerts.filter(F.col("user_id").isNotNull())
    return keyed.select(
        F.col("user_id").cast("binary").alias("key"),
        F.to_json(body, {"ignoreNullFields": "false"}).alias("value"),
    )


def null_keys(alerts: DataFrame, column: str = "user_id") -> DataFrame:
    return alerts.agg(F.count_if(F.col(column).isNull()).alias("null_keys"))
