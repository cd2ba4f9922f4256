"""JSON record decoding. A bad record is counted under a reason and dropped; it never fails a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnguard import schemas
from txnguard.functions.once import with_once

REASONS = ("null_value", "bad_json", "unknown_field", "bad_type", "missing_required")

# Accepted spellings of an instant, and of a number written as text.
ISO_INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:?\d{2})$"
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def instant(text: Column) -> Column:
    """ISO-8601 text with an offset, or epoch seconds with an optional fraction; null when it is neither."""
    seconds = F.when(text.rlike(NUMBER), text.try_cast("decimal(38,9)"))
    return F.coalesce(
        F.when(text.rlike(ISO_INSTANT), F.try_to_timestamp(text)),
        F.timestamp_micros(F.floor(seconds * 1000000).cast("long")),
    )


def number(text: Column, kind: str) -> Column:
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast(kind))


def _is_nested(field: Column, record: Column, name: str) -> Column:
    """Whether the field holds an object or array. Nested JSON arrives as its text, so text that starts like it is
    looked up again with its type; that is rare."""
    suspect = F.ltrim(field).startswith("{") | F.ltrim(field).startswith("[")
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(record), f"$.{name}", "variant"))
    return F.coalesce(F.when(suspect, kind.startswith("OBJECT") | kind.startswith("ARRAY")), F.lit(False))


def _blank_to_null(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)


def _parsed(value: Column, ddl: str) -> Column:
    return F.from_json(value, ddl + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", "allowSingleQuotes": "false"})


def _unknown_fields(value: Column, allowed: Sequence[str]) -> Column:
    extra = F.array_except(F.json_object_keys(value), F.array(*[F.lit(a) for a in allowed]))
    return F.coalesce(F.size(extra) > 0, F.lit(False))


def _is_object(value: Column) -> Column:
    return F.coalesce(F.ltrim(value).startswith("{"), F.lit(False))


def classify_transactions(raw: DataFrame) -> DataFrame:
    """Every raw record with its decoded fields and ``reason`` (null when the record is valid)."""
    text = raw.withColumn("_text", F.col("value").cast("string"))
    rec = with_once(text, "_r", _parsed(F.col("_text"), schemas.TRANSACTION_TEXT))
    amount_text, time_text = _blank_to_null(F.col("_r.amount")), _blank_to_null(F.col("_r.eventTime"))
    features_text = F.col("_r.mlFeatures")
    features = F.from_json(features_text, "map<string,string>")
    rec = rec.withColumns(
        {
            "id": F.col("_r.id"),
            "user_id": F.col("_r.userId"),
            "card_number": F.col("_r.cardNumber"),
            "amount": F.trim(amount_text).try_cast("decimal(38,18)"),
            "currency": F.col("_r.currency"),
            "merchant_id": F.col("_r.merchantId"),
            "country": F.col("_r.country"),
            "status": F.col("_r.status"),
            "event_time": instant(time_text),
            "_features": features,
        }
    )
    rec = rec.withColumn("features", F.transform_values("_features", lambda _, v: number(v, "double")))
    bad_feature = F.exists(
        F.map_values("_features"), lambda v: F.coalesce(F.trim(v) != "", F.lit(False)) & number(v, "double").isNull()
    )
    text_fields = ["id", "userId", "cardNumber", "currency", "merchantId", "country", "status"]
    nested_text = F.lit(False)
    for name in text_fields:
        nested_text = nested_text | _is_nested(F.col(f"_r.{name}"), F.col("_text"), name)
    bad_type = (
        nested_text
        | (amount_text.isNotNull() & F.col("amount").isNull())
        | (time_text.isNotNull() & F.col("event_time").isNull())
        | (features_text.isNotNull() & F.col("_features").isNull())
        | F.coalesce(bad_feature, F.lit(False))
    )
    reason = (
        F.when(F.col("value").isNull(), "null_value")
        .when(~_is_object(F.col("_text")) | F.col("_r").isNull() | F.col("_r._corrupt").isNotNull(), "bad_json")
        .when(_unknown_fields(F.col("_text"), schemas.TRANSACTION_FIELDS), "unknown_field")
        .when(bad_type, "bad_type")
        .when(F.col("id").isNull() | F.col("amount").isNull(), "missing_required")
    )
    return with_once(rec, "reason", reason).drop("_text", "_r", "_features")


def decode_transactions(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid, malformed)``. A valid row without event time takes the record's own timestamp."""
    seen = classify_transactions(raw)
    columns = [
        "id", "user_id", "card_number", "amount", "currency", "merchant_id", "country", "status", "event_time", "features",
    ]
    valid = seen.filter(F.col("reason").isNull()).withColumn("event_time", F.coalesce("event_time", "timestamp"))
    carried = [c for c in raw.columns if c not in ("key", "value", "timestamp")]
    valid = valid.select(*columns, *carried)
    return valid, seen.filter(F.col("reason").isNotNull()).select(*raw.columns, "reason")


def with_event_ms(df: DataFrame) -> DataFrame:
    return df.withColumn("event_ms", F.unix_millis("event_time"))


def observe_quality(classified: DataFrame, name: str = "decode") -> DataFrame:
    """Count valid and malformed rows while they pass, at no extra job; read it from a query listener."""
    return classified.observe(
        name,
        F.count_if(F.col("reason").isNull()).alias("valid"),
        F.count_if(F.col("reason").isNotNull()).alias("malformed"),
    )


def decode_rules(raw: DataFrame) -> DataFrame:
    """Rule records; nulls, broken records and records without ``ruleId`` are dropped without a count.

    Absent flags and numbers take false and 0, except the upper amount, which stays null.
    """
    as_text = ", ".join(f"{name} string" for name in schemas.RULE_FIELDS)
    text = with_once(raw.withColumn("_text", F.col("value").cast("string")), "_r", _parsed(F.col("_text"), as_text))
    field = {name: F.col(f"_r.{name}") for name in schemas.RULE_FIELDS}
    flag = F.lower(F.trim(field["enabled"]))
    wanted = {
        "thresholdAmount": number(_blank_to_null(field["thresholdAmount"]), "double"),
        "thresholdAmountHigh": number(_blank_to_null(field["thresholdAmountHigh"]), "double"),
        "windowSeconds": number(_blank_to_null(field["windowSeconds"]), "double").try_cast("int"),
        "minOccurrences": number(_blank_to_null(field["minOccurrences"]), "double").try_cast("int"),
    }
    broken = field["enabled"].isNotNull() & ~flag.isin("true", "false", "")
    for name, parsed in wanted.items():
        broken = broken | (_blank_to_null(field[name]).isNotNull() & parsed.isNull())
    for name in ("ruleId", "ruleName", "severity"):
        broken = broken | _is_nested(field[name], F.col("_text"), name)
    ok = (
        _is_object(F.col("_text"))
        & F.col("_r._corrupt").isNull()
        & ~_unknown_fields(F.col("_text"), schemas.RULE_FIELDS)
        & ~F.coalesce(broken, F.lit(False))
        & field["ruleId"].isNotNull()
    )
    carried = [c for c in raw.columns if c not in ("key", "value")]
    return with_once(text, "_ok", ok).filter("_ok").select(
        field["ruleId"].alias("rule_id"),
        field["ruleName"].alias("rule_name"),
        F.coalesce(flag == "true", F.lit(False)).alias("enabled"),
        F.coalesce(wanted["thresholdAmount"], F.lit(0.0)).alias("threshold_amount"),
        wanted["thresholdAmountHigh"].alias("threshold_amount_high"),
        F.coalesce(wanted["windowSeconds"], F.lit(0)).alias("window_seconds"),
        F.coalesce(wanted["minOccurrences"], F.lit(0)).alias("min_occurrences"),
        field["severity"].alias("severity"),
        *carried,
    )
