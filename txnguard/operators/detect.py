"""All patterns over one transaction table, merged into one alert table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnguard.functions import alerts as A
from txnguard.operators import patterns as P
from txnguard.operators.rules import new_country_dynamic, pattern_rules


def union_alerts(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def detect_all(
    txns: DataFrame,
    rules: dict[str, P.PatternRule] = P.BUILTIN,
    changelog: DataFrame | None = None,
    scored: DataFrame | None = None,
    mode: str = "static",
    threshold: float = 0.5,
) -> DataFrame:
    """Alerts of every pattern in ``rules`` plus model alerts from ``scored``.

    ``mode="static"``: only the new-country rule follows ``changelog``. ``mode="dynamic"``: the other three take
    their newest settings from it too, and a disabled one gives no alerts.
    """
    if mode == "dynamic" and changelog is not None:
        # The new-country rule stays in: a version now disabled may have been in force at earlier rows.
        rules = {**pattern_rules(changelog, rules), "P002": rules["P002"]}
    slim = txns.select("id", "user_id", "card_number", "amount", "country", "status", "event_ms", "arrival")
    parts = []
    by_card = [(rules[i], fits(rules[i])) for i, fits in (("P001", P.is_small), ("P004", P.is_midrange)) if i in rules]
    if by_card:
        parts.append(A.sequence_alerts(P.repeated_patterns(slim, "card_number", by_card), rules))
    if "P003" in rules:
        found = P.fail_then_success(slim, rules["P003"]).withColumn("pattern_id", F.lit("P003"))
        parts.append(A.sequence_alerts(found, rules))
    if changelog is not None:
        parts.append(new_country_dynamic(slim, changelog))
    elif "P002" in rules:
        parts.append(A.new_country_alerts(P.new_country(slim, rules["P002"]), rules["P002"]))
    if scored is not None:
        parts.append(A.model_alerts(scored, threshold))
    return union_alerts(parts)


def null_key_rows(txns: DataFrame) -> DataFrame:
    """Rows that a keyed pattern cannot use, by the key that is missing."""
    return txns.agg(
        F.count_if(F.col("user_id").isNull()).alias("null_user"),
        F.count_if(F.col("card_number").isNull()).alias("null_card"),
    )
