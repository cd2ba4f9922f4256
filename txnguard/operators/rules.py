"""Rules that change over time: a changelog of (rule_ts, rule_seq, rule), read as current or as-of state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnguard.functions.alerts import new_country_rule_alerts
from txnguard.operators.patterns import BUILTIN, PatternRule, first_in_country

CHUNK_MS = 3_600_000
#: Transactions of a chunk that one slot is meant to hold.
SLOT_ROWS = 1 << 18


def rule_latest(changelog: DataFrame) -> DataFrame:
    """The newest version of each rule, enabled or not."""
    body = F.struct(*[c for c in changelog.columns if c != "rule_id"])
    newest = changelog.groupBy("rule_id").agg(F.max_by(body, F.struct("rule_ts", "rule_seq")).alias("_r"))
    return newest.select("rule_id", "_r.*")


def rule_current(changelog: DataFrame) -> DataFrame:
    """The rules in force now. Disabled rules go only after the newest version is known."""
    return rule_latest(changelog).filter("enabled")


def busiest_slots(txns: DataFrame, chunk_ms: int, slot_rows: int = SLOT_ROWS) -> int:
    """Slots that spread the chunk with the most transactions."""
    busiest = txns.groupBy(F.floor(F.col("event_ms") / chunk_ms)).count().agg(F.max("count")).first()[0]
    return max(1, -(-(busiest or 0) // slot_rows))


def rule_as_of(txns: DataFrame, changelog: DataFrame, rule_id: str, chunk_ms: int = CHUNK_MS, slots: int | None = None) -> DataFrame:
    """Inner join of each transaction to the version of ``rule_id`` in force at its event time, if that is enabled.

    Versions and transactions are put in one order, and each transaction takes the last version before it. That is done
    per time chunk and slot: a chunk's transactions are spread over ``slots`` (default: as many as the busiest chunk
    needs) and each slot gets the chunk's versions.
    What was in force when a chunk began comes from one row per chunk. One plan for every size of either side.
    """
    slots = slots or busiest_slots(txns, chunk_ms)
    body = F.struct("rule_id", "rule_name", "severity", "threshold_amount", "enabled")
    log = changelog.filter(F.col("rule_id") == rule_id).select(F.unix_millis("rule_ts").alias("_ms"), "rule_seq", body.alias("_v"))
    log = log.groupBy("_ms").agg(F.max_by("_v", "rule_seq").alias("_v")).withColumn("_chunk", F.floor(F.col("_ms") / chunk_ms))
    rows = txns.filter(F.col("event_ms").isNotNull()).select(
        F.struct(*txns.columns).alias("_t"), F.col("event_ms").alias("_ms"), F.floor(F.col("event_ms") / chunk_ms).alias("_chunk"),
        F.pmod(F.xxhash64("event_ms", *[c for c in ("id",) if c in txns.columns]), F.lit(slots)).alias("_slot"),
    )
    copies = log.withColumn("_slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
    every = rows.withColumn("_late", F.lit(1)).unionByName(copies.withColumn("_late", F.lit(0)), allowMissingColumns=True)
    so_far = Window.partitionBy("_chunk", "_slot").orderBy("_ms", "_late")
    known = every.withColumn("_here", F.last("_v", ignorenulls=True).over(so_far)).filter(F.col("_t").isNotNull())
    chunks = rows.select("_chunk").unionByName(log.select("_chunk")).distinct()
    lasts = chunks.join(log.groupBy("_chunk").agg(F.max_by("_v", "_ms").alias("_last")), "_chunk", "left")
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row per chunk, no transactions
    carried = lasts.select("_chunk", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    found = known.join(carried, "_chunk").withColumn("_r", F.coalesce("_here", "_carried")).filter("_r.enabled")
    return found.select("_t.*", "_r.rule_id", "_r.rule_name", "_r.severity", "_r.threshold_amount")


def new_country_dynamic(txns: DataFrame, changelog: DataFrame, order=("arrival",), **kw) -> DataFrame:
    """New-country alerts under the rule version in force at each row; countries are remembered regardless."""
    matches = rule_as_of(first_in_country(txns, order), changelog, "P002", **kw)
    return new_country_rule_alerts(matches.filter(F.col("amount").cast("double") > F.col("threshold_amount")))


def with_version(rule: PatternRule, version: dict) -> PatternRule:
    """``rule`` with what a version of it sets; absent numbers, zero included, and absent texts change nothing."""
    low, high = version.get("threshold_amount"), version.get("threshold_amount_high")
    often = {"window_s": version.get("window_seconds"), "times": version.get("min_occurrences")}
    wanted = {"P001": {"high": low, **often}, "P002": {"low": low}, "P003": often, "P004": {"low": low, "high": high, **often}}[rule.rule_id]
    rule = rule.with_(name=version.get("rule_name") or rule.name, severity=version.get("severity") or rule.severity)
    return rule.with_(**{k: v for k, v in wanted.items() if v is not None and v > 0})


def pattern_rules(changelog: DataFrame, base: dict[str, PatternRule] = BUILTIN) -> dict[str, PatternRule]:
    """The current settings of the known patterns, for the mode in which all patterns follow the rule table.

    Reads at most one row per known pattern. A number that is absent, which decoding turns into 0, and an absent name or
    severity keep the built-in setting. A pattern whose newest version is disabled is left out; one that was
    never published keeps its built-in settings.
    """
    newest = rule_latest(changelog.filter(F.col("rule_id").isin(*base)))
    out = dict(base)
    for row in newest.select(
        "rule_id", "rule_name", "enabled", "threshold_amount", "threshold_amount_high", "window_seconds",
        "min_occurrences", "severity",
    ).collect():
        if not row.enabled:
            out.pop(row.rule_id)
            continue
        out[row.rule_id] = with_version(base[row.rule_id], row.asDict())
    return out
