"""Streaming twins of the batch operators, and the job that runs them together."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence as Seq
from contextlib import contextmanager
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from txnguard.functions import alerts as A
from txnguard.functions.once import with_once
from txnguard.operators import patterns as P
from txnguard.operators.merge import absent_from, dedupe_first
from txnguard.operators.ordered import CHUNK_WINDOWS, spread_chunks
from txnguard.operators.rules import rule_as_of
from txnguard.sources.files import read_or_empty
from txnguard.ship import ship
from txnguard.streaming.processors import (
    MATCH_SCHEMA, SEEN_COLUMNS, SEEN_SCHEMA, FirstSeenProcessor, Sequence, SequenceProcessor, first_per_batch,
)

# Five seconds of disorder; one more millisecond because rows at the watermark itself count as late.
DELAY = "5001 milliseconds"
SLOTS_PER_PARTITION = 8
RULE_TABLE = (
    "rule_id string, rule_name string, enabled boolean, threshold_amount double, threshold_amount_high double, "
    "window_seconds int, min_occurrences int, severity string, rule_ts timestamp, rule_seq long"
)


def stream_session(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A session of the same application with the state store settings; ``partitions`` fixes the number of state
    partitions for the life of a checkpoint (default: the cores of the cluster)."""
    ship(spark)
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", "UTC")
    # Generated methods above this size are not compiled by the JVM; split them instead.
    own.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    own.conf.set("spark.sql.shuffle.partitions", str(partitions or spark.sparkContext.defaultParallelism))
    own.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return own


# --- sequences -----------------------------------------------------------------------------------------------------


def card_stages(rules: dict[str, P.PatternRule]) -> list[tuple[P.PatternRule, list[tuple[Column, int]]]]:
    out = []
    if "P001" in rules:
        out.append((rules["P001"], [(P.is_small(rules["P001"]), rules["P001"].times)]))
    if "P004" in rules:
        out.append((rules["P004"], [(P.is_midrange(rules["P004"]), rules["P004"].times)]))
    return out


def user_stages(rules: dict[str, P.PatternRule]) -> list[tuple[P.PatternRule, list[tuple[Column, int]]]]:
    if "P003" not in rules:
        return []
    rule = rules["P003"]
    return [(rule, [(P.is_failed(), rule.times), (P.is_success(), 1)])]


def slot_of(keys: list[str], spark: SparkSession, slots: int | None) -> Column:
    """Hash slot of a key. The number must stay the same for the life of a checkpoint."""
    n = slots or SLOTS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return F.pmod(F.xxhash64(*keys), F.lit(n))


def sequence_stream(
    txns: DataFrame,
    key: str,
    patterns: Seq[tuple[P.PatternRule, list[tuple[Column, int]]]],
    delay: str = DELAY,
    chunk_ms: int | None = None,
    report_late: bool = False,
    slots: int | None = None,
) -> DataFrame:
    """Matches of several patterns of one key, with one shuffle and one state operator.

    Stage tests become bits before the shuffle and rows that fit nothing are dropped there. State is kept per hash
    slot of the key and time chunk: a busy key is spread over chunks when a backlog is read, and state ends with its
    chunk. ``slots`` (default: eight per state partition) sets how many keys share one state.
    """
    sequences, fits, bit = [], F.lit(0).cast("long"), 0
    for rule, stages in patterns:
        bits = []
        for condition, times in stages:
            fits = fits.bitwiseOR(F.when(condition, F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
            bits.append((bit, times))
            bit += 1
        sequences.append(Sequence(rule.rule_id, tuple(bits), rule.window_s * 1000))
    within = max(s.within_ms for s in sequences)
    # All rows move the watermark, also those dropped next: the filter must not slip below it.
    rows = txns.withWatermark("event_time", delay)
    rows = with_once(rows, "fits", F.when(F.col(key).isNotNull(), fits).otherwise(F.lit(0).cast("long")))
    rows = rows.filter(F.col("fits") > 0).select(
        "event_time", "event_ms", "arrival", "id", "user_id", "card_number", F.col("amount").cast("double").alias("amount"), "fits"
    )
    rows, chunk_ms = spread_chunks(rows, "event_ms", within, chunk_ms or within * CHUNK_WINDOWS)
    rows = rows.withColumn("key", F.col(key)).withColumn("slot", slot_of([key], txns.sparkSession, slots))
    return rows.groupBy("slot", "chunk").transformWithStateInPandas(
        SequenceProcessor(sequences, chunk_ms, report_late), MATCH_SCHEMA, "Append", "EventTime"
    )


def sequence_alerts(matches: DataFrame, rules: dict[str, P.PatternRule]) -> DataFrame:
    """One projection for all patterns: a union would run the state once per pattern."""
    return A.sequence_alerts(matches.filter(F.col("kind") == "match"), rules)


# --- new country ---------------------------------------------------------------------------------------------------


def first_seen_stream(txns: DataFrame, ttl_ms: int | None = None, slots: int | None = None, history: DataFrame | None = None) -> DataFrame:
    """The first row of each user in each country, in arrival order. No watermark: late rows count too.

    Each input task passes on one row per pair and Arrow batch, so a busy user does not flood one task. ``history``
    (user_id, country, event_ms, one row per pair) fills the state of a new checkpoint; a checkpoint that exists keeps its own.
    """
    rows = txns.filter(F.col("user_id").isNotNull() & F.col("country").isNotNull())
    rows = rows.select(*[F.col(c).cast("double").alias(c) if c == "amount" else F.col(c) for c in SEEN_COLUMNS])
    reduced = rows.mapInPandas(first_per_batch, SEEN_SCHEMA)
    reduced = reduced.withColumn("slot", slot_of(["user_id", "country"], txns.sparkSession, slots))
    mode = "ProcessingTime" if ttl_ms else "None"
    known = None
    if history is not None:
        pairs = history.filter(F.col("user_id").isNotNull() & F.col("country").isNotNull()).select("user_id", "country", "event_ms")
        known = pairs.withColumn("slot", slot_of(["user_id", "country"], txns.sparkSession, slots)).groupBy("slot")
    return reduced.groupBy("slot").transformWithStateInPandas(
        FirstSeenProcessor(ttl_ms), SEEN_SCHEMA, "Append", mode, initialState=known
    )


def seen_pairs(spark: SparkSession, checkpoint: str, batch_id: int | None = None) -> DataFrame:
    """What a stopped new-country stream remembers: (user_id, country, since), from its state files, as of its last batch or
    of ``batch_id``."""
    reader = spark.read.format("statestore").option("stateVarName", "seen")
    state = (reader if batch_id is None else reader.option("batchId", batch_id)).load(checkpoint)
    return state.select("user_map_key.user_id", "user_map_key.country", F.col("user_map_value.since").alias("since"))


def rule_log(spark: SparkSession, rule_table: str) -> DataFrame:
    """All rule versions that have arrived, read anew at every call."""
    return read_or_empty(spark, rule_table, RULE_TABLE)


def new_country_alerts(first_seen: DataFrame, changelog: DataFrame) -> DataFrame:
    """Each row under the version in force at its own time, so that a repeated batch gives the same alerts."""
    joined = rule_as_of(first_seen, changelog, "P002")
    return A.new_country_rule_alerts(joined.filter(F.col("amount") > F.col("threshold_amount")))


# --- sinks ---------------------------------------------------------------------------------------------------------


def to_files(df: DataFrame, path: str, checkpoint: str, available_now: bool = True, interval_ms: int = 30_000, fmt: str = "parquet") -> StreamingQuery:
    """Exactly-once file sink; a bounded run, or one micro-batch per interval."""
    writer = df.writeStream.format(fmt).outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return _trigger(writer, available_now, interval_ms).start()


def each_batch(
    df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True, interval_ms: int = 30_000
) -> StreamingQuery:
    writer = df.writeStream.foreachBatch(handle).outputMode("append").option("checkpointLocation", checkpoint)
    return _trigger(writer, available_now, interval_ms).start()


def _trigger(writer, available_now: bool, interval_ms: int):
    return writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{interval_ms} milliseconds")


@contextmanager
def computed_once(batch: DataFrame) -> Iterator[DataFrame]:
    """A micro-batch that several steps use: it is kept meanwhile, so that its state is not gone through for each of them."""
    batch.persist()
    try:
        yield batch
    finally:
        batch.unpersist()


def write_batch(df: DataFrame, path: str, batch_id: int, partitions: Seq[str] = ()) -> None:
    """One folder per micro-batch, replaced when the batch is run again: no repeated rows after a restart."""
    df.write.mode("overwrite").partitionBy(*partitions).parquet(f"{path}/batch_id={batch_id}")


def stored_ids(spark: SparkSession, path: str, batch_id: int, day: str, days: Seq) -> DataFrame:
    """Ids that other batches have stored in some days' partitions; no other files and no other column are read. A batch that
    is run again does not meet its own."""
    known = read_or_empty(spark, path, f"id string, batch_id long, {day} date")
    return known.filter(F.col(day).isin(list(days)) & (F.col("batch_id") != batch_id)).select("id")


def first_stored(batch: DataFrame, path: str, batch_id: int, day: str, order: Seq[str] = ("arrival",), near: int = 0) -> DataFrame:
    """What insert-or-ignore adds to the batches under ``path``: the first row per id that no other batch has stored.

    A record that is sent again has the same day, so only the days of the batch are looked up, and ``near`` days before
    each. What is read follows the batch, not the table.
    """
    rows = dedupe_first(batch, "id", order)
    found = [r[0] for r in batch.select(day).distinct().collect() if r[0] is not None]  # the batch's days
    days = sorted({d - timedelta(days=k) for d in found for k in range(near + 1)})
    return absent_from(rows, stored_ids(batch.sparkSession, path, batch_id, day, days))
