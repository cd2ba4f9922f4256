"""The stored alert and transaction tables: layout for lookups, and the lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnguard import schemas

PARTITIONS = ["detected_date", "source"]


#: Rows of a file at most.
ROWS_PER_FILE = 5_000_000


def utc_date(ts: Column) -> Column:
    return F.to_date(F.to_utc_timestamp(ts, F.current_timezone()))


def with_date(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("detected_date", utc_date(F.col("detected_at")))


def write_ranges(rows: DataFrame, days: list[str], path: str, mode: str) -> None:
    """Files by ranges of day, user and id: as many as the rows fill, a busy user's rows split over several, and a user's rows
    of a day next to each other, so that a lookup skips files and row groups."""
    order = [*days, "user_id", "id"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.write.mode(mode).option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy(*days).parquet(path)


def write_alerts(alerts: DataFrame, path: str, mode: str = "append") -> None:
    """Partitioned by day and source, each in ranges of users."""
    typed = [F.col(name).cast(kind) for name, (kind, *_) in schemas.ALERTS_TABLE.items()]
    write_ranges(with_date(alerts.select(*typed)), PARTITIONS, path, mode)


def write_transactions(txns: DataFrame, path: str, mode: str = "append") -> None:
    """Partitioned by day, each in ranges of users."""
    rows = txns.select(*schemas.TRANSACTIONS_TABLE).withColumn("event_date", utc_date(F.col("event_time")))
    write_ranges(rows, ["event_date"], path, mode)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """The alert table as ``write_alerts`` or the service lays it out; partition columns come from the folders."""
    stored = ", ".join(f"{name} {kind}" for name, (kind, *_) in schemas.ALERTS_TABLE.items())
    return spark.read.schema(f"{stored}, detected_date date").parquet(path)


def alerts_recent(alerts: DataFrame, n: int = 5) -> DataFrame:
    newest = alerts.orderBy(F.col("detected_at").desc(), "id").limit(n)
    return newest.select("pattern_name", "severity", "amount", "source")


def alerts_by_user(alerts: DataFrame, user_id: str) -> DataFrame:
    return alerts.filter(F.col("user_id") == user_id)


def alerts_by_time(alerts: DataFrame, start: str, end: str) -> DataFrame:
    """From ``start`` up to but not including ``end``; the day test prunes partitions."""
    lo, hi = F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end))
    days = F.col("detected_date").between(utc_date(lo), utc_date(hi))
    return alerts.filter(days & (F.col("detected_at") >= lo) & (F.col("detected_at") < hi))


def alerts_by_source(alerts: DataFrame, source: str) -> DataFrame:
    return alerts.filter(F.col("source") == source)


def transactions_by_user_time(txns: DataFrame, user_id: str, start: str, end: str) -> DataFrame:
    """From ``start`` up to but not including ``end``; the day test prunes partitions, the others reach the scan."""
    lo, hi = F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end))
    days = F.col("event_date").between(utc_date(lo), utc_date(hi))
    return txns.filter(days & (F.col("user_id") == user_id) & (F.col("event_time") >= lo) & (F.col("event_time") < hi))


# --- one copy for lookups by id, by user and by time --------------------------------------------------------------------

#: Bits of a user's slot and of the time that are interleaved.
BITS = 12
ROWS_PER_LOOKUP_FILE = 1_000_000


def user_slot(user: Column) -> Column:
    return F.pmod(F.xxhash64(user), F.lit(1 << BITS)).cast("int")


def interleaved(*numbers: Column, bits: int = BITS) -> Column:
    """One number with the bits of several in turn, the highest first: rows near in it are near in each of them."""
    out = F.lit(0).cast("long")
    for bit in range(bits):
        for k, number in enumerate(numbers):
            one = F.shiftright(number.cast("long"), bit).bitwiseAND(F.lit(1).cast("long"))
            out = out.bitwiseOR(F.shiftleft(one, bit * len(numbers) + len(numbers) - 1 - k))
    return out


def write_for_lookups(rows: DataFrame, path: str, at: str = "detected_at", rows_per_file: int = ROWS_PER_LOOKUP_FILE) -> None:
    """Files that lookups skip: clustered by user slot and time at once, so that both have narrow ranges in each file, and
    with a Bloom filter of the ids. As many files as the rows fill; a busy user's rows split by time."""
    ends = rows.agg(F.min(F.unix_millis(at)).alias("first"), F.max(F.unix_millis(at)).alias("last"), F.count("*").alias("n")).first()
    first, span = ends["first"] or 0, max(1, (ends["last"] or 0) - (ends["first"] or 0))
    place = F.floor((F.unix_millis(at) - F.lit(first)) * F.lit((1 << BITS) - 1) / F.lit(span)).cast("int")
    files = max(1, -(-ends["n"] // rows_per_file))
    made = rows.withColumn("user_slot", user_slot(F.col("user_id"))).withColumn("_near", F.coalesce(interleaved(F.col("user_slot"), place), F.lit(0)))
    dealt = made.repartitionByRange(files, "_near", "id").sortWithinPartitions("_near", "id").drop("_near")
    writer = dealt.write.mode("overwrite").option("parquet.bloom.filter.enabled#id", "true")
    writer.option("parquet.bloom.filter.expected.ndv#id", min(rows_per_file, max(1, ends["n"]))).parquet(path)


def lookup_id(stored: DataFrame, key: str) -> DataFrame:
    return stored.filter(F.col("id") == key)


def lookup_user(stored: DataFrame, user: str, start: str, end: str, at: str = "detected_at") -> DataFrame:
    """A user's rows from ``start`` up to but not including ``end``; files whose slots or times do not meet them are skipped."""
    slot = stored.sparkSession.range(1).select(user_slot(F.lit(user))).first()[0]
    lo, hi = F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end))
    return stored.filter((F.col("user_slot") == slot) & (F.col("user_id") == user) & (F.col(at) >= lo) & (F.col(at) < hi))


def rows_scanned(found: DataFrame) -> int:
    """Rows that the file scan of a plain lookup gave on, after it has run: what files and row groups could not rule out."""
    found.collect()
    leaves = found._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))
