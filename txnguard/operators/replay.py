"""Turning card rows into transactions, and the timing of a replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnguard.functions.features import feature_map
from txnguard.operators.ordered import CHUNK_ROWS, previous_value, running_totals

# Fixed value: the country list, by row index.
COUNTRIES = ["VN", "US", "SG", "JP", "GB", "DE", "FR", "AU", "TH", "MY"]


def status_of(cls: Column) -> Column:
    return F.when(cls == 1, "FRAUD").otherwise("SUCCESS")


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text in UTC with microseconds, whatever the session's time zone."""
    wall = F.to_utc_timestamp(ts, F.current_timezone())
    return F.concat(F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def padded(number: Column, width: int) -> Column:
    """Leading zeros; the numbers used here never exceed the width."""
    return F.lpad(number.cast("string"), width, "0")


def card_rows_to_transactions(df: DataFrame, base: Column, components: str = "components") -> DataFrame:
    """Transactions from rows (idx, Time, 28 components, Amount, Class); ``idx`` is the original row number."""
    idx, amount = F.col("idx"), F.col("Amount")
    time = F.timestamp_micros(F.unix_micros(base) + F.round(F.col("Time") * 1000000).cast("long"))
    return df.select(
        F.md5(F.concat_ws("|", F.lit("card"), idx)).alias("id"),
        idx.alias("arrival"),
        F.concat(F.lit("user_"), padded(idx % 500, 4)).alias("user_id"),
        F.concat(
            F.lit("4"), padded(idx % 500, 3), F.lit("-xxxx-xxxx-"), padded(amount.cast("long") % 9999, 4)
        ).alias("card_number"),
        F.round(amount, 2).cast("decimal(12,2)").alias("amount"),
        F.lit("EUR").alias("currency"),
        F.concat(F.lit("MER-"), padded(idx % 1000, 4)).alias("merchant_id"),
        F.element_at(F.array(*[F.lit(c) for c in COUNTRIES]), (idx % len(COUNTRIES) + 1).cast("int")).alias("country"),
        status_of(F.col("Class")).alias("status"),
        time.alias("event_time"),
        iso_utc(time).alias("event_time_text"),
        feature_map(F.col(components), amount, F.col("Time")).alias("features"),
    )


def components_of(card: DataFrame) -> DataFrame:
    """V1..V28 columns folded into one array column."""
    return card.withColumn("components", F.array(*[F.col(f"V{i}") for i in range(1, 29)]))


def head(df: DataFrame, n: int, fraud_only: bool = False) -> DataFrame:
    """The first ``n`` rows by index, after the optional filter."""
    rows = df.filter(F.col("Class") == 1) if fraud_only else df
    return rows.orderBy("idx").limit(n)


def span(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.max("Time").alias("max_time_s"))


def _chunk() -> Column:
    return F.floor(F.col("idx") / CHUNK_ROWS)


def schedule(df: DataFrame, speed: float = 1.0, longest_s: float = 5.0) -> DataFrame:
    """``replay_delay_s`` before each row and ``send_at_s`` since the start. Gaps of 5 s or more are skipped."""
    gap = (F.col("Time") - F.col("_before")) / F.lit(speed)
    rows = previous_value(df, [], _chunk(), ["idx"], "Time", "_before")
    rows = rows.withColumn("replay_delay_s", F.when((gap > 0) & (gap < longest_s), gap).otherwise(F.lit(0.0)))
    return running_totals(rows.drop("_before"), _chunk(), ["idx"], {"send_at_s": F.col("replay_delay_s")})


def progress(df: DataFrame) -> DataFrame:
    """Rows sent and failed rows sent so far."""
    return running_totals(df, _chunk(), ["idx"], {"sent": F.lit(1), "fraud_total": F.col("Class")})
