"""Views over the given tables in the shapes the operators take, in Spark and as SQL for the check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnguard.operators.patterns import BUILTIN
from txnguard.operators.replay import COUNTRIES, padded

# The built-in one-minute windows are empty on these tables, so the queries pass wider ones.
WIDE = {
    "P001": BUILTIN["P001"].with_(window_s=86_400),
    "P002": BUILTIN["P002"].with_(low=50.0),
    "P003": BUILTIN["P003"].with_(window_s=86_400),
    "P004": BUILTIN["P004"].with_(window_s=21_600),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utc(ts: Column) -> Column:
    """The stored zoneless times are UTC; independent of the session's time zone."""
    return F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone())


def as_transactions(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("event_id").cast("string").alias("id"),
        F.col("event_id").alias("arrival"),
        F.col("user_id").cast("string").alias("user_id"),
        F.col("user_id").cast("string").alias("card_number"),
        F.col("value").cast("decimal(12,2)").alias("amount"),
        F.lit("EUR").alias("currency"),
        F.concat(F.lit("MER-"), padded(F.col("event_id") % 1000, 4)).alias("merchant_id"),
        F.element_at(F.array(*[F.lit(c) for c in COUNTRIES]), k % 10 + 1).alias("country"),
        F.when(F.col("event_type") == "error", "FRAUD").otherwise("SUCCESS").alias("status"),
        utc(F.col("ts")).alias("event_time"),
        F.unix_millis(utc(F.col("ts"))).alias("event_ms"),
        (F.col("value") / 500).alias("score"),
    )


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_transactions(table(spark, sf_dir, "events"))


TX_SQL = f"""tx AS (
  SELECT CAST(event_id AS VARCHAR) AS id, event_id AS arrival, CAST(user_id AS VARCHAR) AS user_id,
         CAST(user_id AS VARCHAR) AS card_number, CAST(value AS DECIMAL(12,2)) AS amount, 'EUR' AS currency,
         printf('MER-%04d', event_id % 1000) AS merchant_id,
         {COUNTRIES}[
           CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) % 10 + 1] AS country,
         CASE WHEN event_type = 'error' THEN 'FRAUD' ELSE 'SUCCESS' END AS status,
         ts AS event_time, epoch_us(ts) // 1000 AS event_ms, value / 500 AS score
  FROM events)"""
