"""Record streams: ``key``, ``value``, ``timestamp``, from Kafka or from files of the same shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from txnguard import schemas
from txnguard.config import Config


def read_records(
    spark: SparkSession, topic_or_path: str, cfg: Config | None = None, starting: str = "latest",
    max_files: int | None = None, max_offsets: int | None = None,
) -> DataFrame:
    """Kafka when ``cfg`` is given, else parquet files. The limits bound how much one micro-batch may hold."""
    if cfg is None:
        reader = spark.readStream.schema(schemas.RAW_RECORD)
        if max_files:
            reader = reader.option("maxFilesPerTrigger", max_files)
        return reader.parquet(topic_or_path)
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", cfg.kafka_bootstrap)
        .option("subscribe", topic_or_path)
        .option("startingOffsets", starting)
    )
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.load().select("key", "value", "timestamp", "offset")


def read_transactions(spark: SparkSession, cfg: Config | None = None, path: str | None = None, **kw) -> DataFrame:
    """New transactions only."""
    return read_records(spark, path or cfg.transactions_topic, None if path else cfg, "latest", **kw)


def read_rule_records(spark: SparkSession, cfg: Config | None = None, path: str | None = None, **kw) -> DataFrame:
    """The whole rule history; no watermark."""
    return read_records(spark, path or cfg.rules_topic, None if path else cfg, "earliest", **kw)
