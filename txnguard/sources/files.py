"""File sources, always with the declared schema."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnguard import schemas


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules as JSON lines; absent flags and numbers take false and 0."""
    rules = spark.read.schema(schemas.RULE).json(path)
    return rules.withColumns(
        {
            "enabled": F.coalesce("enabled", F.lit(False)),
            "thresholdAmount": F.coalesce("thresholdAmount", F.lit(0.0)),
            "windowSeconds": F.coalesce("windowSeconds", F.lit(0)),
            "minOccurrences": F.coalesce("minOccurrences", F.lit(0)),
        }
    )


def rules_as_records(spark: SparkSession, path: str) -> DataFrame:
    """The same file as raw records, for publishing to the rule stream."""
    return spark.read.text(path).select(
        F.lit(None).cast("binary").alias("key"), F.col("value").cast("binary").alias("value")
    )


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CARD_CSV).option("header", True).csv(path)


def read_or_empty(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A parquet table, or an empty one of the same type when nothing has been written yet."""
    try:
        return spark.read.schema(ddl).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ddl)
