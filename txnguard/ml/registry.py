"""Model registry: two append-only tables, ``registry`` and ``activation``. The newest activation row counts."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from txnguard import schemas
from txnguard.sources.files import read_or_empty


class UnknownVersion(LookupError):
    pass


def new_version(now: datetime | None = None) -> str:
    return (now or datetime.now(timezone.utc)).strftime("%Y%m%d_%H%M%S")


def entries(spark: SparkSession, root: str) -> DataFrame:
    return read_or_empty(spark, f"{root}/registry", schemas.REGISTRY)


def activations(spark: SparkSession, root: str) -> DataFrame:
    return read_or_empty(spark, f"{root}/activation", schemas.ACTIVATION)


def append_entries(rows: DataFrame, root: str) -> None:
    rows.select("version", "auroc", "auprc", "trained_at", "model_file", "status").write.mode("append").parquet(f"{root}/registry")


def append_activations(rows: DataFrame, root: str) -> None:
    rows.select("version", "activated_at").write.mode("append").parquet(f"{root}/activation")


def latest(registry: DataFrame) -> DataFrame:
    """The last entry as one row; partial maxima meet, nothing is sorted."""
    body = F.struct(*registry.columns)
    return registry.agg(F.max_by(body, F.struct("trained_at", "version")).alias("r")).filter("r is not null").select("r.*")


def current(activation: DataFrame) -> DataFrame:
    body = F.struct(*activation.columns)
    return activation.agg(F.max_by(body, F.struct("activated_at", "version")).alias("r")).filter("r is not null").select("r.*")


def listing(registry: DataFrame, activation: DataFrame) -> DataFrame:
    """Every entry with ``is_active``."""
    active = F.broadcast(current(activation).select("version", F.lit(True).alias("is_active")))  # one row
    return registry.join(active, "version", "left").withColumn("is_active", F.coalesce("is_active", F.lit(False)))


def record(spark: SparkSession, root: str, version: str, auroc: float, auprc: float, model_file: str) -> None:
    row = Row(version, round(auroc, 4), round(auprc, 4), datetime.now(timezone.utc), model_file, "active")
    append_entries(spark.createDataFrame([row], schemas.REGISTRY), root)


def activate(spark: SparkSession, root: str, version: str) -> str:
    """Make ``version`` (or ``latest``) the active one. An unknown version raises and changes nothing."""
    known = entries(spark, root)
    if version == "latest":
        row = latest(known).first()
    else:
        row = known.filter(F.col("version") == version).first()
    if row is None:
        raise UnknownVersion(version)
    append_activations(spark.createDataFrame([(row.version, datetime.now(timezone.utc))], schemas.ACTIVATION), root)
    return row.version


def active_version(spark: SparkSession, root: str) -> Row | None:
    return current(activations(spark, root)).first()


def active_info(spark: SparkSession, root: str) -> DataFrame:
    """One row: the active version and its AUROC, ``unknown`` when the registry has no entry for it."""
    now = current(activations(spark, root)).select("version")
    known = entries(spark, root).groupBy("version").agg(F.max_by("auroc", "trained_at").alias("auroc"))
    return now.join(known, "version", "left").select("version", F.coalesce(F.col("auroc").cast("string"), F.lit("unknown")).alias("auroc"))
