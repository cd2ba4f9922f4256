"""Where alerts and transactions go: record topics, database tables, file tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnguard.config import Config
from txnguard.functions.alerts import to_records
from txnguard.operators.merge import dedupe_first

# Rows per database round trip.
ALERT_BATCH, TRANSACTION_BATCH = 200, 500


def send_alert_records(alerts: DataFrame, cfg: Config | None = None, path: str | None = None) -> None:
    """JSON records keyed by user: to the alert topic, or to files of the same shape. At least once."""
    records = to_records(alerts)
    if path is not None:
        records.select(F.col("key").cast("string").alias("key"), "value").write.mode("overwrite").json(path)
        return
    writer = records.write.format("kafka").option("kafka.bootstrap.servers", cfg.kafka_bootstrap)
    writer.option("topic", cfg.alerts_topic).save()


def jdbc_options(cfg: Config, driver: str = "org.postgresql.Driver") -> dict[str, str]:
    return {"url": cfg.jdbc_url, "user": cfg.jdbc_user, "password": cfg.jdbc_password, "driver": driver}


def insert_or_ignore_sql(table: str, staging: str, columns: Sequence[str], key: str = "id") -> list[str]:
    """The statements that take a staged batch into its table and clear the stage. The database itself decides what is
    there already, so neither a repeated batch nor another writer can fail or double it."""
    listed = ", ".join(columns)
    return [
        f"INSERT INTO {table} ({listed}) SELECT {listed} FROM {staging} ON CONFLICT ({key}) DO NOTHING",
        f"DROP TABLE {staging}",
    ]


def jdbc_execute(spark: SparkSession, options: dict[str, str], statements: Sequence[str]) -> None:
    """Runs statements in one database transaction."""
    jvm = spark.sparkContext._jvm
    jvm.java.lang.Class.forName(options["driver"])
    connection = jvm.java.sql.DriverManager.getConnection(options["url"], options["user"], options["password"])
    try:
        connection.setAutoCommit(False)
        for statement in statements:
            connection.createStatement().execute(statement)
        connection.commit()
    finally:
        connection.close()


def insert_or_ignore(
    batch: DataFrame,
    table: str,
    name: str,
    batch_id: int,
    stage: Callable[[DataFrame, str], None],
    execute: Callable[[Sequence[str]], None],
    order: Sequence[str] = ("arrival",),
) -> None:
    """Insert-or-ignore of one micro-batch: the first row of each id, by ``order``, goes to a staging table of this query
    and batch, which a repeated batch replaces; one statement in the database then adds what is new."""
    staging = f"{table}_stage_{name}_{batch_id}"
    known = [c for c in order if c in batch.columns]
    first = dedupe_first(batch, "id", known or ("id",)).drop(*known)
    stage(first, staging)
    execute(insert_or_ignore_sql(table, staging, first.columns))


def jdbc_insert_or_ignore(
    batch: DataFrame, table: str, name: str, batch_id: int, options: dict[str, str], batch_rows: int, order: Sequence[str] = ("arrival",)
) -> None:
    """``insert_or_ignore`` over a database connection."""
    insert_or_ignore(
        batch, table, name, batch_id,
        lambda rows, staging: rows.write.format("jdbc").options(**options).option("dbtable", staging)
        .option("batchsize", batch_rows).mode("overwrite").save(),
        lambda statements: jdbc_execute(batch.sparkSession, options, statements),
        order,
    )


def read_table(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).parquet(path)
