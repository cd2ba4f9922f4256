"""First-writer-wins merging by primary key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dedupe_first(df: DataFrame, key: str = "id", order: Sequence[str] = ("arrival",)) -> DataFrame:
    """The first row per key. Copies are cut to one per input task before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def absent_from(batch: DataFrame, target: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Rows of ``batch`` whose key is not in ``target`` yet."""
    return batch.join(target.select(*keys), list(keys), "left_anti")


def new_rows(
    batch: DataFrame, target: DataFrame, key: str = "id", order: Sequence[str] = ("arrival",), day: str | None = None
) -> DataFrame:
    """What insert-or-ignore would add.

    With ``day``, a partition column that every copy of a key shares, only target partitions in the batch's span
    are read.
    """
    first = dedupe_first(batch, key, order)
    if day is None:
        return absent_from(first, target, (key,))
    span = batch.agg(F.min(day), F.max(day)).first()
    return absent_from(first, target.filter(F.col(day).between(span[0], span[1])), (key,))
