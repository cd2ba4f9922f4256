"""Keeping an expensive column from being computed again for every filter that mentions it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` as column ``name``, computed once per row.

    A filter on a computed column is pushed below the projection with the whole expression copied into it, once per
    mention. It is not pushed below the one-row generator put on top here. For parsed or validated columns only:
    filters on plain columns should be pushed down.
    """
    held, taken = "_once", {c.lower() for c in df.columns}
    while held in taken:
        held += "_"
    computed = df.withColumn(held, value)
    return computed.withColumn(name, F.explode_outer(F.array(held))).drop(held)
