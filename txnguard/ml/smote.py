"""Synthetic minority rows on the line between a row and one of its nearest minority neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnguard.ml.neighbours import nearest
from txnguard.ml.split import hash_bucket, hash_order
from txnguard.operators.ordered import running_totals
from txnguard.workdir import materialize


def planned_rows(majority: int, minority: int, ratio: float) -> int:
    """How many rows bring the minority up to ``ratio`` of the majority; an error when it is above already."""
    wanted = int(ratio * majority - minority)
    if wanted < 0:
        raise ValueError("the minority share is already above the wanted ratio")
    return wanted


def class_counts(df: DataFrame, label: str) -> tuple[int, int]:
    row = df.agg(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).first()
    return row[0], row[1]


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) from a hash, the same on every run."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12), 16, 10).cast("double") / float(16**12)


def dense_index(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    """``index`` 0..n-1 in hash order, counted per hash bucket and carried over."""
    rows = df.withColumn("_h", hash_order(id_col, seed))
    rows = running_totals(rows, hash_bucket(F.col("_h"), 3), ["_h", id_col], {"index": F.lit(1)})
    return rows.withColumn("index", F.col("index") - 1).drop("_h")


def oversample(
    df: DataFrame, label: str, id_col: str, vector: str, ratio: float = 0.1, k: int = 5, seed: int = 42
) -> DataFrame:
    """The new rows only: ``id``, ``base``, ``neighbour``, ``vector``. Base, neighbour and place on the line come
    from a seeded hash of the row's number."""
    majority, minority = class_counts(df, label)
    wanted = planned_rows(majority, minority, ratio)
    rare = df.filter(F.col(label) == 1).select(F.col(id_col).cast("string").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    spark = df.sparkSession
    near = nearest(rare, "id", "x", k)
    if wanted:
        near = materialize(near, "neighbours")
    reach = min(k, max(minority - 1, 1))
    number = F.col("number")
    picks = spark.range(wanted).withColumnRenamed("id", "number").select(
        "number",
        F.floor(_unit(F.lit(f"base{seed}"), number) * minority).alias("index"),
        (F.floor(_unit(F.lit(f"near{seed}"), number) * reach) + 1).alias("rank"),
        _unit(F.lit(f"gap{seed}"), number).alias("u"),
    )
    base = picks.join(dense_index(rare, "id", seed), "index").withColumnsRenamed({"id": "base", "x": "base_x"})
    paired = base.join(near.select(F.col("id").alias("base"), "rank", "neighbour"), ["base", "rank"])
    ends = paired.join(rare.withColumnsRenamed({"id": "neighbour", "x": "near_x"}), "neighbour")
    mixed = F.zip_with("base_x", "near_x", lambda a, b: a + F.col("u") * (b - a))
    return ends.select(F.concat(F.lit("new-"), "number").alias("id"), "base", "neighbour", mixed.alias("vector"))


def resample(df: DataFrame, label: str, id_col: str, vector: str, **kw) -> DataFrame:
    """The given rows and the new minority rows: ``id``, ``vector``, label."""
    given = df.select(F.col(id_col).cast("string").alias("id"), F.col(vector).cast("array<double>").alias("vector"), label)
    added = oversample(df, label, id_col, vector, **kw).select("id", "vector", F.lit(1).cast(df.schema[label].dataType).alias(label))
    return given.unionByName(added)
