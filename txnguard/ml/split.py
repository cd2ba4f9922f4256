"""Exact stratified split by hash order, without sorting a class in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEX_DIGITS = 4
SLOTS = 64


def hash_order(id_col: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.col(id_col), F.lit(seed)))


def hash_bucket(hashed: Column, digits: int = HEX_DIGITS) -> Column:
    """The leading hex digits as a number: buckets in the order of the full hash."""
    return F.conv(F.substring(hashed, 1, digits), 16, 10).cast("int")


def stratified_split(df: DataFrame, label: str, id_col: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``is_test``: per class, the ``round(test_share * n)`` rows lowest in hash order.

    Rows are counted per hash bucket, the bucket in which the limit falls is found from the counts, and only the
    rows of that one bucket are ranked.
    """
    rows = df.withColumn("_h", hash_order(id_col, seed)).withColumn("_b", hash_bucket(F.col("_h")))
    counts = rows.groupBy(label, "_b").agg(F.count("*").alias("n"))
    per_class = Window.partitionBy(label)
    upto = per_class.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumns(
        {"_cum": F.sum("n").over(upto), "_want": F.round(F.sum("n").over(per_class) * F.lit(test_share))}
    )
    at_cut = (F.col("_cum") >= F.col("_want")) & (F.col("_cum") - F.col("n") < F.col("_want"))
    cuts = counts.filter(at_cut).select(
        label, F.col("_b").alias("_cut"), (F.col("_want") - F.col("_cum") + F.col("n")).alias("_left")
    )
    # A class is spread over slots, and its one cut is copied to each, so that no class meets in one task.
    cuts = cuts.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
    marked = rows.withColumn("_slot", F.pmod("_b", F.lit(SLOTS))).join(cuts, [label, "_slot"], "left").drop("_slot")
    sure = marked.filter(F.col("_cut").isNull() | (F.col("_b") != F.col("_cut")))
    sure = sure.withColumn("is_test", F.coalesce(F.col("_b") < F.col("_cut"), F.lit(False)))
    edge = marked.filter(F.col("_b") == F.col("_cut"))
    rank = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", id_col))
    edge = edge.withColumn("is_test", rank <= F.col("_left"))
    return sure.unionByName(edge).drop("_h", "_b", "_cut", "_left")
