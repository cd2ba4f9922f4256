"""Standard scaling with the population deviation (a zero deviation divides by one)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_frame(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: ``name``, ``mean``, ``deviation``; one pass over the data."""
    stats = df.agg(*[F.struct(F.lit(c).alias("name"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("deviation")).alias(c) for c in columns])
    return stats.select(F.inline(F.array(*columns)))


def fit(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    return {r["name"]: (r["mean"], r["deviation"]) for r in fit_frame(df, columns).collect()}


def transform(df: DataFrame, params: dict[str, tuple[float, float]], suffix: str = "_sc") -> DataFrame:
    scaled = {
        f"{c}{suffix}": (F.col(c) - F.lit(mean)) / F.lit(deviation or 1.0) for c, (mean, deviation) in params.items()
    }
    return df.withColumns(scaled)
