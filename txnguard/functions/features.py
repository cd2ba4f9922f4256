"""Model features: map, check, ordered vector."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column
from pyspark.sql import functions as F

from txnguard.schemas import FEATURE_NAMES


def feature_map(values: Column, amount: Column, time: Column) -> Column:
    """``values`` is an array of the 28 components in order."""
    names = F.array(*[F.lit(n) for n in FEATURE_NAMES])
    numbers = F.concat(F.slice(values, 1, 28).cast("array<double>"), F.array(amount.cast("double"), time.cast("double")))
    return F.map_from_arrays(names, numbers)


def skip_reason(features: Column) -> Column:
    """Why a row gets no score (null = scored): no features, one missing, or a negative amount or time."""
    names = F.array(*[F.lit(n) for n in FEATURE_NAMES])
    present = F.map_filter(features, lambda n, v: v.isNotNull() & F.array_contains(names, n))
    negative = (F.element_at(features, F.lit("Amount")) < 0) | (F.element_at(features, F.lit("Time")) < 0)
    return (
        F.when(features.isNull() | (F.size(features) == 0), "no_features")
        .when(F.size(present) < len(FEATURE_NAMES), "missing_feature")
        .when(negative, "out_of_range")
    )


def feature_array(features: Column, scale: dict[str, tuple[float, float]] | None = None) -> Column:
    """The 30 numbers in model order; ``scale`` maps a name to (mean, deviation)."""
    out = []
    for name in FEATURE_NAMES:
        value = F.element_at(features, F.lit(name))
        if scale and name in scale:
            mean, deviation = scale[name]
            value = (value - F.lit(mean)) / F.lit(deviation or 1.0)
        out.append(value)
    return F.array(*out)


def feature_vector(features: Column, scale: dict[str, tuple[float, float]] | None = None) -> Column:
    return array_to_vector(feature_array(features, scale))
