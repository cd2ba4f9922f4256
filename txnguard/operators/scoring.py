"""Scoring whole tables or streams. A row that cannot be scored keeps its reason and yields no alert."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnguard.functions.features import feature_array, feature_vector, skip_reason
from txnguard.functions.once import with_once
from txnguard.ml.train import positive_probability


def label_scores(scored: DataFrame, threshold: float = 0.5, version: str = "unknown") -> DataFrame:
    """``is_fraud``, ``model_version`` and ``outcome`` from ``fraud_probability``."""
    p = F.col("fraud_probability")
    return scored.withColumns(
        {
            "is_fraud": p >= threshold,
            "model_version": F.lit(version),
            "outcome": F.when(F.col("skip_reason").isNotNull(), F.col("skip_reason")).when(p.isNull(), "error").otherwise("scored"),
        }
    )


def linear_probability(features: Column, weights: Sequence[float], bias: float, scale: dict | None = None) -> Column:
    """Logistic score with fixed weights, as plain columns."""
    values = feature_array(features, scale)
    pairs = F.zip_with(values, F.array(*[F.lit(float(w)) for w in weights]), lambda x, w: x * w)
    total = F.aggregate(pairs, F.lit(float(bias)), lambda acc, v: acc + v)
    return 1.0 / (1.0 + F.exp(-total))


def score_linear(
    df: DataFrame, weights: Sequence[float], bias: float, scale: dict | None = None, threshold: float = 0.5,
    version: str = "linear", features: str = "features",
) -> DataFrame:
    rows = df.withColumn("skip_reason", skip_reason(F.col(features)))
    p = F.when(F.col("skip_reason").isNull(), linear_probability(F.col(features), weights, bias, scale))
    return label_scores(rows.withColumn("fraud_probability", p), threshold, version)


def score(
    df: DataFrame, model, scale: dict, threshold: float = 0.5, version: str = "unknown", features: str = "features"
) -> DataFrame:
    """Score with a Spark model inside the JVM; rows with a skip reason are not given to the model.

    Returns only scored rows, like an inner join with the scorer; ``skipped`` gives the others.
    """
    rows = df.withColumn("skip_reason", skip_reason(F.col(features))).filter(F.col("skip_reason").isNull())
    rows = rows.withColumn("features_vec", feature_vector(F.col(features), scale))
    return label_scores(positive_probability(model, rows), threshold, version).drop("features_vec")


def skipped(df: DataFrame, features: str = "features") -> DataFrame:
    rows = df.withColumn("skip_reason", skip_reason(F.col(features)))
    return rows.filter(F.col("skip_reason").isNotNull()).groupBy("skip_reason").agg(F.count("*").alias("n"))


def score_python(
    df: DataFrame,
    load: Callable[[], Callable[[np.ndarray], np.ndarray]],
    scale: dict | None = None,
    threshold: float = 0.5,
    version: str = "unknown",
    features: str = "features",
) -> DataFrame:
    """Score with any Python model in Arrow batches. ``load`` runs once per task; a failing batch becomes ``error`` rows with
    the failure in ``score_error``, and the job goes on."""

    @F.pandas_udf("p double, error string")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = None
        for batch in batches:
            out, error = np.full(len(batch), np.nan), np.full(len(batch), None, object)
            ready = batch.notna().to_numpy()
            if ready.any():
                try:
                    model = model or load()
                    out[ready] = model(np.array(batch[ready].tolist(), dtype=float))
                except Exception as e:  # an unavailable scorer must not stop the stream
                    error[ready] = f"{type(e).__name__}: {e}"
            yield pd.DataFrame({"p": pd.Series(out).where(~np.isnan(out), None).astype("Float64"), "error": error})

    rows = df.withColumn("skip_reason", skip_reason(F.col(features)))
    vector = F.when(F.col("skip_reason").isNull(), feature_array(F.col(features), scale))
    rows = with_once(rows, "_scored", predict(vector))
    p = F.nanvl(F.col("_scored.p"), F.lit(None).cast("double"))
    rows = rows.withColumns({"fraud_probability": p, "score_error": F.col("_scored.error")}).drop("_scored")
    return label_scores(rows, threshold, version)
