"""Evaluation of scores against labels (1 = positive), exact, from counts per distinct score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnguard.operators.ordered import ranked_totals


class QualityGateError(ValueError):
    pass


def ranking_metrics(scored: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """``auroc`` and ``auprc`` (average precision, by steps) per key; null when only one class is present."""
    keys = list(keys)
    counts = {"tp": (F.col(label) == 1).cast("long"), "fp": (F.col(label) != 1).cast("long")}
    rows = ranked_totals(scored, score, counts, keys, descending=True)
    area = F.col("fp") * (F.col("cum_tp") - F.col("tp") / 2)
    precision = F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))
    sums = rows.groupBy(*keys).agg(
        F.sum("tp").alias("p"), F.sum("fp").alias("n"), F.sum(area).alias("area"),
        F.sum(F.col("tp") * precision).alias("steps"),
    )
    return sums.select(
        *keys,
        F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("area") / (F.col("p") * F.col("n"))).alias("auroc"),
        F.when(F.col("p") > 0, F.col("steps") / F.col("p")).alias("auprc"),
    )


def confusion(scored: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    predicted = (F.col(score) >= threshold).cast("int")
    return scored.groupBy(F.col(label).cast("int").alias("actual"), predicted.alias("predicted")).agg(F.count("*").alias("n"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def classification_report(scored: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """Rows for class 0, class 1, accuracy, macro and weighted mean; a zero denominator gives 0."""
    hit = (F.col(score) >= threshold).cast("int")
    actual = F.col(label).cast("int")
    c = scored.agg(
        F.count_if((actual == 0) & (hit == 0)).alias("tn"), F.count_if((actual == 0) & (hit == 1)).alias("fp"),
        F.count_if((actual == 1) & (hit == 0)).alias("fn"), F.count_if((actual == 1) & (hit == 1)).alias("tp"),
    )

    def of_class(good: str, wrongly: str, missed: str):
        g, w, m = F.col(good), F.col(wrongly), F.col(missed)
        return _ratio(g, g + w), _ratio(g, g + m), _ratio(2 * g, 2 * g + w + m), g + m

    zero, one = of_class("tn", "fn", "fp"), of_class("tp", "fp", "fn")
    total = zero[3] + one[3]
    accuracy = _ratio(F.col("tn") + F.col("tp"), total)
    lines = [
        ("0", *zero),
        ("1", *one),
        ("accuracy", accuracy, accuracy, accuracy, total),
        ("macro avg", *[(zero[i] + one[i]) / 2 for i in range(3)], total),
        ("weighted avg", *[_ratio(zero[i] * zero[3] + one[i] * one[3], total) for i in range(3)], total),
    ]
    fields = ("precision", "recall", "f1", "support")
    built = [F.struct(F.lit(n).alias("row"), *[v.alias(f) for v, f in zip(values, fields)]) for n, *values in lines]
    return c.select(F.inline(F.array(*built)))


def gate_frame(metrics: DataFrame, least: float = 0.85) -> DataFrame:
    return metrics.withColumn("passed", F.coalesce(F.col("auroc") >= least, F.lit(False)))


def passes_gate(auroc: float | None, least: float = 0.85) -> float:
    """Raises before anything is saved when the quality is too low."""
    if auroc is None or auroc < least:
        raise QualityGateError(f"AUROC {auroc} is below {least}: not deployed")
    return auroc


def dataset_profile(df: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("positives"), F.avg(label).alias("positive_rate")
    )
