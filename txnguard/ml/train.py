"""Training: scale, split, oversample, boosted trees, evaluate per round, gate, save, register, activate."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnguard.functions.features import feature_array
from txnguard.ml import hist_boost, metrics, registry, scaler, smote, split
from txnguard.workdir import materialize
from txnguard.ship import ship

# The training settings.
SETTINGS = {"rounds": 300, "depth": 6, "rate": 0.05, "row_share": 0.8, "feature_share": 0.8, "seed": 42}


Model = GBTClassificationModel | hist_boost.Model


@dataclass
class Trained:
    model: Model
    scale: dict[str, tuple[float, float]]
    auroc: float | None
    auprc: float | None
    report: DataFrame
    test: DataFrame
    test_rows: DataFrame | None = None


def boosted_trees(rows: DataFrame, label: str = "Class", **changes) -> GBTClassificationModel:
    s = {**SETTINGS, **changes}
    return GBTClassifier(
        featuresCol="features_vec", labelCol=label, maxIter=s["rounds"], maxDepth=s["depth"], stepSize=s["rate"],
        subsamplingRate=s["row_share"], featureSubsetStrategy=str(s["feature_share"]), seed=s["seed"],
    ).fit(rows)


def positive_probability(model: Model, rows: DataFrame, vector: str = "features_vec") -> DataFrame:
    if isinstance(model, hist_boost.Model):
        return rows.withColumn("fraud_probability", model.probability_column(rows.sparkSession, vector_to_array(vector)))
    scored = model.setFeaturesCol(vector).transform(rows)
    return scored.withColumn("fraud_probability", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def train(
    df: DataFrame,
    id_col: str = "id",
    label: str = "Class",
    features: str = "features",
    ratio: float = 0.1,
    test_share: float = 0.2,
    scale_on_all: bool = True,
    trainer: str = "nodes",
    **settings,
) -> Trained:
    """``features`` is the map column. The scaling is fitted on all rows by default, before the split. ``trainer`` is
    ``histograms`` (columns drawn per tree) or ``nodes``, Spark's own trees (columns drawn per node)."""
    if trainer not in ("histograms", "nodes"):
        raise ValueError(f"unknown trainer {trainer!r}")
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(label).cast("int").alias(label), features)
    rows = split.stratified_split(rows, label, "id", test_share, settings.get("seed", SETTINGS["seed"]))
    base = rows if scale_on_all else rows.filter(~F.col("is_test"))
    plain = base.select(F.col(features)["Amount"].alias("Amount"), F.col(features)["Time"].alias("Time"))
    scale = scaler.fit(plain, ["Amount", "Time"])
    rows = rows.select("id", label, "is_test", feature_array(F.col(features), scale).alias("vector"))
    rows = materialize(rows, "training-rows")
    learn = smote.resample(rows.filter(~F.col("is_test")), label, "id", "vector", ratio=ratio)
    learn = materialize(learn, "training-set").withColumn("features_vec", array_to_vector("vector"))
    if trainer == "nodes":
        model = boosted_trees(learn, label, **settings)
    else:
        model = hist_boost.fit(learn, "id", label, "vector", **{**SETTINGS, **settings})
    test = rows.filter("is_test").withColumn("features_vec", array_to_vector("vector"))
    scored = positive_probability(model, test).select("id", label, "fraud_probability")
    found = metrics.ranking_metrics(scored, "fraud_probability", label).first()
    return Trained(
        model, scale, found.auroc if found else None, found.auprc if found else None,
        metrics.classification_report(scored, "fraud_probability", label), scored, test,
    )


def save(spark: SparkSession, trained: Trained, root: str, least: float = 0.85, version: str | None = None) -> str:
    """Gate first; then the files, then the registry row, then the activation that makes the version visible."""
    metrics.passes_gate(trained.auroc, least)
    version = version or registry.new_version()
    path = f"{root}/models/{version}"
    if isinstance(trained.model, hist_boost.Model):
        trained.model.save(spark, f"{path}/model")
    else:
        trained.model.write().overwrite().save(f"{path}/model")
    kind = "histograms" if isinstance(trained.model, hist_boost.Model) else "nodes"
    spark.createDataFrame([(kind,)], "value string").write.mode("overwrite").text(f"{path}/kind")
    text = json.dumps(trained.scale)
    spark.createDataFrame([(text,)], "value string").write.mode("overwrite").text(f"{path}/scale")
    registry.record(spark, root, version, trained.auroc, trained.auprc, f"models/{version}/model")
    return registry.activate(spark, root, version)


def load(spark: SparkSession, root: str, version: str) -> tuple[Model, dict]:
    path = f"{root}/models/{version}"
    scale = json.loads(spark.read.text(f"{path}/scale").first()[0])
    kind = spark.read.text(f"{path}/kind").first()[0]
    model = hist_boost.Model.load(spark, f"{path}/model") if kind == "histograms" else GBTClassificationModel.load(f"{path}/model")
    return model, {k: tuple(v) for k, v in scale.items()}
