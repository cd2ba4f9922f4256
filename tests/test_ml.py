import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from txnguard import schemas
from txnguard.ml import metrics, neighbours, registry, scaler, smote, split, train
from txnguard.operators import scoring


def test_scaler_uses_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0), (6.0, 3.0)], "a double, b double")
    params = scaler.fit(df, ["a", "b"])
    assert np.isclose(params["a"][1], np.std([1, 2, 6]))
    row = scaler.transform(df, params).filter("a = 6").first()
    assert np.isclose(row.a_sc, 3 / np.std([1, 2, 6])) and row.b_sc == 0.0


@pytest.mark.parametrize("share", [0.0, 0.2, 0.5])
def test_split_is_exact_per_class(spark, share):
    df = spark.range(1003).withColumn("y", (F.col("id") % 7 == 0).cast("int"))
    got = split.stratified_split(df, "y", "id", share).groupBy("y").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()
    for row in got:
        assert row.t == round(share * row.n)
    assert sum(r.n for r in got) == 1003


def knn_by_hand(points, k):
    out = {}
    for i, x in points.items():
        near = sorted((float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())), j) for j, y in points.items() if j != i)
        out[i] = [j for _, j in near[:k]]
    return out


@pytest.mark.parametrize("block_rows", [8, 10_000])
def test_neighbours_against_brute_force(spark, block_rows):
    rng = random.Random(5)
    points = {f"p{i:03d}": [rng.gauss(0, 1) + 6 * (i % 3) for _ in range(4)] for i in range(120)}
    # A third of the table is one point, and a few points come twice.
    points.update({f"c{i:03d}": [1.0, 1.0, 1.0, 1.0] for i in range(60)})
    points.update({f"d{i}": list(points[f"p{i:03d}"]) for i in range(5)})
    df = spark.createDataFrame(list(points.items()), "id string, x array<double>")
    got = neighbours.nearest(df, "id", "x", 5, block_rows).orderBy("id", "rank").collect()
    found = {}
    for r in got:
        found.setdefault(r.id, []).append(r.neighbour)
    assert found == knn_by_hand(points, 5)


def test_neighbours_of_very_few_rows(spark):
    df = spark.createDataFrame([("a", [0.0]), ("b", [1.0])], "id string, x array<double>")
    assert sorted((r.id, r.neighbour) for r in neighbours.nearest(df, "id", "x", 5).collect()) == [("a", "b"), ("b", "a")]


def test_oversampling(spark):
    rng = random.Random(2)
    rows = [(str(i), int(i < 20), [rng.random(), rng.random()]) for i in range(220)]
    df = spark.createDataFrame(rows, "id string, y int, x array<double>")
    new = smote.oversample(df, "y", "id", "x", ratio=0.5).collect()
    assert len(new) == int(0.5 * 200 - 20)
    points = {r[0]: r[2] for r in rows if r[1]}
    near = knn_by_hand(points, 5)
    for r in new:
        assert r.neighbour in near[r.base]
        a, b, v = np.array(points[r.base]), np.array(points[r.neighbour]), np.array(r.vector)
        u = (v - a)[0] / (b - a)[0]
        assert 0 <= u < 1 and np.allclose(v, a + u * (b - a))
    again = smote.oversample(df, "y", "id", "x", ratio=0.5).collect()
    assert sorted(map(str, again)) == sorted(map(str, new))
    assert smote.resample(df, "y", "id", "x", ratio=0.5).count() == 300
    with pytest.raises(ValueError):
        smote.oversample(df, "y", "id", "x", ratio=0.05)


def by_hand(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y]
    neg = [s for s, y in zip(scores, labels) if not y]
    auroc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap, tp_before = 0.0, 0
    for t in sorted(set(scores), reverse=True):
        tp = sum(y for s, y in zip(scores, labels) if s >= t)
        ap += (tp - tp_before) / len(pos) * tp / sum(s >= t for s in scores)
        tp_before = tp
    return auroc, ap


def test_ranking_metrics_with_ties(spark):
    rng = random.Random(4)
    rows = [(round(rng.random(), 1), rng.randrange(2)) for _ in range(300)]
    got = metrics.ranking_metrics(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()
    want = by_hand([r[0] for r in rows], [r[1] for r in rows])
    assert np.allclose((got.auroc, got.auprc), want)


def test_metrics_with_one_class(spark):
    got = metrics.ranking_metrics(spark.createDataFrame([(0.1, 0), (0.9, 0)], "s double, y int"), "s", "y").first()
    assert got.auroc is None and got.auprc is None
    with pytest.raises(metrics.QualityGateError):
        metrics.passes_gate(got.auroc)


def test_report_with_no_positive_prediction(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 1), (0.3, 1)], "s double, y int")
    rows = {r.row: r for r in metrics.classification_report(df, "s", "y").collect()}
    assert (rows["1"].precision, rows["1"].recall, rows["1"].f1, rows["1"].support) == (0.0, 0.0, 0.0, 2)
    assert np.isclose(rows["0"].precision, 1 / 3) and rows["0"].recall == 1.0
    assert np.isclose(rows["accuracy"].f1, 1 / 3) and np.isclose(rows["macro avg"].recall, 0.5)
    assert np.isclose(rows["weighted avg"].precision, 1 / 9)


def cards(spark, n=400):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        y = int(i % 8 == 0)
        f = {name: rng.gauss(3.0 * y, 1.0) for name in schemas.FEATURE_NAMES[:28]}
        rows.append((str(i), y, {**f, "Amount": rng.random() * 20 + 1000 * y, "Time": float(i)}))
    return spark.createDataFrame(rows, "id string, Class int, features map<string,double>")


@pytest.mark.parametrize("settings", [{"rounds": 3, "depth": 3}, {"rounds": 60, "depth": 3, "rate": 0.2, "trainer": "histograms"}])
def test_train_save_activate_score(spark, tmp_path, settings):
    df = cards(spark)
    root = str(tmp_path / "models")
    t = train.train(df, ratio=0.5, **settings)
    assert t.auroc > 0.95
    version = train.save(spark, t, root, version="20240101_000000")
    model, scale = train.load(spark, root, version)
    rare = {**{f"V{i}": 3.0 for i in range(1, 29)}, "Amount": 1010.0, "Time": 406.0}
    plain = {**{f"V{i}": 0.0 for i in range(1, 29)}, "Amount": 15.0, "Time": 0.0}
    rows = spark.createDataFrame([("x", rare), ("n", plain), ("none", None)], "id string, features map<string,double>")
    got = {r.id: r for r in scoring.score(rows, model, scale, 0.5, version).collect()}
    assert set(got) == {"x", "n"}
    assert got["x"].is_fraud and not got["n"].is_fraud and got["x"].model_version == version
    assert got["n"].fraud_probability < 0.2 and got["x"].fraud_probability > 0.8
    assert scoring.skipped(rows).collect()[0].skip_reason == "no_features"
    with pytest.raises(registry.UnknownVersion):
        registry.activate(spark, root, "nope")
    registry.record(spark, root, "20240102_000000", 0.91, 0.5, "models/x")
    assert registry.active_version(spark, root).version == version
    assert registry.activate(spark, root, "latest") == "20240102_000000"
    assert registry.activate(spark, root, version) == version
    listed = {r.version: r.is_active for r in registry.listing(registry.entries(spark, root), registry.activations(spark, root)).collect()}
    assert listed == {version: True, "20240102_000000": False}
    assert registry.active_info(spark, root).first().version == version


def test_gate_saves_nothing(spark, tmp_path):
    root = str(tmp_path / "gated")
    t = train.Trained(None, {}, 0.5, 0.1, None, None)
    with pytest.raises(metrics.QualityGateError):
        train.save(spark, t, root)
    assert registry.entries(spark, root).count() == 0 and registry.active_version(spark, root) is None


def test_python_scorer_and_its_failure(spark):
    df = cards(spark, 20).withColumn("features", F.when(F.col("id") != "3", F.col("features")))

    def load():
        return lambda x: 1 / (1 + np.exp(-(x[:, 0] - 1)))

    got = {r.id: r for r in scoring.score_python(df, load, version="p").collect()}
    assert got["3"].outcome == "no_features" and got["3"].fraud_probability is None
    assert all(r.outcome == "scored" and 0 < r.fraud_probability < 1 for i, r in got.items() if i != "3")

    def broken():
        raise RuntimeError("scorer down")

    got = scoring.score_python(df, broken).groupBy("outcome").count().collect()
    assert {r.outcome: r["count"] for r in got} == {"error": 19, "no_features": 1}


def test_linear_score(spark):
    df = cards(spark, 10)
    got = scoring.score_linear(df, [0.0] * 30, 0.0).collect()
    assert all(r.fraud_probability == 0.5 and r.is_fraud for r in got)
