"""Boosted trees from histograms: the same trees however rows are dealt, splits by brute force, and odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnguard.ml import hist_boost as H
from txnguard.ml import metrics

SCHEMA = "id string, y int, x array<double>"


def made(n, seed=0, features=5):
    rng = np.random.default_rng(seed)
    x = np.round(rng.standard_normal((n, features)), 3)
    y = (x[:, 0] - 0.5 * x[:, 1] ** 2 + 0.3 * rng.standard_normal(n) > 0).astype(int)
    return x, y


def frame(spark, x, y, parts=3):
    rows = [(str(i), int(c), [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def same(a, b):
    return len(a.trees) == len(b.trees) and all(
        (s.feature == t.feature).all() and (s.at == t.at).all() and (s.value == t.value).all() for s, t in zip(a.trees, b.trees, strict=True)
    )


@pytest.fixture(scope="module")
def data(spark):
    x, y = made(900)
    return x, y, frame(spark, x, y)


def test_blocks_and_partitions_do_not_change_the_trees(spark, data, monkeypatch):
    x, y, df = data
    settings = {"rounds": 4, "depth": 3, "rate": 0.3}
    one = H.fit(df, "id", "y", "x", **settings)
    assert same(one, H.fit(df, "id", "y", "x", block_rows=200, **settings))
    assert same(one, H.fit(df.repartition(7), "id", "y", "x", **settings))
    monkeypatch.setattr(H, "ROUNDS_HELD", 3)  # margins are written between the rounds
    assert same(one, H.fit(df, "id", "y", "x", block_rows=500, **settings))


def brute_split(x, y, edges, columns, margin):
    """The best split by trying each, with sums over the rows."""
    p = 1 / (1 + np.exp(-margin))
    g, h, best = p - y, p * (1 - p), (0, None, None)
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + H.LAMBDA)
    for c in columns:
        for b, e in enumerate(edges[c]):
            left = x[:, c] <= e
            if h[left].sum() >= 1 and h[~left].sum() >= 1:
                gain = (score(left) + score(~left) - score(np.full(len(y), True))) / 2
                if gain > best[0] + 1e-6:
                    best = (gain, c, b)
    return best


def test_splits_and_leaves_by_brute_force(data):
    x, y, df = data
    model = H.fit(df, "id", "y", "x", rounds=3, depth=1, rate=0.5, row_share=1.0, feature_share=0.6, seed=5)
    for j, e in enumerate(model.edges):
        assert set(e) <= set(x[:, j]) and len(e) == H.BINS - 1
        assert np.abs(np.array([(x[:, j] <= v).mean() for v in e]) - np.arange(1, H.BINS) / H.BINS).max() < 0.01
    margin = np.zeros(len(y))
    for k, tree in enumerate(model.trees):
        columns = H.drawn_columns(5, 0.6, 5, k)
        gain, c, b = brute_split(x, y, model.edges, columns, margin)
        assert (tree.feature[0], tree.at[0]) == (c, b) and tree.gain[0] == pytest.approx(gain, abs=1e-4)
        p = 1 / (1 + np.exp(-margin))
        left = x[:, c] <= model.edges[c][b]
        for node, side in ((1, left), (2, ~left)):
            assert tree.value[node] == pytest.approx(-0.5 * (p - y)[side].sum() / ((p * (1 - p))[side].sum() + 1), abs=1e-6)
        margin += np.where(left, tree.value[1], tree.value[2])
    assert np.allclose(model.probability(x), 1 / (1 + np.exp(-margin)))


def test_columns_and_rows_are_drawn_per_tree(data):
    x, y, df = data
    model = H.fit(df, "id", "y", "x", rounds=8, depth=4, feature_share=0.4)
    used = [set(t.feature[t.feature >= 0].tolist()) for t in model.trees]
    assert all(len(u) <= 2 and u <= set(H.drawn_columns(5, 0.4, 42, k).tolist()) for k, u in enumerate(used)) and len(set().union(*used)) > 2
    block = {"y": np.zeros(20_000, np.int8).tobytes(), "rid": np.arange(20_000).tobytes(), "bins": b"\0" * 20_000, "margin": np.zeros(20_000).tobytes()}
    rows = H.Rows(block, [])
    a, b = rows.drawn(0, 0.8, 42), rows.drawn(1, 0.8, 42)
    assert abs(a.mean() - 0.8) < 0.02 and abs((a & b).mean() - 0.64) < 0.02


def test_learns_and_logs_rounds(spark, data):
    x, y, df = data
    model = H.fit(df, "id", "y", "x", rounds=40, depth=4, rate=0.2)
    xt, yt = made(600, seed=9)
    test = frame(spark, xt, yt)
    log = {r["round"]: r for r in H.round_log(model, test, "id", "y", "x", every=15).collect()}
    assert sorted(log) == [15, 30, 40] and log[40].log_loss < log[15].log_loss
    p = model.probability(xt)
    assert log[40].log_loss == pytest.approx(-np.mean(np.where(yt == 1, np.log(p), np.log(1 - p))))
    scored = test.withColumn("p", model.probability_column(spark, F.col("x")))
    found = metrics.ranking_metrics(scored, "p", "y").first()
    assert log[40].auprc == pytest.approx(found.auprc) and found.auroc > 0.9
    assert all(abs(r.p - p[int(r.id)]) < 1e-12 for r in scored.collect())


def test_histogram_of_drawn_rows():
    x, y = made(700, seed=4)
    rng, columns = np.random.default_rng(3), np.array([0, 2, 4])
    bins = rng.integers(0, H.BINS, (700, 5)).astype(np.uint8)
    block = {"y": y.astype(np.int8).tobytes(), "rid": np.arange(700).tobytes(), "bins": bins.tobytes(), "margin": rng.standard_normal(700).tobytes()}
    rows, tree, s = H.Rows(block, []), H.Tree.empty(3), {"row_share": 0.7, "seed": 1}
    tree.feature[[0, 2]], tree.at[[0, 2]] = (2, 4), (30, 10)
    used, (g, h), node = rows.drawn(6, 0.7, 1), rows.gradients(), tree.places(bins)
    got = H.Drawn.of(rows, 6, columns, s).histogram(tree, 3, columns)
    assert got.shape == (3, 2, 4, H.BINS) and not got[:, :, :2].any()
    for k, c in enumerate(columns):
        for slot in (2, 3):
            for b in range(H.BINS):
                on = used & (node == 3 + slot) & (bins[:, c] == b)
                assert got[k, 0, slot, b] == g[on].sum() and got[k, 1, slot, b] == h[on].sum()


def test_a_level_of_many_blocks_is_one_job(spark, data):
    x, y, df = data
    spark.sparkContext.setJobGroup("levels", "levels")
    try:
        model = H.fit(df, "id", "y", "x", block_rows=200, rounds=6, depth=3, rate=0.3)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("levels")
    assert len(model.trees) == 6 and len(jobs) < 2 * 6 * 3


def test_ordinary_and_abnormal_rows(spark):
    rng = np.random.default_rng(1)
    x = np.vstack((rng.standard_normal((400, 3)), rng.standard_normal((60, 3)) + 6))
    model = H.fit(frame(spark, x, np.array([0] * 400 + [1] * 60)), "id", "y", "x", rounds=60, depth=3, rate=0.2)
    assert model.probability(np.zeros((1, 3)))[0] < 0.2 < 0.8 < model.probability(np.full((1, 3), 6.0))[0]


def test_saved_and_loaded(spark, data, tmp_path):
    x, _, df = data
    model = H.fit(df, "id", "y", "x", rounds=3, depth=2)
    model.save(spark, str(tmp_path))
    again = H.Model.load(spark, str(tmp_path))
    assert same(model, again) and (again.probability(x) == model.probability(x)).all()


def test_odd_tables(spark):
    empty = H.fit(spark.createDataFrame([], SCHEMA), "id", "y", "x")
    assert empty.edges == [] and empty.trees == []
    flat = [(str(i), i % 2, [1.0, float("nan")]) for i in range(40)]
    model = H.fit(spark.createDataFrame(flat, SCHEMA), "id", "y", "x", rounds=2, row_share=1.0)
    assert (model.probability(np.array([[1.0, np.nan], [5.0, 2.0]])) == 0.5).all()
    single = H.fit(spark.createDataFrame([(None, 1, [0.0])] * 50, SCHEMA), "id", "y", "x", rounds=5, row_share=1.0)
    assert single.probability(np.array([[0.0]]))[0] > 0.5
    rows = spark.createDataFrame([("a", None)], "id string, x array<double>")
    assert rows.select(model.probability_column(spark, F.col("x")).alias("p")).first().p is None
