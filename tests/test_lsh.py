"""Near neighbours by random projections against all distances, in blocks of any size, and odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnguard.ml import lsh
from txnguard.operators import scoring

SCHEMA = "id string, x array<double>"


def frame(spark, x):
    return spark.createDataFrame([(f"p{i:04d}", [float(v) for v in r]) for i, r in enumerate(x)], SCHEMA).repartition(3)


def brute(x, k):
    d = np.sqrt(((x[:, None] - x[None, :]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    return {(f"p{i:04d}", f"p{j:04d}") for i, r in enumerate(d) for j in np.argsort(r, kind="stable")[:k]}


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.standard_normal((120, 8)) + 7 * c for c in range(4)] + [rng.standard_normal((20, 8)) * 6])
    return x, frame(spark, x)


def test_recall_and_exact_distances(data):
    x, df = data
    got = lsh.near_neighbours(df, "id", "x", 5).collect()
    want = brute(x, 5)
    found = {(r.id, r.neighbour) for r in got} & want
    assert len(found) >= 0.9 * len(want)
    dense = {p for p in want if int(p[0][1:]) < 480}  # rows of the clusters; the others are farther off than a typical one
    assert len(found & dense) >= 0.98 * len(dense)
    for r in got:
        assert r.distance == pytest.approx(np.linalg.norm(x[int(r.id[1:])] - x[int(r.neighbour[1:])])) and r.id != r.neighbour
    ranks = {}
    for r in sorted(got, key=lambda r: (r.id, r.rank)):
        ranks.setdefault(r.id, []).append(r.distance)
    assert all(d == sorted(d) and len(d) <= 5 for d in ranks.values())


def test_blocks_lose_no_candidate(data):
    _, df = data
    rows = [sorted((r.id, r.neighbour, r["rank"]) for r in lsh.near_neighbours(df, "id", "x", 4, block_rows=n).collect()) for n in (4096, 25, 7)]
    assert rows[0] == rows[1] == rows[2]


def test_a_third_of_the_rows_are_one_point(spark):
    x = np.vstack([np.ones((60, 3)), np.random.default_rng(1).standard_normal((120, 3)) * 5])
    got = lsh.near_neighbours(frame(spark, x), "id", "x", 3, block_rows=16).groupBy("id").agg(F.count("*").alias("n"), F.max("distance").alias("far")).collect()
    same = [r for r in got if int(r.id[1:]) < 60]
    assert len(same) == 60 and all((r.n, r.far) == (3, 0.0) for r in same)


def test_sampled_distance_is_scaled_to_all_rows(spark):
    x = np.random.default_rng(5).uniform(size=(4000, 2))
    df = frame(spark, x)
    whole, part = lsh.typical_distance(df, 5, 4000), lsh.typical_distance(df, 5, 200)
    assert 0.5 < part / whole < 2


def test_crowded_cells_are_halved(spark):
    """Rows spread evenly in many dimensions, which projections alone leave in a few cells."""
    x = np.random.default_rng(8).standard_normal((3000, 12))
    df, want = frame(spark, x), brute(x, 5)
    points = df.cache()
    cells = lsh.cells_of(points, 4 * lsh.typical_distance(points, 5), lsh.TABLES, lsh.PROJECTIONS, 150)
    sizes = lsh.bucketed(points, cells, False).groupBy("tab", "bucket", "part").count()
    assert cells.tables > lsh.TABLES and sizes.agg(F.max("count")).first()[0] <= 450
    assert sizes.agg(F.sum("count")).first()[0] == 3000 * cells.tables
    found = {(r.id, r.neighbour) for r in lsh.near_neighbours(df, "id", "x", 5, cell_rows=150).collect()}
    assert len(found & want) >= 0.9 * len(want)


@pytest.mark.parametrize("rows", [[], [("a", [1.0])], [("a", None), ("b", [0.0]), ("c", [0.0])]])
def test_odd_tables(spark, rows):
    got = sorted((r.id, r.neighbour, r["rank"], r.distance) for r in lsh.near_neighbours(spark.createDataFrame(rows, SCHEMA), "id", "x", 5).collect())
    assert got == ([("b", "c", 1, 0.0), ("c", "b", 1, 0.0)] if len(rows) == 3 else [])


def test_failing_scorer_says_why(spark):
    df = spark.createDataFrame([("a", {f"V{i}": 1.0 for i in range(1, 29)} | {"Amount": 1.0, "Time": 1.0}), ("b", None)], "id string, features map<string,double>")

    def broken():
        raise TimeoutError("no answer")

    got = {r.id: r for r in scoring.score_python(df, broken).collect()}
    assert (got["a"].outcome, got["a"].score_error, got["a"].fraud_probability) == ("error", "TimeoutError: no answer", None)
    assert got["b"].outcome == "no_features" and got["b"].score_error is None
