"""Whitening against numpy on the collected vectors, and contour integration against numpy's eigenpairs."""

import numpy as np
import pytest

from txnguard.llm import feast, whitening
from txnguard.llm.catalog import catalog

SCHEMA = "vec_id long, embedding array<float>, label int"
COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def brute(vectors, k=8):
    """x-vectors by id, their deviations, and whitened coordinates, up to sign."""
    ids = list(vectors)
    x = np.floor(np.array([vectors[i] for i in ids], float) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    y = x - s / n
    v = y.T @ y / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    return ids, deviation, y @ q / np.sqrt(e), e / v.trace(), e / e[0]


def judge(rows, vectors, k=8):
    ids, deviation, white, explained, share = brute(vectors, k)
    got = {(r.vec_id, r.component): r for r in rows}
    k = min(k, white.shape[1])
    assert len(rows) == len(got) == len(ids) * k
    for j in range(k):
        own = np.array([got[i, j + 1].whitened for i in ids])
        apart = min([abs(share[j] - share[m]) for m in range(k) if m != j], default=1)
        if apart > 1e-6:
            assert min(np.abs(own - white[:, j]).max(), np.abs(own + white[:, j]).max()) < 1e-6
        assert abs(np.mean(own**2) - 1) < 1e-9 and abs(own.mean()) < 1e-9
        assert all(abs(got[i, j + 1].explained - explained[j]) < 1e-9 for i in ids[:5])
    assert [got[i, 1].deviation for i in ids] == deviation
    assert {r.n for r in rows} == {len(ids)} and len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


def test_query_equals_numpy(spark, sf_dir):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    df = catalog()["op12_whitening"][0](spark, sf_dir)
    assert df.columns == COLUMNS
    judge(df.collect(), vectors)


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    good = {i: [float(np.float32(v)) for v in rng.standard_normal(6) * [9, 5, 1, 1, 0.1, 300]] for i in range(50)}
    rows = [(i, v, 1) for i, v in good.items()]
    odd = [None, [], [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [0.0] * 5 + [float("inf")], [-float("inf")] + [0.0] * 5, [1.0] * 3]
    rows += [(100 + k, v, None) for k, v in enumerate(odd)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS x", "2 AS own", "3 AS component", "4 AS n", "5 AS deviation").repartition(5)
    got = whitening.whiten(df).collect()
    assert {r.component for r in got} == set(range(1, 7))
    judge(got, good)


def test_repeats_ids_and_tables_without_variance(spark):
    rows = [(None, [1.0, 2.0], 0), (3, [1.0, 2.0], 0), (3, [4.0, -8.0], 0), (3, [4.0, -8.0], 0)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 4 and {r.component for r in got} == {1} and {r.n for r in got} == {4}  # on one line: one component
    assert sorted(abs(r.whitened) for r in got) == pytest.approx([1.0] * 4)
    for table in ([], [(1, None, 0)], [(1, [1.0, 2.0], 0)], [(i, [0.5, 0.5], 0) for i in range(9)]):
        out = whitening.whiten(spark.createDataFrame(table, SCHEMA))
        assert out.columns == COLUMNS and out.collect() == []


def test_deviation_is_exact_or_null():
    fit = whitening.Fit(3, (10**9, 5, 6), np.zeros(0), np.zeros((3, 0)), 0.0)
    x = np.array([[10**9, 1, 2], [0, 5, 5], [2 * 10**9, 1, 1]])
    want = [sum((3 * int(a) - s) ** 2 for a, s in zip(r, fit.sums, strict=True)) for r in x]
    assert whitening.deviations(fit, x) == [w if w <= 2**63 - 1 else None for w in want] and max(want) > 2**63 - 1


def with_eigenvalues(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    m = (q * values) @ q.T
    return (m + m.T) / 2


SPECTRA = {
    "falling": np.geomspace(1e6, 1e-6, 64),
    "close": np.concatenate((1000 + np.arange(12) * 1e-7, np.arange(40) * 1.0)),
    "equal": np.array([7.0] * 20 + [3.0] * 5 + [0.0] * 10),
    "zero": np.zeros(12),
    "one": np.array([4.0]),
    "negative": np.linspace(-50, 3, 30),
    "rank one": np.array([0.0] * 63 + [1e9]),
}


@pytest.mark.parametrize("name", SPECTRA)
def test_contour_integration_finds_every_eigenpair(name):
    want = np.sort(SPECTRA[name])[::-1]
    m = with_eigenvalues(SPECTRA[name])
    scale = max(np.abs(want).max(), 1e-300)
    for k in (1, 8, len(want)):
        values, vectors = feast.largest(m, k)
        k = min(k, len(want))
        assert np.abs(values - want[:k]).max() <= 1e-12 * scale
        assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
        assert np.abs(m @ vectors - vectors * values).max() <= 1e-11 * scale


def test_inertia_counts():
    values = np.array([-3.0, -1, 0, 2, 2, 2, 9])
    inertia = feast.Inertia(with_eigenvalues(values))
    assert [inertia.below(s) for s in (-4, -2, -0.5, 1, 3, 10)] == [0, 1, 2, 3, 6, 7]


def test_missed_eigenvalues_are_not_passed_over():
    with pytest.raises(ArithmeticError):
        feast.in_interval(with_eigenvalues(np.arange(10.0)), 2.5, 4.5, 3, 9.0)  # there are two
