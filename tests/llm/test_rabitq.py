import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnguard.llm import rabitq
from txnguard.llm.catalog import catalog

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """(vec_id, n_links, component_id, kept) by comparing every two rows."""
    def fit(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    units = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if fit(v, label) else None for _, v, label in rows]
    links = [[] for _ in range(n)]
    groups = {}
    for k, u in enumerate(units):
        if u is not None:
            groups.setdefault((rows[k][2], len(u)), []).append(k)
    for own in groups.values():
        m = np.array([units[k] for k in own])
        for i, j in zip(*np.nonzero(m @ m.T >= 0.98), strict=True):
            if i != j:
                links[own[i]].append(own[j])
    out, seen = [], {}
    for k in range(n):
        if k not in seen:
            reach, todo = {k}, [k]
            while todo:
                for y in links[todo.pop()]:
                    if y not in reach:
                        reach.add(y)
                        todo.append(y)
            ids = [rows[y][0] for y in reach if rows[y][0] is not None]
            seen |= dict.fromkeys(reach, min(ids, default=None))
        out.append((rows[k][0], len(links[k]), seen[k], rows[k][0] == seen[k]))
    return sorted(out, key=str)


def run(df, **kw):
    return sorted(map(tuple, rabitq.near_duplicates(df, **kw).collect()), key=str)


def test_query_equals_brute_force(spark, sf_dir):
    got = sorted(map(tuple, catalog()["op1_embedding_near_dedup"][0](spark, sf_dir).collect()), key=str)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert got == brute(rows)


@pytest.fixture(scope="module")
def clusters():
    rng = np.random.default_rng(5)
    rows = []
    for k in range(60):
        centre = rng.normal(size=64)
        for _ in range(1 + k % 7 if k else 90):
            rows.append((len(rows), (centre + rng.normal(size=64) * rng.uniform(0.02, 0.2)).tolist(), k % 3))
    return rows


@pytest.mark.parametrize("block", [4096, 20])
def test_clusters_equal_brute_force(spark, clusters, block):
    """Also where band values are cut into many blocks."""
    df = spark.createDataFrame(clusters, SCHEMA)
    rows = [(i, df_v, label) for i, df_v, label in map(tuple, df.collect())]
    got, want = run(df, block=block), brute(rows)
    assert sum(g[1] for g in got) >= 0.999 * sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert [g[2:] for g in got] == [w[2:] for w in want]


def test_each_candidate_once(spark, clusters):
    df = spark.createDataFrame(clusters, SCHEMA).withColumn("key", F.col("vec_id"))
    for block in (4096, 15):
        pairs = rabitq.candidates(rabitq.signatures(df, 6, 12), block).collect()
        assert len(pairs) == len(set(pairs)) and all(p.a < p.b for p in pairs)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0), (2, [1.0, 2.0], 0), (3, [2.0, 4.0], 0), (4, [1.0, 2.0], 1), (5, [1.0, 2.0], None), (6, None, 0), (7, [], 0),
        (8, [0.0, -0.0], 0), (9, [nan, 1.0], 0), (10, [inf, 1.0], 0), (11, [None, 1.0], 0), (None, [1.0, 2.0], 0), (None, [5.0, -1.0], 2), (None, None, None),
        (12, [1.0, 2.0, 0.0], 0), (13, [3.0], 0), (14, [-3.0], 0), (15, [1e-38, 2e-38], 0), (16, [1e38, 2e38], 0),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("key", "a", "b", "first", "root", "n", "copies")})
    plain = [tuple(r) for r in df.select("vec_id", "embedding", "label").collect()]
    assert run(df) == brute(plain)
    assert run(spark.createDataFrame([], SCHEMA)) == []


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(9)
    a = rabitq.unit_rows(rng.normal(size=(400, 64)))
    noise = rabitq.unit_rows(rng.normal(size=(400, 64)))
    noise -= (noise * a).sum(1, keepdims=True) * a
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    b = 0.98 * a + math.sqrt(1 - 0.98**2) * noise
    _, pa_, sa, fa = rabitq.encode(a, 8, 4)
    _, pb, sb, _ = rabitq.encode(b, 8, 4)
    code, _ = rabitq.decode(pa_, sa, 64)
    _, query = rabitq.decode(pb, sb, 64)
    estimate = (code * query).sum(1) / fa
    assert estimate.mean() == pytest.approx(0.98, abs=0.01)
    assert all(rabitq.may_reach(code[k : k + 1], fa[k : k + 1], query[k : k + 1], sb[k : k + 1])[0, 0] for k in range(400))
    far = rabitq.may_reach(code, fa, query, sb)
    assert far.sum() <= 420


def test_bands_keep_the_miss_low():
    for n in (10, 10_000, 10**7, 10**10):
        bits, count = rabitq.bands(n)
        assert (1 - (1 - math.acos(0.98) / math.pi) ** bits) ** count <= 1e-5
