import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from txnguard.operators import ordered as O


@pytest.fixture(scope="module")
def table():
    rng = random.Random(1)
    rows = [(i, "hot" if rng.random() < 0.5 else rng.choice("abc"), rng.choice([1.0, 2.5, 2.5, rng.random() * 9])) for i in range(500)]
    return pd.DataFrame(rows, columns=["idx", "k", "v"])


def test_previous_value(spark, table):
    df = spark.createDataFrame(table)
    got = O.previous_value(df, ["k"], F.floor(F.col("idx") / 13), ["idx"], "v", "p").toPandas().sort_values("idx")
    want = table.groupby("k")["v"].shift()
    assert np.allclose(got["p"].to_numpy(dtype=float), want.to_numpy(), equal_nan=True)


def test_previous_value_keeps_nulls(spark):
    df = spark.createDataFrame([(0, 1.0), (1, None), (2, 3.0)], "idx int, v double")
    got = O.previous_value(df, [], F.col("idx"), ["idx"], "v", "p").orderBy("idx").collect()
    assert [r.p for r in got] == [None, 1.0, None]


def test_running_totals(spark, table):
    df = spark.createDataFrame(table)
    got = O.running_totals(df, F.floor(F.col("idx") / 17), ["idx"], {"s": F.col("v"), "n": F.lit(1)}).toPandas().sort_values("idx")
    assert np.allclose(got["s"], table["v"].cumsum())
    assert got["n"].tolist() == list(range(1, 501))


def test_ranked_totals_descending(spark, table):
    df = spark.createDataFrame(table)
    got = O.ranked_totals(df, "v", {"n": F.lit(1)}, descending=True, buckets=8).toPandas().sort_values("v", ascending=False)
    want = table.groupby("v").size().sort_index(ascending=False).cumsum()
    assert got["cum_n"].tolist() == want.tolist()


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_exact_quantiles(spark, table, keys):
    df = spark.createDataFrame(table)
    got = O.exact_quantiles(df, "v", [0.0, 0.3, 0.5, 0.95, 1.0], keys).toPandas()
    for row in got.itertuples():
        part = table if not keys else table[table["k"] == row.k]
        assert np.isclose(row.value, np.quantile(part["v"], row.q))
    assert len(got) == 5 * (1 if not keys else table["k"].nunique())


def test_spread_chunks_copies_only_near_cuts(spark):
    df = spark.createDataFrame([(0,), (69,), (70,), (99,), (100,)], "ms long")
    got, chunk = O.spread_chunks(df, "ms", 31, 100)
    assert chunk == 100
    assert sorted((r.ms, r.chunk) for r in got.collect()) == [(0, 0), (69, 0), (70, 0), (70, 1), (99, 0), (99, 1), (100, 1)]
