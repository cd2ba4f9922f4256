import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from llm.tables import clashing, docs
from txnguard.llm import simhash
from txnguard.llm.catalog import catalog


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(rows):
    """doc_id: (fingerprint, component) by comparing every two rows."""
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i][1] ^ fps[j][1]).bit_count() <= 3:
            root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(fps):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, f"{fp:016x}", least.get(find(k))) for k, (i, fp) in enumerate(fps)), key=str)


def test_query_equals_brute_force(spark, sf_dir):
    got = catalog()["op9_simhash_near_dedup"][0](spark, sf_dir)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, got.collect()), key=str) == brute_components(rows)


def test_spark_hash_agrees(spark):
    words = spark.range(50).select(F.concat(F.lit("à b "), "id").alias("t"))
    for t, h in words.select("t", F.xxhash64("t")).collect():
        assert xxhash.xxh64_intdigest(t.encode(), 42) == h % 2**64


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(5, None), (3, ""), (4, " \n\t"), (None, ""), (7, "one"), (8, "ONE"), (8, "ONE"), (None, "alone here"), (9, long), (2, long + " end"), (1, "two words")]
    got = simhash.near_duplicates(clashing(docs(spark, rows)))
    shown = [(r.doc_id, f"{r.fp % 2**64:016x}", r.component_id) for r in got.collect()]
    assert sorted(shown, key=str) == brute_components(rows)


def test_empty_table(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("parts", [
    [(list(range(k, k + 16)), 0) for k in range(0, 64, 16)],
    [(list(range(21)), 0), (list(range(21, 42)), 0), (list(range(42, 64)), 1)],
    [(list(range(32)), 1), (list(range(32, 64)), 1)],
    [(list(range(20)), 2), (list(range(20, 64)), 0)],
    [(list(range(8)), 3)],
])
@pytest.mark.parametrize("largest", [100_000, 40])
def test_links_keep_every_component(spark, parts, largest):
    """Whatever the parts and the largest run, the same components as by comparing all pairs."""
    rng = random.Random(len(parts) + largest)
    centres = [rng.getrandbits(64) for _ in range(12)]
    width = sum(len(b) for b, _ in parts)
    found = {c ^ sum(1 << b for b in rng.sample(range(width), rng.randrange(4))) for c in centres for _ in range(12)}
    found |= {centres[0] ^ sum(1 << b for b in rng.sample(range(width), 2)) for _ in range(60)}
    fps = np.array(sorted(found), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    probed = simhash.probe(simhash.signatures(df, parts), largest).cache()
    links = probed.filter("b is not null").select("a", "b").union(simhash.at_midpoints(probed.filter("b is null"), parts))
    got = {(int(np.int64(a).view(np.uint64)), int(np.int64(b).view(np.uint64))) for a, b in links.collect()}

    def classes(pairs):
        root = {int(x): int(x) for x in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        groups = {}
        for x in root:
            groups.setdefault(find(x), []).append(x)
        return sorted(map(sorted, groups.values()))

    near = [(a, b) for a, b in itertools.combinations(map(int, fps), 2) if (a ^ b).bit_count() <= 3]
    assert classes(got) == classes(near)


def test_thresholds_follow_the_pigeonhole(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(int(x),) for x in rng.integers(-(2**63), 2**63 - 1, 500)], "fp long")
    chosen = simhash.plan(df)
    assert sum(t + 1 for _, t in chosen) == 4
    assert len({b for bits, _ in chosen for b in bits}) == sum(len(bits) for bits, _ in chosen)
    large = simhash.allocate(10**9, [[1e12, 2e10, 3e13, 1e15], [5e9, 7e9, 1e12, 1e14]])
    assert sum(t + 1 for t in large[1]) == 4 and large[1] == [1, 1]


def test_correlated_bits_share_a_part():
    n, both = 1000, np.full((64, 64), 250.0)
    np.fill_diagonal(both, 500)
    for a in range(0, 64, 2):
        both[a, a + 1] = both[a + 1, a] = 500
    groups = simhash.group_bits(simhash.correlation(n, both), 4)
    assert all({a ^ 1 for a in g} == set(g) for g in groups)
    alone = simhash.chance_within(n, both, groups[0])[0]
    assert 2**-8 * 0.9 < alone < 2**-8 * 1.1


def test_survivors(spark):
    rows = [(4, "a b c d"), (2, "A b c d"), (2, "A b c d"), (9, "quite another text of words"), (None, "a b c d"), (None, "no id at all"), (None, "no id at all")]
    kept = simhash.survivors(clashing(docs(spark, rows))).select("doc_id", "text").collect()
    assert sorted(map(tuple, kept), key=str) == [(2, "A b c d"), (9, "quite another text of words"), (None, "no id at all")]


def test_rows_of_one_id_with_different_texts_stay(spark):
    rows = [(1, "one text of its own words"), (1, "quite another text with other words"), (2, "one text of its own words")]
    kept = simhash.survivors(docs(spark, rows)).select("doc_id", "text").collect()
    assert sorted(map(tuple, kept)) == sorted(rows[:2])
