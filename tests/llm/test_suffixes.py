import hashlib
import itertools
import random

import numpy as np
import pytest

from llm.tables import clashing, docs
from txnguard.llm import suffixes
from txnguard.llm.catalog import catalog


def brute(rows):
    """Every 50-byte string of every document in one dictionary."""
    least = {}
    for i, text in rows:
        data = (text or "").encode()
        if i is not None:
            for k in range(len(data) - 49):
                s = data[k : k + 50]
                least[s] = min(i, least.get(s, i))
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 49) if i is not None else ():
            if least[data[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k, g in itertools.groupby(gone) if k)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(df):
    return sorted(map(tuple, suffixes.remove_repeats(df).collect()), key=str)


def test_cover():
    assert {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.PERIOD))


def test_query_equals_brute_force(spark, sf_dir):
    got = sorted(map(tuple, catalog()["op3_suffix_dedup"][0](spark, sf_dir).collect()), key=str)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got == brute(rows)


def pieces(seed):
    rng = random.Random(seed)
    parts = ["".join(rng.choice("abc é") for _ in range(rng.choice((20, 48, 50, 51, 52, 70, 130)))) for _ in range(25)]
    rows = [(rng.randrange(200), "".join(rng.choice(parts) for _ in range(rng.randrange(6)))) for _ in range(80)]
    return [*rows, (1000, "ab" * 300), (1001, "ba" * 40), (1002, "a" * 49), (1003, "a" * 49)]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("small", [False, True])
def test_random_texts(spark, monkeypatch, seed, small):
    """Passages around the limit, at all shifts, in one chunk or many, in one bucket or many."""
    if small:
        monkeypatch.setattr(suffixes, "CHUNK_BYTES", 300)
        monkeypatch.setattr(suffixes, "BUCKET_KEYS", 200)
    rows = pieces(seed)
    assert run(docs(spark, rows).repartition(3)) == brute(rows)


def test_odd_rows(spark):
    line = "a passage of more than fifty bytes that stands in several of these texts"
    rows = [
        (1, None), (2, ""), (3, line), (4, line), (4, line), (None, line), (None, "x" + line), (5, "é" * 24 + "xx"), (6, "é" * 24 + "xx"), (7, "short"), (8, "short"),
        (9, "before " + line + " after " + line), (-5, "zz " + line), (10, "w " * 30_000), (11, " w" * 100),
    ]
    assert run(clashing(docs(spark, rows))) == brute(rows)
    assert run(docs(spark, [])) == []


def test_squeeze():
    for x in (np.zeros(0, np.uint64), np.arange(5, dtype=np.uint64) << np.uint64(60)):
        assert suffixes.unsqueeze(suffixes.squeeze(x)).tolist() == x.tolist()


def test_buckets_are_ranges_of_keys():
    for bits in (20, 32, 40, 64):
        keys = np.sort(np.random.default_rng(bits).integers(0, 2**bits - 1, 2000, dtype=np.uint64))
        b = suffixes.bucket_of(keys, bits, 7)
        assert (np.diff(b) >= 0).all() and b.min() == 0 and b.max() == 6


def test_text_is_not_shuffled_again(spark, sf_dir):
    """The packed texts are bucketed by chunk, so that no join moves them."""
    df = suffixes.remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.split("\n") if "Exchange hash" in line]
    assert not any("body" in line for line in moved)


@pytest.mark.parametrize("small", [False, True])
def test_strings_that_share_a_key_stay_apart(spark, monkeypatch, small):
    """Keys of so few bits that different strings often have the same one."""
    monkeypatch.setattr(suffixes, "SUFFIX_SPARE", -2)
    if small:
        monkeypatch.setattr(suffixes, "CHUNK_BYTES", 300)
    rows = pieces(5)
    assert run(docs(spark, rows).repartition(3)) == brute(rows)
