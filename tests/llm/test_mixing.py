import random
import re
from collections import defaultdict

import pytest

from llm.tables import clashing, docs
from txnguard.llm import mixing
from txnguard.llm.catalog import catalog


def brute_targets(sizes):
    """Sizes by source; shares one round after the other until no target is above twice its source."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        target = {s: 2 * sizes[s] if s in capped else left * weight[s] / free for s in order}
        more = {s for s in order if target[s] > 2 * sizes[s]}
        if not more:
            return target
        capped |= more


def judge(rows, source_of, texts):
    """Every row of a result against its text; returns words taken by source."""
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, t in texts.items():
        sizes[source_of[i]] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    target = brute_targets(dict(sizes))
    for r in rows:
        own = source_of[r.doc_id]
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or ""))
        assert r.source_size == sizes[own] and r.target == pytest.approx(target[own])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[own] += r.taken
    return sizes, target, taken


def test_query(spark, sf_dir):
    run = catalog()["op7_mixing"][0]
    got = run(spark, sf_dir).collect()
    source = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(source)
    texts, source_of = {r.doc_id: r.text for r in source}, {r.doc_id: r.source for r in source}
    _, target, taken = judge(got, source_of, texts)
    largest = max(r.size for r in got)
    assert all(abs(taken[s] - t) <= largest for s, t in target.items())
    assert sorted(run(spark, sf_dir).collect()) == sorted(got)


def test_same_rows_in_another_layout(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    other = df.repartition(7, "text")
    assert sorted(mixing.mixture(df).collect()) == sorted(mixing.mixture(other).collect())


def test_many_rows_balance(spark):
    texts = {i: "w " * (1 + i * 7919 % 97) for i in range(6000)}
    source_of = {i: "abcd"[0 if i % 3 == 0 else i % 4] for i in texts}
    got = mixing.mixture(docs(spark, [(i, t, None, source_of[i]) for i, t in texts.items()])).collect()
    _, target, taken = judge(got, source_of, texts)
    assert all(abs(taken[s] - t) <= 97 for s, t in target.items())


def test_odd_rows(spark):
    rows = [(1, None, "x", None), (2, "", "x", "b"), (3, "one two", "x", "b"), (None, "one two three", "x", "a"), (4, "long " * 100_000, "x", "a"), (5, "e e f", "x", "zé"), (6, "g", "x", "zé"), (7, "g", "x", None)]
    got = mixing.mixture(clashing(docs(spark, rows))).collect()
    judge(got, {r[0]: r[3] for r in rows}, {r[0]: r[1] for r in rows})
    repeated = mixing.mixture(docs(spark, [(1, "a b", "x", "s")] * 9)).collect()
    assert len(repeated) == 9 and sum(r.taken for r in repeated) in (26, 28)
    assert mixing.mixture(docs(spark, [])).count() == 0
    assert [tuple(r) for r in mixing.mixture(docs(spark, [(1, " ", "x", "s")])).collect()] == [(1, 0, 0, 0.0, 0)]


def test_steps_keep_size_and_number():
    flight = mixing.Flight(land=False)
    flight.begin("g")
    sizes = [(k * 37) % 50 + 1 for k in range(500)]
    done = [u for s in sizes for u in flight.add([s, 0.3, None, None])]
    left = flight.active
    assert len(left) <= 2
    every = done + left
    assert sum(u[1] for u in every) == pytest.approx(150) and sum(u[0] * u[1] for u in every) == pytest.approx(0.3 * sum(sizes))
    assert all(u[1] in (0, 1) for u in done)


def test_draws_are_unbiased():
    hits = 0
    for k in range(4000):
        flight = mixing.Flight(land=True)
        flight.begin(f"g{k}")
        units = [[s, 0.35, i, None] for i, s in enumerate((5, 9, 2, 7))]
        done = [u for unit in units for u in flight.add(unit)] + flight.end()
        hits += sum(u[1] for u in done if u[2] == 1)
    assert hits / 4000 == pytest.approx(0.35, abs=0.03)


def test_mixed_documents(spark, sf_dir):
    df = clashing(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns
    times = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert max(times.values()) == 2 and 0.9 < sum(times.values()) / df.count() / 1.5 < 1.1


def test_landing_in_levels(spark, monkeypatch):
    """Blocks of a few rows leave more undecided rows than a block holds: these fly again, block by block."""
    rng, flights = random.Random(4), []
    rows = [(i, " ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(1, 40))), "en", ("web", "book", None)[i % 3]) for i in range(900)]
    plain = mixing.materialize
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 8)
    monkeypatch.setattr(mixing, "materialize", lambda df, name: flights.append(name) or plain(df, name))
    got = mixing.mixture(docs(spark, rows)).collect()
    assert flights.count("mix-flown") > 2
    words = {None: 0, "web": 0, "book": 0}
    source = {i: s for i, _, _, s in rows}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        words[source[r.doc_id]] += r.taken
    target = {source[r.doc_id]: r.target for r in got}
    assert len(got) == 900 and all(abs(words[s] - t) <= 40 for s, t in target.items())
