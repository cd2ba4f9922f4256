"""The conversations' trie against one that holds every prefix in a dictionary, and the radix tree against a dict."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from txnguard.llm import art, trie
from txnguard.llm.catalog import catalog
from txnguard.llm.q_trie import rebuilt

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, rebuild=True):
    """All nodes, from (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    convs = {c: [t[1:] for t in sorted(own, key=lambda t: (t[0], hashlib.sha256(f"{len(t[1].encode())}:{t[1]}{t[2]}".encode()).hexdigest()[:32]))] for c, own in convs.items()}
    if rebuild:
        def new(c):
            h, base = zlib.crc32(str(c).encode()) % 9, c - (c % 5 if c >= 0 else -(-c % 5))
            return convs.get(base, [])[:h] + convs[c][h:]
        convs = {c: new(c) for c in convs}
    members, kids = defaultdict(list), defaultdict(set)
    for c, own in convs.items():
        for d in range(len(own) + 1):
            members[tuple(own[:d])].append(c)
            if d:
                kids[tuple(own[: d - 1])].add(tuple(own[:d]))
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, ids in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in kids
            saved[path[:d]] += (len(ids) - 1) * len(path[-1][1].encode()) if path else 0
    out = []
    for path, ids in members.items():
        ends = sorted(c for c in ids if len(convs[c]) == len(path))
        up = min(members[path[:-1]]) if path else None
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(ids), len(path), up, len(ids), len(kids[path]), leaves[path], saved[path], digest))
    return sorted(out, key=str)


def nodes(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def of(conversations, rebuild=True):
    return nodes(trie.prefix_trie(trie.paths(rebuilt(conversations) if rebuild else trie.turn_lists(conversations))))


def made(seed, convs):
    """Conversations with a hot first turn, groups of equal ones, prefixes of each other and long ones."""
    rng, rows = random.Random(seed), []
    for c in convs:
        n = rng.choice((1, 2, 3, 9, 40))
        kind = rng.random()
        for t in range(n):
            text = f"same {t}" if kind < 0.4 else f"ü{rng.randrange(3)}" if kind < 0.7 else f"own {c} {t}"
            rows.append((c, t, rng.choice(("user", None)) if kind > 0.9 else "user", text))
    rng.shuffle(rows)
    return rows


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert nodes(catalog()["op11_prefix_trie"][0](spark, sf_dir)) == brute(rows)


@pytest.mark.parametrize("sizes", [(8192, 65_536), (3, 65_536), (8192, 2), (1, 1)])
@pytest.mark.parametrize("rebuild", [True, False])
def test_trees_of_any_size_give_the_same_nodes(spark, monkeypatch, sizes, rebuild):
    rows = made(1, [*range(60), -7, -5, -1, 103, 10**15])
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    monkeypatch.setattr(trie, "TREE_KEYS", sizes[0])
    monkeypatch.setattr(trie, "TREE_ROWS", sizes[1])
    runs = trie.paths(rebuilt(df) if rebuild else trie.turn_lists(df)).orderBy("key", "conv_id").toArrow().to_batches()
    parts = [r for b in trie.trees(iter(runs)) for r in b.to_pylist()]
    assert sum(r["depth"] == 0 for r in parts) > 1 or sizes == (8192, 65_536)
    df = spark.createDataFrame(parts, trie.ROWS)
    shared = trie.merged(df.filter("shared"))
    want = brute(rows, rebuild)
    assert shared.count() + df.filter("not shared").count() == len(want)
    assert of(spark.createDataFrame(rows, SCHEMA), rebuild) == want


def test_small_trees_in_every_task(spark):
    """Ranges and trees of very few conversations, one conversation repeated often, and a chain of prefixes."""
    rows = [(c, t, "user", f"turn {t}") for c in range(120) for t in range(5)]
    rows += [(1000 + c, t, "user", f"deep {t}") for c in range(1, 40) for t in range(c)]
    rows += made(2, range(2000, 2050))
    df = spark.createDataFrame(rows, SCHEMA)

    def small(batches):  # in the worker
        trie.TREE_KEYS, trie.TREE_ROWS = 4, 9
        return trie.trees(batches)

    keyed = trie.paths(trie.turn_lists(df))
    found = keyed.repartitionByRange(7, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(small, trie.ROWS)
    assert found.filter("depth = 0").count() > 20
    whole = trie.merged(found.filter("shared")).drop("node")
    got = found.filter("not shared").agg(F.count("*"), F.sum("n_convs"), F.sum("n_leaves")).first()
    more = whole.agg(F.count("*"), F.sum("n_convs"), F.sum("n_leaves")).first()
    want = brute(rows, False)
    assert [a + b for a, b in zip(got, more, strict=True)] == [len(want), sum(r[3] for r in want), sum(r[5] for r in want)]
    root = next(r for r in want if r[1] == 0)
    top = whole.filter("depth = 0").first()
    assert (top.n_convs, top.n_children, top.n_leaves, top.saved_tokens) == root[3:7]


def test_odd_tables(spark):
    rows = [(5, None, None, None), (5, None, "a", "b"), (5, 1, "user", ""), (5, 1, "user", ""), (None, 1, "user", "lost"), (6, 2, "user", "x" * 10**6), (7, 2, "us", "erx")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS key", "2 AS bytes", "3 AS node", "4 AS turns", "5 AS h", "6 AS whose")
    assert of(df) == brute(rows) and of(df, False) == brute(rows, False)
    assert of(spark.createDataFrame([], SCHEMA)) == []


def test_turnless_conversations_are_members_of_the_root(spark):
    rows = [(c, t, "user", "x") for c in range(1, 5) for t in range(2)]  # their first one is absent
    got = of(spark.createDataFrame(rows, SCHEMA))
    assert got == brute(rows) and any(r[1] == 0 and r[3] == 4 for r in got)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.binary(max_size=6) | st.binary(min_size=1, max_size=1).map(lambda b: b"pre" + b), st.integers(), max_size=400))
def test_radix_tree_holds_what_a_dict_holds(known):
    tree = art.Tree()
    for key, value in known.items():
        tree.insert(key, -1)
        tree.insert(key, value)
    assert all(tree.get(k) == v for k, v in known.items())
    assert all(tree.get(k + b"\0") == known.get(k + b"\0") for k in known)
    values = [n.value for n, *_ in tree.upwards() if n.value is not None]
    assert sorted(values) == sorted(known.values())


def test_layouts_grow():
    tree, kinds = art.Tree(), []
    for i in range(256):
        tree.insert(bytes([i * 37 % 256]) + b"tail", i)
        kinds.append((type(tree.root.kids).__name__, getattr(tree.root.kids, "room", None)))
    assert [kinds[k] for k in (3, 4, 15, 16, 47, 48)] == [("Few", 4), ("Few", 16), ("Few", 16), ("Some", None), ("Some", None), ("Every", None)]
    assert [b for b, _ in tree.root.items()] == list(range(256))
    assert all(n.prefix == b"tail" for _, n in tree.root.items())  # the rest of a key is one path
