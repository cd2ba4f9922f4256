import hashlib
import random

import numpy as np
import pytest

from llm.tables import clashing, docs
from txnguard.llm import winnowing
from txnguard.llm.catalog import catalog


def brute_winnow(text):
    """Window by window over the same hashes."""
    if not text:
        return []
    size = min(winnowing.GRAM, len(text))
    hashes = winnowing.gram_hashes(winnowing.code_points(text), size).tolist()
    window, kept = min(winnowing.WINDOW, len(hashes)), []
    for i in range(len(hashes) - window + 1):
        least = min(hashes[i : i + window])
        best = max(j for j in range(i, i + window) if hashes[j] == least)
        if not kept or kept[-1][1] != best:
            kept.append((hashes[best], best))
    return kept


def brute(rows):
    """Rows of (doc_id, text) in descending order, each beside the next."""
    texts = [(i, t or "") for i, t in rows]
    out = []
    for k, (i, t) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = ({h for h, _ in brute_winnow(x)} for x in (t, edited, after))
        hexed = ["".join(f"{h:08x}" for h in sorted(s)) for s in (a, b)]
        near = [len(a & x) / len(a | x) if a | x else 1.0 for x in (b, c)]
        grams = brute_winnow(t)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), *hexed, *near, [h for h, _ in grams], [p for _, p in grams]))
    return out


def run(spark, df, tmp_path):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in catalog()["op10_fingerprints"][0](spark, str(tmp_path)).collect()), key=str)


def test_query_equals_brute_force(spark, sf_dir):
    got = sorted(map(tuple, catalog()["op10_fingerprints"][0](spark, sf_dir).collect()))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = sorted(brute(sorted(rows, key=lambda r: -r[0])))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:7] for r in got], [r[5:7] for r in want])
    assert [r[7:] for r in got] == [r[7:] for r in want]


def test_equal_places_are_met_from_the_query(spark, tmp_path):
    """The positions that the query returns point at a k-gram that both texts have there."""
    rng = random.Random(3)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(winnowing.GRAM + winnowing.WINDOW - 1))
    rows = [(k, "".join(rng.choice("ijklm ") for _ in range(60 + 31 * k)) + shared + "zq" * (3 + k)) for k in range(6)]
    texts = dict(rows)
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: dict(zip(r.hashes, r.positions, strict=True)) for r in catalog()["op10_fingerprints"][0](spark, str(tmp_path)).collect()}
    for a in range(6):
        for b in range(a):
            met = [(got[a][h], got[b][h]) for h in got[a].keys() & got[b].keys()]
            assert met and all(texts[a][p : p + winnowing.GRAM] == texts[b][q : q + winnowing.GRAM] for p, q in met)
            assert any(p - texts[a].index(shared) == q - texts[b].index(shared) for p, q in met)


@pytest.mark.parametrize("n", [1, 5, 23, 24, 25, 149, 150, 151, 152, 400])
def test_windows(n):
    rng = random.Random(n)
    for letters in ("a", "ab", "abcdé\U0001F600"):
        text = "".join(rng.choice(letters) for _ in range(n))
        hashes, positions = winnowing.winnow(text)
        assert list(zip(hashes.tolist(), positions.tolist(), strict=True)) == brute_winnow(text)


def test_hash_depends_on_the_run_alone():
    text = "some text, and the same run again: some text"
    for size in (1, 2, 3, 7, 9):
        hashes = winnowing.gram_hashes(winnowing.code_points(text), size).tolist()
        by_run = {}
        for i, h in enumerate(hashes):
            assert by_run.setdefault(text[i : i + size], h) == h
        assert len(set(by_run.values())) == len(by_run)


def test_guarantee():
    """A passage of 150 characters that two texts share keeps a common k-gram at its place."""
    rng = random.Random(7)
    for _ in range(50):
        shared = "".join(rng.choice("abcdefgh ") for _ in range(winnowing.GRAM + winnowing.WINDOW - 1))
        before = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(300))) for _ in range(4)]
        a, b = before[0] + shared + before[1], before[2] + shared + before[3]
        kept = [{(h, p - len(x)) for h, p in zip(*map(list, winnowing.winnow(t)), strict=True) if 0 <= p - len(x) <= len(shared) - winnowing.GRAM} for t, x in ((a, before[0]), (b, before[2]))]
        assert kept[0] & kept[1]


def test_odd_rows(spark, tmp_path):
    rows = [(9, "x" * 20_000), (7, None), (6, ""), (5, "short"), (4, "é\U0001F600" * 90), (None, "no id")]
    assert run(spark, clashing(docs(spark, rows)), tmp_path) == sorted(brute(rows), key=str)


def test_repeated_rows(spark, tmp_path):
    got = run(spark, docs(spark, [(3, "same text here")] * 3 + [(2, "other")]), tmp_path)
    assert len(got) == 4 and len({r[3] for r in got if r[0] == 3}) == 1


@pytest.mark.parametrize("rows", [[], [(1, "alone and by itself")]])
def test_few_rows(spark, tmp_path, rows):
    assert run(spark, docs(spark, rows), tmp_path) == brute(rows)


def test_kept_positions(spark):
    got = winnowing.fingerprints(clashing(docs(spark, [(1, "some words " * 60), (2, None)]))).collect()
    assert [list(zip(r.hashes, r.positions, strict=True)) for r in got] == [brute_winnow("some words " * 60), []]


def test_short_texts_are_met_by_their_halves(spark, tmp_path):
    """Texts of 80 characters and more keep half of them in the edited text, which is long enough to be met."""
    rng = random.Random(11)
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(80 + 4 * i))) for i in range(50)]
    assert all(r[5] > 0 for r in run(spark, docs(spark, rows), tmp_path))
