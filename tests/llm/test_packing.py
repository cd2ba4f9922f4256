import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from llm.tables import clashing, docs
from txnguard.llm import packing
from txnguard.llm.catalog import catalog

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def known():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def own():
    return packing.Tokens(RANKS, public_tokenizers.PATTERN)


def check(pieces, texts, known):
    """Every piece against its document's ids; every sequence without gaps and within its size."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for doc, own in by_doc.items():
        ids = np.array([*known.encode(texts[doc] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= packing.WINDOW
    return len(by_sequence), sum(p.length for p in pieces)


def test_query(spark, sf_dir, known):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    pieces = catalog()["op5_packing"][0](spark, sf_dir).collect()
    assert {p.doc_id for p in pieces} == set(texts)
    n, tokens = check(pieces, texts, known)
    assert n <= 1.02 * tokens / packing.WINDOW + 1


def test_ids_of_odd_texts(known, own):
    texts = [
        "", " ", "  ", "a", " a", "a ", " a b ", "a  b", "a\n b", "a \nb", "it's we'll  I'M", "x<|endoftext|>y <|endoftext|> z", "日本 語　あ é", "  a b",
        "12 345a6", "a\tb c\x1cd", "!!! ???", "end\n", "\U0001F600 \U0001F469‍\U0001F467", "ſ 'S 's",
    ]
    for t in texts:
        assert own.encode(t).tolist() == known.encode(t, add_special_tokens=False).ids, repr(t)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é1'.s \n\t 　\x1d"), max_size=40))
def test_ids_of_random_texts(known, own, text):
    assert own.encode(text).tolist() == known.encode(text, add_special_tokens=False).ids


def test_level_is_nearly_equal():
    rng = random.Random(4)
    sizes = []
    while sum(sizes) < 128 * 2036:
        r = min(2047, int(rng.expovariate(1 / 1000)) + 1)
        sizes += [256] * (r // 256) + ([r % 256] if r % 256 else [])
    windows = packing.level(sizes)
    assert sorted(k for w in windows for k in w) == list(range(len(sizes)))
    sums = [sum(sizes[k] for k in w) for w in windows]
    assert max(sums) <= 2048 and len(windows) <= -(-sum(sizes) // 2048) + 2
    assert max(sums) - min(sums) < 200


@pytest.mark.parametrize("sizes", [[], [5], [2048], [1500, 1500, 1500], [2048] * 5, [1] * 3000, [1025] * 4])
def test_level_bounds(sizes):
    windows = packing.level(sizes)
    assert sorted(k for w in windows for k in w) == list(range(len(sizes)))
    assert all(sum(sizes[k] for k in w) <= 2048 for w in windows)


def test_odd_rows(spark, known):
    long = "word and another " * 40_000
    texts = {1: None, 2: "", 3: long, 4: "short one", 5: "x" * 30_000}
    pieces = packing.pack(clashing(docs(spark, texts.items())), RANKS, public_tokenizers.PATTERN).collect()
    check(pieces, texts, known)
    assert {p.doc_id: p.doc_tokens for p in pieces}[1] == 1
    repeated = packing.pack(docs(spark, [(None, "a b"), (7, "a b"), (7, "a b")]), RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((str(p.doc_id), p.start, p.length) for p in repeated) == [("7", 0, 3), ("7", 0, 3), ("None", 0, 3)]
    assert packing.pack(docs(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0
