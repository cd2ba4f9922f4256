"""Encoding in stitched chunks against the tokenizer on whole texts, and decoding as an exact round trip."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from llm.tables import clashing, docs
from txnguard.llm import bpe
from txnguard.llm.catalog import catalog

FILES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def plain():
    with open(FILES[0], "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("plain", pat_str=FILES[1], mergeable_ranks=ranks, special_tokens={})


def hard_texts():
    rng = random.Random(5)
    kinds = ["a", "Zü", " ", "  ", "\n", "\t\n ", "'", "'ll", "'re", "'s", "7", "٣", "!", "...", "😀", "é", "日本", " ", "　", "<|endoftext|>"]
    texts = ["".join(rng.choice(kinds) * rng.choice((1, 1, 2, 9)) for _ in range(rng.choice((3, 40, 400)))) for _ in range(60)]
    return texts + ["x" * 500, " " * 500, "'" * 301, "ab " * 200, "x" * 70 + " y" * 90, "1" * 200 + "'re" * 50, None, "", "a"]


def test_query_equals_the_tokenizer(spark, sf_dir, plain):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = catalog()["op13_byte_bpe"][0](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = plain.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@pytest.mark.parametrize(("chunk", "overlap"), [(16, 6), (64, 16), (100, 100)])
def test_any_chunks_give_the_same_ids(spark, plain, chunk, overlap):
    texts = hard_texts()
    got = bpe.encode(docs(spark, list(enumerate(texts))).repartition(3), *FILES, chunk=chunk, overlap=overlap)
    got = {r.doc_id: r for r in bpe.decode(got, *FILES).collect()}
    assert sorted(got) == list(range(len(texts)))
    for i, t in enumerate(texts):
        assert got[i].ids == plain.encode_ordinary(t or "") and bytes(got[i].decoded) == (t or "").encode()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab' \n\tlred1!é😀 ")), max_size=120), st.integers(8, 20), st.integers(5, 12))
def test_joints_are_starts_of_the_whole_text(text, chunk, overlap):
    """Wherever two neighbouring chunks meet, the whole text has a pre-token begin, if the left one is right there."""
    known = bpe.vocabulary(*FILES)
    truth = set(known.spans(text)[0].tolist())
    starts, right = bpe.chunk_starts(len(text), chunk, overlap), 0
    for k, start in enumerate(starts):
        part = text[start : start + chunk + overlap]
        begin, end = known.spans(part)
        sure = begin if k == len(starts) - 1 else begin[[e <= len(part) - bpe.LOOK for e in [0, *end[:-1].tolist()]]]
        assert {start + b for b in sure.tolist() if start + b >= right} <= truth
        if k + 1 < len(starts):
            after = text[starts[k + 1] : starts[k + 1] + chunk + overlap]
            their = {starts[k + 1] + b for b in known.spans(after)[0].tolist()}
            common = [start + b for b in sure.tolist() if start + b in their and start + b >= right]
            if not common:
                return
            right = min(common)


def test_whole_text_in_one_very_long_pretoken(spark, plain):
    texts = ["é" * 3000, "word " + "x" * 2500 + " end " * 400]
    got = {r.doc_id: r.ids for r in bpe.encode(docs(spark, list(enumerate(texts))), *FILES, chunk=32, overlap=8).collect()}
    assert [got[0], got[1]] == [plain.encode_ordinary(t) for t in texts]


def test_nulls_repeats_clashes_and_empty_tables(spark, plain):
    rows = [(None, "one two"), (7, None), (7, "same"), (7, "same"), (8, ""), (None, "x y " * 40)]
    more = clashing(docs(spark, rows)).selectExpr("*", "1 AS row", "2 AS k", "3 AS ids", "4 AS own", "5 AS text2")
    for chunk in (16, 1000):
        got = bpe.decode(bpe.encode(more, *FILES, chunk=chunk, overlap=8), *FILES)
        want = [(i, plain.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows]
        assert sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in got.collect()), key=str) == sorted(want, key=str)
    empty = bpe.decode(bpe.encode(docs(spark, []), *FILES), *FILES)
    assert empty.columns == ["doc_id", "ids", "decoded"] and empty.count() == 0


def test_decoding_odd_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [0, None, -1, 10**9])], "doc_id long, ids array<int>")
    got = {r.doc_id: bytes(r.decoded) for r in bpe.decode(rows, *FILES).collect()}
    assert got == {1: b"", 2: b"", 3: bpe.vocabulary(*FILES).bytes[0]}
