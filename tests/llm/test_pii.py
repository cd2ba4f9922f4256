import hashlib
import random
import re
import time

import numpy as np
import pytest

from llm.tables import clashing, docs
from txnguard.llm import pii, pii_crf, pii_patterns
from txnguard.llm.catalog import catalog

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    """The patterns as they are written, one by one."""
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 12 <= len(digits) <= 19 and sum(int(d) if k % 2 == 0 else sum(map(int, str(2 * int(d)))) for k, d in enumerate(digits[::-1])) % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(PLAIN).index(s[0])))


def test_query_equals_the_patterns(spark, sf_dir):
    got = {r.doc_id: r for r in catalog()["op6_pii"][0](spark, sf_dir).collect()}
    source = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(source)
    for r in source:
        base = brute(r.text or "")
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert [got[r.doc_id][f"n_{k}"] for k in PLAIN] == [sum(s[0] == k for s in base) for k in PLAIN]
        assert got[r.doc_id].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(got[r.doc_id].spans.split(","))


@pytest.mark.parametrize("seed", range(6))
def test_patterns_on_random_signs(seed):
    rng = random.Random(seed)
    for _ in range(3000):
        text = "".join(rng.choice("0123456789..@@--++  ()aZé_%") for _ in range(rng.randrange(60)))
        assert pii_patterns.base_spans(text) == brute(text), text


def test_luhn_and_bounds():
    text = "4111 1111 1111 1111, 4111-1111-1111-1112, 255.255.255.255 256.1.1.1 1.2.3.4.5.6.7.8 007.0.0.01 +49 (30) 123-456 +12 34"
    assert pii_patterns.base_spans(text) == brute(text)


def test_long_words_take_little_time():
    start = time.perf_counter()
    pii.spans_of(["a" * 300_000 + " b@c", "1" * 300_000, "@" * 300_000, "+1" + "(" * 300_000, "1." * 100_000, "a@" * 100_000])
    assert time.perf_counter() - start < 20


def test_learned_kinds():
    texts = [
        "You can reach her on (555) 301-4477 today.", "please write to mary (at) posthaus (dot) org soon", "the card 4929.1234.5678.9012 was used",
        "tel 555 321 9876 is mine", "host 2001:db8:0:2:1:4:1:9 is up",
    ]
    kinds = [[(k, t[s:e]) for k, s, e in spans] for t, spans in zip(texts, pii.spans_of(texts)[1], strict=True)]
    assert kinds == [
        [("phone", "(555) 301-4477")], [("email", "mary (at) posthaus (dot) org")], [("card", "4929.1234.5678.9012")],
        [("phone", "555 321 9876")], [("ip", "2001:db8:0:2:1:4:1:9")],
    ]


def test_clean_texts_stay():
    texts = [
        "In 1987 there were 34 of them.", "Version 2.4.1 came on 2021-03-04 at 10:45.", 'token = "71dec6ffe3aa" x', "It cost $19.99, or 1,000,000 in all.",
        "2123465659789240 is an order", "meet me at the dot", "chapter 12, pages 5-9", "", "no digits at all",
    ]
    assert all(not s for s in pii.spans_of(texts)[1])


def test_field_fits_its_table():
    crf, rows = pii_crf.trained(), pii_crf.labelled()
    right = total = 0
    for words, labels in rows:
        text = " ".join(words)
        for (spans, features), in zip(pii_crf.chains(text)):
            at = [len(text[:s].split()) for s, _ in spans]
            got = pii_crf.decode(crf, [features])[0]
            right += sum(g == labels[k] for g, k in zip(got, at, strict=True))
            total += len(at)
    assert right / total > 0.97


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(2)
    crf = pii_crf.trained()
    emit = rng.normal(size=(5, 3, len(pii_crf.LABELS))) * 4
    got = pii_crf.viterbi(emit, crf.pairs)
    for e, path in zip(emit, got, strict=True):
        def score(p, e=e):
            chain = [0, *p, 0]
            return sum(crf.pairs[a, b] for a, b in zip(chain, chain[1:], strict=False)) + sum(e[k, y] for k, y in enumerate(p))
        best = max(score((a, b, c)) for a in range(9) for b in range(9) for c in range(9))
        assert score(tuple(path)) == pytest.approx(best)


def test_marginals_by_all_paths():
    rng = np.random.default_rng(3)
    emit, pair = rng.normal(size=(1, 2, 9)), rng.normal(size=(9, 9))
    p, joint = pii_crf.marginals(emit, pair)
    weight = np.exp(pair[0][:, None] + emit[0, 0][:, None] + pair + emit[0, 1][None] + pair[:, 0][None])
    weight /= weight.sum()
    assert np.allclose(p[0, 0], weight.sum(1)) and np.allclose(p[0, 1], weight.sum(0))
    expected = weight.copy()
    expected[0] += weight.sum(1)
    expected[:, 0] += weight.sum(0)
    assert np.allclose(joint, expected)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a@b.co"), (3, "x " * 200_000 + "a@b.co"), (3, "é a@b.co"), (3, "é a@b.co")]
    got = pii.find(clashing(docs(spark, rows))).collect()
    assert [(r.doc_id, r.n_email, r.spans) for r in got] == [
        (1, 0, ""), (2, 0, ""), (None, 1, "email:0:6"), (3, 1, "email:400000:400006"), (3, 1, "email:2:8"), (3, 1, "email:2:8"),
    ]
    assert pii.find(docs(spark, [])).count() == 0


def test_mask(spark):
    rows = [(1, "write a@b.co now"), (2, None), (3, "clean")]
    df = clashing(docs(spark, rows))
    got = pii.mask(df)
    assert got.columns == df.columns
    assert [(r.doc_id, r.text, r.n_chars) for r in got.collect()] == [(1, "write [EMAIL] now", 17), (2, None, None), (3, "clean", 5)]
    assert pii.masked("+1 234 567 8901 2", [("phone", 0, 15), ("card", 3, 17)]) == "[PHONE]"


@pytest.mark.parametrize(
    "address",
    ["jane [AT] mail [DOT] org", "jane (At) mail (Dot) org", "jane at mail dot org", "JANE AT MAIL DOT ORG", "jane dot doe at mail dot org",
     "x" * 10 + "(at)firm(dot)com", "x" * 70 + "(at)firm(dot)com", "x" * 5000 + "(AT)firm(DOT)com"],
)
def test_spelled_out_addresses_are_found_and_masked(spark, address):
    """In any case, spelled out, and however long a word is."""
    text = f"please write to {address} soon"
    _, ((span,),) = pii.spans_of([text])
    assert span == ("email", 16, 16 + len(address))
    got = pii.mask(docs(spark, [(1, text)])).first()
    assert got.text == "please write to [EMAIL] soon"


@pytest.mark.parametrize("text", ["look at the dot on the wall", "we met at noon dot or not", "at last the dot was gone", "he stood at the door and the dot moved at once"])
def test_ordinary_at_and_dot(text):
    assert pii.spans_of([text]) == ([[]], [[]])


def test_the_field_is_trained_once_and_broadcast(spark, monkeypatch):
    """Workers get the weights with the task: whatever the driver has trained is what they use."""
    empty = pii_crf.Crf({}, np.zeros((0, len(pii_crf.LABELS))), pii_crf.forbidden())
    monkeypatch.setattr(pii_crf, "trained", lambda: empty)
    df = docs(spark, [(1, "call 555-123-4567 now"), (2, "a@b.co")])
    assert {r.doc_id: r.spans for r in pii.find(df).collect()}[2] == "email:0:6"
