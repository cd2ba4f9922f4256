"""Each stage of the corpus pipeline against a plain version, on what the stage before has kept."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from llm.tables import clashing, docs
from llm.test_mixing import judge
from llm.test_packing import check
from txnguard.llm import langid, mixing, pii, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def kept(spark, sf_dir, tmp_path_factory):
    out = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, out[-1], sf_dir).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "PII", "mixing", "packing"]


def test_all_but_the_last_return_documents(kept):
    assert all(df.columns == COLUMNS for df in kept[:-1])


def test_language(kept):
    """The model decides on every row: it rejects texts without a letter, and where it is certain its language counts."""
    before, after = rows(kept[0]), rows(kept[1])
    assert set(after) == {i for i, r in before.items() if any(c.isalpha() for c in r.text or "")}
    model = langid.train(kept[0])
    order = sorted(after)
    best, score = langid.scores(model, [before[i].text for i in order])
    for i, b, p in zip(order, best, score, strict=True):
        lang = model.languages[b] if p >= langid.CERTAIN or before[i].lang is None else before[i].lang
        assert after[i].asDict() == before[i].asDict() | {"lang": lang}


def test_a_wrong_language_is_corrected(spark, sf_dir):
    """Rows whose language was changed on purpose get their own one back; rows without one get one."""
    known = spark.read.parquet(f"{sf_dir}/documents.parquet")
    long = known.filter("n_chars > 400 and lang is not null").orderBy("doc_id").limit(12).collect()
    wrong = {r.doc_id: (None if k % 2 else "de" if r.lang != "de" else "fr") for k, r in enumerate(long)}
    table = spark.createDataFrame([r.asDict() | {"lang": wrong.get(r.doc_id, r.lang)} for r in known.collect()], known.schema)
    got = {r.doc_id: r.lang for r in langid.with_language(table).collect() if r.doc_id in wrong}
    assert got == {r.doc_id: r.lang for r in long}


def test_personal_data_is_gone(kept):
    before, after = rows(kept[2]), rows(kept[3])
    assert set(before) == set(after)
    for i, r in before.items():
        _, (spans,) = pii.spans_of([r.text])
        assert after[i].text == pii.masked(r.text, spans) and after[i].n_chars == len(after[i].text)
        assert not pii.spans_of([after[i].text])[0][0]


def test_mixture(kept):
    before, times = rows(kept[3]), defaultdict(int)
    for r in kept[4].collect():
        assert r == before[r.doc_id]
        times[r.doc_id] += 1
    taken = [type("Row", (), {"doc_id": i}) for i in before]
    sizes, target, _ = judge([], {i: r.source for i, r in before.items()}, {i: r.text for i, r in before.items()})
    words = defaultdict(int)
    for i, r in before.items():
        words[r.source] += len(r.text.split()) * times[i]
    assert len(taken) == len(before) and max(times.values()) <= 2
    assert all(abs(words[s] - t) <= max(sizes.values()) * 0.2 + 3000 for s, t in target.items())


def test_packing(kept):
    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    once = kept[4].dropDuplicates(["doc_id"])
    _, sf = corpus_pipeline.STAGES[-1]
    check(sf(once.sparkSession, once, "").collect(), {r.doc_id: r.text for r in once.collect()}, known)
    assert kept[5].filter("start = 0").count() == kept[4].count()


def test_run(spark, sf_dir, kept):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == kept[5].columns and got.count() == kept[5].count()


def test_empty_and_odd_tables(spark):
    for table in ([], [(None, None), (1, None), (2, ""), (3, "a@b.co"), (3, "a@b.co")]):
        df = docs(spark, table)
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, "")
        df.collect()


def five_word_groups(texts):
    """The first text of each one's group, by comparing the five-word shingles of every two."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(sets)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            i, j = sorted((find(i), find(j)))
            root[j] = i
    return [find(k) for k in range(len(sets))]


def test_no_two_near_copies_stay(kept):
    before, after = rows(kept[1]), rows(kept[2])
    order = sorted(before)
    assert set(after) == {order[k] for k in five_word_groups([before[i].text for i in order])}
    assert all(after[i] == before[i] for i in after)


def test_candidates_come_from_simhash():
    """Each bit of the long fingerprint is the majority of its hashes; similar sets agree in some table's sampled bits."""
    rng = np.random.default_rng(4)
    own = rng.integers(0, 2**64, 101, np.uint64)
    code = simhash.long_fingerprint(own)
    for part in (0, 5):
        hashed = simhash.spread(own * simhash.FACTORS[part] + simhash.TERMS[part])
        assert all(int(code[part]) >> b & 1 == (2 * int((hashed >> np.uint64(b) & np.uint64(1)).sum()) > 101) for b in range(64))
    met = 0
    for n in (20, 100, 400) * 40:
        base = rng.integers(0, 2**64, n, np.uint64)
        copy = np.concatenate((base[n // 10 :], rng.integers(0, 2**64, n // 10, np.uint64)))  # similar at 0.82
        codes = np.array([simhash.long_fingerprint(base), simhash.long_fingerprint(copy)])
        a, b = simhash.sampled_bits(codes)
        met += bool((a == b).any()) and int(np.bitwise_count(codes[0, : simhash.COMPARED] ^ codes[1, : simhash.COMPARED]).sum()) <= simhash.WIDE
        assert len(set(a.tolist())) == simhash.TABLES
    assert met >= 119
    a, b = simhash.sampled_bits(np.array([simhash.long_fingerprint(rng.integers(0, 2**64, 100, np.uint64)) for _ in range(2)]))
    assert (a == b).sum() <= 2


@pytest.mark.parametrize("limits", [{}, {"largest": 3, "block": 500}, {"largest": 1, "block": 200}])
def test_near_copies_at_the_limit(spark, limits):
    """Similarity just above and below 0.8, chains of copies, and a passage that all texts have; with bands and sets of
    candidates in one task, and split over many."""
    rng = random.Random(3)
    line = [f"c{i}" for i in range(40)]
    texts = []
    for n in (8, 45, 90, 300):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        texts.append(base)
        for changed in range(1, n // 40 + 2):
            for _ in range(6):
                copy = list(texts[-1] if changed % 2 else base)
                for at in rng.sample(range(n), changed):
                    copy[at] = f"x{rng.randrange(10**6)}"
                texts.append(copy)
    texts += [line + [f"z{rng.randrange(10**6)}" for _ in range(rng.choice((3, 8, 12, 200)))] for _ in range(60)]
    texts = [" ".join(t) for t in texts]
    got = simhash.survivors(docs(spark, list(enumerate(texts))).repartition(3), **limits)
    assert {r.doc_id for r in got.collect()} == set(five_word_groups(texts))


def test_one_band_of_20000_templated_texts(spark):
    """Pages of one template, similar at 0.58, share a band and are all candidates of each other: they meet block by block.
    Some have near copies, and those go."""
    rng = random.Random(11)
    line = " ".join(f"t{i}" for i in range(100))
    texts = [line + "".join(f" u{rng.randrange(10**9)}" for _ in range(30)) for _ in range(20_000)]
    copies = [texts[i * 97].replace("t50 ", "changed ") for i in range(200)]
    got = simhash.survivors(docs(spark, list(enumerate(texts + copies))).repartition(8), largest=2048, block=1 << 20)
    assert {r.doc_id for r in got.select("doc_id").collect()} == set(range(20_000))


def test_groups_of_a_crowded_band_keep_to_the_limits(spark):
    """The links that every two blocks give join the parts of a group that is dealt over many blocks."""
    rng, block = random.Random(2), 400
    base = [f"b{i}" for i in range(60)]
    texts = [" ".join(w if rng.random() > 0.01 else f"x{rng.randrange(10**6)}" for w in base) for _ in range(60)]
    found, rows = simhash.exact_groups, [simhash.shingle_set(t.encode()) for t in texts]
    assert (found(rows) == np.array(five_word_groups(texts))).all()
    wanted = spark.createDataFrame([(1, i, len(s), i, 0) for i, s in enumerate(rows)], "near long, node long, size long, k1 long, k2 long")
    given = spark.createDataFrame([(i, 0, i, t) for i, t in enumerate(texts)], "k1 long, k2 long, doc_id long, text string")
    label = {r.node: r.label for r in simhash.labelled(wanted, given, block).collect()}
    assert [label.get(i, i) for i in range(60)] == five_word_groups(texts)


def test_links_of_a_large_group_do_not_add_up_over_tables(spark, monkeypatch):
    """300 near copies meet in most of the tables; what the first tables have linked gives no links in the others."""
    rng, given, components = random.Random(8), [], simhash.components
    base = [f"b{i}" for i in range(150)]
    texts = [" ".join(w if rng.random() > 0.02 else f"x{rng.randrange(10**6)}" for w in base) for _ in range(300)]

    def counted(edges):
        given.append(edges.distinct().count())
        return components(edges)

    monkeypatch.setattr(simhash, "components", counted)
    got = simhash.survivors(docs(spark, list(enumerate(texts))).repartition(4))
    assert {r.doc_id for r in got.select("doc_id").collect()} == set(five_word_groups(texts))
    assert sum(given) < 20 * len(texts), given


def test_near_copies_that_share_no_tables_bits(spark):
    """Texts of 8 and 9 words have 4 and 5 shingles, similarity 0.8. Some pairs agree in no table's bits; they are one all the same."""
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(8)) for _ in range(300)]
    texts += [f"{t} end{k}" for k, t in enumerate(texts)]
    bits = simhash.sampled_bits(np.array([simhash.long_fingerprint(simhash.shingle_set(t.encode())) for t in texts]))
    assert 0 < (~(bits[:300] == bits[300:]).any(axis=1)).sum() < 40
    got = simhash.survivors(docs(spark, list(enumerate(texts))).repartition(3))
    assert {r.doc_id for r in got.select("doc_id").collect()} == set(range(300))


@pytest.mark.parametrize("rows", [10_000, 7])
def test_the_search_without_tables_loses_no_link(spark, rows):
    """Where no table has gathered anything, all groups come from the rarest common shingles: similarities about 0.8, chains,
    a passage in nearly all texts, repeated rows; with runs of a hash in one Arrow batch, and over many."""
    rng, texts = random.Random(9), []
    line = [f"c{i}" for i in range(30)]
    for n in (8, 9, 14, 24, 45, 90, 200):
        for begin in ([], line):
            base = begin + [f"w{rng.randrange(10**6)}" for _ in range(n)]
            texts.append(base)
            for _ in range(12):
                copy = list(rng.choice((base, texts[-1])))
                for at in rng.sample(range(len(copy)), rng.randrange(len(copy) // 30 + 2)):
                    copy[at] = f"x{rng.randrange(10**6)}"
                texts.append(copy[: len(copy) - rng.randrange(n // 8 + 1)])
    texts = [" ".join(t) for t in texts] + [None, "", "one two three"]
    own = {}  # equal sets are one
    for i, t in enumerate(texts):
        own.setdefault(simhash.node_of(s := simhash.shingle_set((t or "").encode())), (i, len(s)))
    signed = {i: int(np.uint64(n).view(np.int64)) for n, (i, _) in own.items()}
    folded = [(signed[i], size, (i, 0)) for i, size in own.values()]
    folded = spark.createDataFrame(folded, "node long, size long, first struct<k1 long, k2 long>")
    near = spark.createDataFrame([], "node long, near long")
    given = spark.createDataFrame([(i, 0, i, t) for i, t in enumerate(texts)] * 2, "k1 long, k2 long, doc_id long, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        label = {r.node: r.label for r in simhash.missed(folded, near, given, 2000).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    order = sorted(signed)
    found, want = {}, {}
    for i, first in zip(order, five_word_groups([texts[i] for i in order]), strict=True):
        found.setdefault(label.get(signed[i], signed[i]), []).append(i)
        want.setdefault(first, []).append(i)
    assert sorted(found.values()) == sorted(want.values()) and max(map(len, found.values())) > 3


def test_columns_of_the_input_stay(spark):
    """Names that stages use inside are returned as they came."""
    rows = [(1, "one two three four five six seven", "en", "web"), (2, "one two three four five six seven", "en", "web"), (3, None, None, None)]
    df = clashing(docs(spark, rows))
    first = df.first()
    for stage in (simhash.survivors, langid.with_language, pii.mask, mixing.mixed_documents):
        got = stage(df)
        assert got.columns == df.columns
        assert all(r[c] == first[c] for r in got.collect() for c in df.columns if c not in COLUMNS)
