import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from llm.tables import clashing, docs
from txnguard.llm import langid
from txnguard.llm.catalog import catalog
from txnguard.llm.q_langid import held_out

ROWS = [
    (1, "the cat and the dog were here", "en", "s"), (2, "when will this be thrown away", "en", "s"), (3, "der Hund und die Katze waren hier", "de", "s"),
    (4, "wann wird das denn weggeworfen", "de", "s"), (5, "le chien était là où elle était", "fr", "s"), (6, None, "fr", "s"), (7, "nobody said which", None, "s"),
]


def test_query_on_held_out_rows(spark, sf_dir):
    got = catalog()["op4_language_id"][0](spark, sf_dir)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got.count() == source.count()
    assert got.filter("score < 0 or score > 1 or score is null").count() == 0
    judged = got.filter("held_out").join(source, "doc_id").filter("lang is not null")
    assert judged.count() > 20
    assert judged.filter("lang = lang_pred").count() / judged.count() >= 0.97
    assert got.filter((F.crc32(F.col("doc_id").cast("string")) % 4 == 2) != F.col("held_out")).count() == 0


def brute(train, text):
    """Counting n-grams one by one."""

    def grams(t):
        t = "".join(c if c.isalpha() else " " for c in f" {t.lower()} ")
        out = Counter()
        for n in (1, 2, 3):
            for g in (t[i : i + n] for i in range(len(t) - n + 1)):
                if g[0] != " " or g[-1] != " ":
                    out[g] += 1
        return out

    langs = sorted({r[2] for r in train if r[2]})
    counts = {lang: Counter() for lang in langs}
    for r in train:
        if r[2]:
            counts[r[2]] += grams(r[1] or "")
    out = []
    for lang in langs:
        total = sum(counts[lang].values()) + langid.SMOOTHING * langid.BUCKETS
        prior = math.log(sum(r[2] == lang for r in train) / sum(r[2] is not None for r in train))
        out.append(prior + sum(n * math.log((counts[lang][g] + langid.SMOOTHING) / total) for g, n in grams(text).items()))
    top = max(out)
    return langs[out.index(top)], 1 / sum(math.exp(x - top) for x in out)


def test_equals_counting_by_hand(spark):
    """So few n-grams share no bucket that matters here."""
    model = langid.train(docs(spark, ROWS))
    texts = [(20, "the dog will be here"), (21, "die Katze wird weggeworfen"), (22, "où est le chien"), (23, "x")]
    got = {r.doc_id: r for r in langid.predict(docs(spark, texts), model).collect()}
    for i, t in texts:
        lang, score = brute(ROWS, t)
        assert got[i].lang_pred == lang
        assert got[i].score == pytest.approx(score, rel=1e-3)


def test_odd_texts(spark):
    model = langid.train(clashing(docs(spark, ROWS)))
    texts = [(1, None), (2, ""), (3, "123 !?"), (None, "the the the"), (5, "und " * 300_000), (5, "und " * 300_000), (6, "\U0001F600 \ud800".encode("utf-16", "ignore").decode("utf-16"))]
    got = langid.predict(clashing(docs(spark, texts)), model).collect()
    assert [(r.doc_id, r.lang_pred) for r in got] == [(1, "und"), (2, "und"), (3, "und"), (None, "en"), (5, "de"), (5, "de"), (6, "und")]
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.predict(docs(spark, []), model).count() == 0


def test_no_language_to_learn(spark):
    unlabelled = docs(spark, [(1, "text"), (2, "12")])
    model = langid.train(unlabelled)
    assert [tuple(r) for r in langid.predict(unlabelled, model).collect()] == [(1, "und", 0.0), (2, "und", 0.0)]
    assert [r.doc_id for r in langid.with_language(unlabelled).collect()] == [1]


def test_rejected_rows_and_filled_languages(spark):
    df = clashing(docs(spark, [*ROWS, (8, "12 !", "en", "s"), (9, "", "de", "s"), (10, "der Hund war hier", None, "s")]))
    got = langid.with_language(df)
    assert got.columns == df.columns
    assert {r.doc_id: r.lang for r in got.collect()} == {1: "en", 2: "en", 3: "de", 4: "de", 5: "fr", 7: "en", 10: "de"}
    assert langid.with_language(docs(spark, [])).count() == 0


def test_language_of_a_row_is_no_input(spark):
    a = docs(spark, [(1, "the dog", "de", "x")])
    model = langid.train(docs(spark, ROWS))
    assert langid.predict(a, model).first().lang_pred == "en"


def test_null_id_is_not_held_out(spark):
    assert docs(spark, [(None, "a")]).select(held_out(F.col("doc_id"))).first()[0] is False


def test_long_text_equals_its_parts():
    """A text over the chunk size has the n-grams of its whole length."""
    whole = "ab cd " * 200_000
    bucket, numbers = langid.ngrams([whole])
    assert len(bucket) == numbers.sum()
    assert list(langid.chunks([whole, "x", "y"])) == [(0, 1), (1, 3)]
    assert len(bucket) == 400_000 * (2 + 3 + 3)  # of each word of two letters
