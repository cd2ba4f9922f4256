"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnguard.llm.columns import code_points, only

BUCKETS = 1 << 16
SIZES = (1, 2, 3)
SMOOTHING = 0.5
UNKNOWN = "und"
#: A language is a row of the broadcast matrix (512 KB each); more are refused.
MAX_LANGUAGES = 256
CHARS_PER_CHUNK = 1 << 19
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


@dataclass(frozen=True)
class Model:
    """``log_prob[language, bucket]`` and the logarithms of the languages' shares."""

    languages: list[str]
    prior: np.ndarray
    log_prob: np.ndarray


@cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    flags = np.zeros(0x110000, bool)
    flags[[c for c in range(0x110000) if chr(c).isalpha()]] = True
    return flags


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of rows with a limited number of characters together; a longer text is a run of its own."""
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > CHARS_PER_CHUNK:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the texts' n-grams, size after size and text after text, and their numbers by size and text.

    Texts are lower-cased; whatever is no letter counts as a space, and one stands before and after each text. An
    n-gram begins or ends with a letter, so runs of spaces, digits and signs add nothing.
    """
    lowered = [f" {t.lower()} " for t in texts]
    ends = np.cumsum([len(t) for t in lowered])
    points = code_points("".join(lowered))
    letter = letters()[points]
    points = np.where(letter, points, 32).astype(np.uint32)
    found, numbers, h = [], [], np.full(len(points), 0x27D4EB2F, np.uint32)
    for k, n in enumerate(SIZES):
        last = len(points) - n + 1
        if n > 1:
            h = h[:last]
        h = (h ^ points[n - 1 :]) * MULTIPLIERS[k]
        h ^= h >> np.uint32(15)
        whole = letter[:last] | letter[n - 1 :]
        for back in range(2, n + 1):  # not across the end of a text
            across = ends[:-1] - back + 1
            whole[across[across < last]] = False
        at = np.flatnonzero(whole)
        found.append((h[at] & np.uint32(BUCKETS - 1)).astype(np.int32))
        numbers.append(np.diff(np.searchsorted(at, ends), prepend=0))
    return np.concatenate(found), np.array(numbers)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model of all rows with a language; counts of n-grams and documents are summed over the whole table.

    Null languages teach nothing, null texts have no n-grams. The model has a fixed size per language, whatever the
    number of rows. Without any labelled row it knows no language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            names = sorted(set(langs))
            code = np.array([names.index(x) for x in langs], np.int16)
            for start, end in chunks(texts):
                bucket, numbers = ngrams(texts[start:end])
                own = np.repeat(np.tile(code[start:end], len(SIZES)), numbers.ravel())
                for k in np.unique(code[start:end]):
                    part = np.bincount(bucket[own == k], minlength=BUCKETS)
                    sums[names[k]] = sums[names[k]] + part if names[k] in sums else part
            for name in langs:
                docs[name] = docs.get(name, 0) + 1
        for name, n in docs.items():
            used = np.flatnonzero(sums[name])
            arrays = [pa.array([name] * (len(used) + 1)), pa.array(np.append(used, -1)), pa.array(np.append(sums[name][used], n))]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "bucket", "n"])

    rows = only(labelled, text, lang).toDF("text", "lang").filter("lang is not null")
    counts = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.groupBy("lang").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n"))
    languages, docs, table = [], [], []
    for r in found.orderBy("lang").limit(MAX_LANGUAGES + 1).toLocalIterator():
        bucket, n = np.array(r.bucket), np.array(r.n, float)
        dense = np.zeros(BUCKETS)
        dense[bucket[bucket >= 0]] = n[bucket >= 0]
        languages.append(r.lang)
        docs.append(n[bucket < 0].sum())
        table.append(np.log((dense + SMOOTHING) / (dense.sum() + SMOOTHING * BUCKETS)))
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not languages:
        return Model([], np.zeros(0), np.zeros((0, BUCKETS)))
    return Model(languages, np.log(np.array(docs) / sum(docs)), np.array(table))


def scores(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest language of each text and its probability: the sum of the matrix entries of its n-grams."""
    if not model.languages:
        return np.zeros(len(texts), int), np.zeros(len(texts))
    total = np.tile(model.prior, (len(texts), 1))
    for start, end in chunks(texts):
        bucket, numbers = ngrams(texts[start:end])
        used = np.flatnonzero(numbers.ravel())
        if len(used):
            first = np.concatenate(([0], np.cumsum(numbers.ravel())[:-1]))[used]
            for k, column in enumerate(model.log_prob):
                np.add.at(total[:, k], start + used % (end - start), np.add.reduceat(column[bucket], first))
    best = total.argmax(axis=1)
    top = total[np.arange(len(texts)), best]
    return best, 1 / np.exp(total - top[:, None]).sum(axis=1)


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``lang_pred`` and ``score`` for each row of ``docs``; only the text decides.

    ``und`` with score 0 if the text is null, empty or has no letter, or if the model knows no language. Texts are read whole, whatever their length.
    Repeated rows get equal results; equal probabilities go to the first language in order. No rows give none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = only(docs, *keep, "text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or "" for t in part.column("text").to_pylist()]
                best, score = scores(own, texts)
                known = [bool(own.languages) and has_letter(t) for t in texts]
                pred = [own.languages[b] if ok else UNKNOWN for b, ok in zip(best, known, strict=True)]
                score = np.where(known, score, 0.0)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(pred, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(of, f"{kinds}, lang_pred string, score double")


#: Probability from which the model's language counts more than the one that a row came with.
CERTAIN = 0.999


def with_language(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text has a language by the model's decision on it; those that it calls ``und`` are rejected.

    The model learns from all rows that have a language, and decides on every row from its text alone. Its language takes
    the place of a null ``lang``, and of another one where it is CERTAIN; else the row's own stays. If no row has a
    language, the model knows none and every text with a letter stays as it is.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                part = part.filter(pa.array([has_letter(t or "") for t in part.column(text).to_pylist()], pa.bool_()))
                if own.languages and part.num_rows:
                    best, score = scores(own, part.column(text).to_pylist())
                    given = part.column(lang).to_pylist()
                    now = [own.languages[b] if g is None or p >= CERTAIN else g for g, b, p in zip(given, best, score, strict=True)]
                    part = part.set_column(lang, part.schema.field(lang), pa.array(now, pa.string()))
                yield part

    return docs.mapInArrow(of, docs.schema)
