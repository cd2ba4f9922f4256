"""Personal data: fixed patterns, and a conditional random field for what they miss."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from txnguard.llm import pii_crf
from txnguard.llm.columns import only, with_columns_of
from txnguard.llm.pii_patterns import KINDS, Span, base_spans, listed

ENDS = ".,;:!?\"'#$%&*|<>=~`^"


def learned_spans(texts: list[str], base: list[list[Span]], crf: pii_crf.Crf | None = None) -> list[list[Span]]:
    """Spans of the field's labels, without signs at their ends; what overlaps a pattern's span is left to the pattern."""
    crf, where, words, found = crf or pii_crf.trained(), [], [], []
    for i, text in enumerate(texts):
        for spans, features in pii_crf.chains(text):
            where.append(i)
            words.append(spans)
            found.append(features)
    out: list[list[Span]] = [[] for _ in texts]
    for i, spans, labels in zip(where, words, pii_crf.decode(crf, found), strict=True):
        for k in np.flatnonzero(labels % 2 == 1):  # the first words of spans
            last = k
            while last + 1 < len(labels) and labels[last + 1] == labels[k] + 1:
                last += 1
            start, end = spans[k][0], spans[last][1]
            while start < end and texts[i][start] in ENDS:
                start += 1
            while end > start and texts[i][end - 1] in ENDS:
                end -= 1
            if start < end and not any(s < end and start < e for _, s, e in base[i]):
                out[i].append((KINDS[(labels[k] - 1) // 2], start, end))
    return out


def spans_of(texts: list[str], crf: pii_crf.Crf | None = None) -> tuple[list[list[Span]], list[list[Span]]]:
    """The patterns' spans and all spans of each text, by start and then kind."""
    base = [base_spans(t) for t in texts]
    more = learned_spans(texts, base, crf)
    every = [sorted(b + m, key=lambda s: (s[1], KINDS.index(s[0]))) if m else b for b, m in zip(base, more, strict=True)]
    return base, every


def find(docs: DataFrame) -> DataFrame:
    """``doc_id``, the number of the patterns' spans of each kind (``n_email`` ..), ``base_sha256`` of their list, and
    ``spans``: the list of all spans as ``kind:start:end`` in code points, end exclusive.

    Null and empty texts have no spans. Repeated rows get equal results; a null doc_id stays null. Other columns are not
    read, so their names can't clash. Long texts and long words are read whole and cost time in proportion to their length.
    The field is trained once, on the driver, from its small table, and broadcast.
    """
    crf = docs.sparkSession.sparkContext.broadcast(pii_crf.trained())  # weights of a fixed table

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        base, every = spans_of([t or "" for t in batch.column("text").to_pylist()], crf.value)
        counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in KINDS]
        digest = pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b in base], pa.string())
        names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, digest, pa.array(map(listed, every), pa.string())], names)

    kinds = ", ".join(f"n_{k} long" for k in KINDS)
    return with_columns_of(f"doc_id long, {kinds}, base_sha256 string, spans string", of, only(docs, "doc_id", "text"))


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with each span replaced by its kind in square brackets; of spans that overlap, the whole stretch is
    replaced once, by the first one's kind. ``n_chars`` follows the text where the table has it; all other columns and
    null texts stay."""
    schema, at = docs.schema, docs.columns.index("text")
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    crf = docs.sparkSession.sparkContext.broadcast(pii_crf.trained())  # weights of a fixed table

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column(at).to_pylist()
        _, every = spans_of([t or "" for t in texts], crf.value)
        new = [t if not s else masked(t, s) for t, s in zip(texts, every, strict=True)]
        columns = list(batch.columns)
        columns[at] = pa.array(new, pa.string())
        if counted is not None:
            changed = [len(n) if s else old for n, s, old in zip(new, every, columns[counted].to_pylist(), strict=True)]
            columns[counted] = pa.array(changed, columns[counted].type)
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return with_columns_of(schema, of, docs)


def masked(text: str, spans: list[Span]) -> str:
    out, done = [], 0
    for kind, start, end in spans:
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])
