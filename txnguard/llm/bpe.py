"""Byte-level BPE of whole texts: overlapping chunks are pre-tokenised in parallel and stitched where they agree."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnguard.workdir import materialize

#: Characters that a chunk owns, and further ones that it sees of the next chunk.
CHUNK = 1 << 16
OVERLAP = 1 << 10
#: Texts whose chunks do not agree anywhere in an overlap go again, with chunks and overlaps this many times as long.
GROW = 8
#: A match that ends at least so many characters before its chunk does is the same in the whole text.
LOOK = 4
#: Pieces kept with their ids in a worker, and the longest of them.
KEPT, KEPT_CHARS = 1 << 17, 32
ROWS_AT_ONCE = 256


class Vocabulary:
    """The ranks of a byte-level vocabulary and the pattern that cuts a text into pre-tokens."""

    def __init__(self, ranks: str, pattern: str) -> None:
        with open(ranks, "rb") as lines:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.merge = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=known, special_tokens={})._encode_single_piece
        self.pattern = regex.compile(pattern)
        self.bytes = [b""] * (max(known.values()) + 1)
        for token, rank in known.items():
            self.bytes[rank] = token
        self.kept: dict[str, list[int]] = {}

    def ids(self, pieces: list[str]) -> np.ndarray:
        """The ids of pre-tokens, each merged by itself."""
        out, kept = [], self.kept
        for p in pieces:
            own = kept.get(p)
            if own is None:
                own = self.merge(p)
                if len(p) <= KEPT_CHARS:
                    if len(kept) >= KEPT:
                        kept.clear()
                    kept[p] = own
            out += own
        return np.array(out, np.int32)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pre-tokens."""
        found = np.array([m.span() for m in self.pattern.finditer(text)], np.int64).reshape(-1, 2)
        return found[:, 0], found[:, 1]


@cache
def vocabulary(ranks: str, pattern: str) -> Vocabulary:
    return Vocabulary(ranks, pattern)


def lists(found: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)])
    values = np.concatenate(found) if found else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def by_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def chunk_starts(length: int, chunk: int, overlap: int) -> range:
    """A last chunk that the one before sees whole is none."""
    return range(0, max(1, length - overlap), chunk)


def of_one_chunk(rows: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``own`` and ``ids`` of texts that are one chunk: there is nothing to stitch."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(ranks, pattern)
        for batch in by_rows(batches):
            ids = [known.ids(known.pattern.findall(t or "")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("own"), lists(ids, pa.int32())], ["own", "ids"])

    return rows.mapInArrow(of, f"own {rows.schema['own'].dataType.simpleString()}, ids array<int>")


def cut(rows: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """``(row, k, last, text)``: the overlapping chunks of ``rows(row, text)``."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                starts = chunk_starts(len(text), chunk, overlap)
                for k, start in enumerate(starts):
                    own = [[row], [k], [k == len(starts) - 1], [text[start : start + chunk + overlap]]]
                    yield pa.RecordBatch.from_arrays([pa.array(own[0], pa.int64()), pa.array(own[1], pa.int32()), pa.array(own[2]), pa.array(own[3], pa.string())], ["row", "k", "last", "text"])

    return rows.select("row", "text").mapInArrow(of, "row long, k int, last boolean, text string")


def pretokenised(chunks: DataFrame, chunk: int, overlap: int, ranks: str, pattern: str) -> DataFrame:
    """Chunks with ``ends`` of their pre-tokens and the places where one begins that both neighbours see: ``head`` in the
    part shared with the chunk before, ``tail`` in the part shared with the next one, there counted from its start."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(ranks, pattern)
        for batch in by_rows(batches):
            ends, heads, tails = [], [], []
            for text, last in zip(batch.column("text").to_pylist(), batch.column("last").to_pylist(), strict=True):
                start, end = known.spans(text)
                sure = start if last else start[np.concatenate(([0], end[:-1])) <= len(text) - LOOK]
                ends.append(np.column_stack((start, end)).astype("<u4").tobytes())
                heads.append(sure[sure < overlap])
                tails.append(sure[sure >= chunk] - chunk)
            more = [pa.array(ends, pa.binary()), lists(heads, pa.int32()), lists(tails, pa.int32())]
            yield pa.RecordBatch.from_arrays([*map(batch.column, ("row", "k", "last", "text")), *more], ["row", "k", "last", "text", "spans", "head", "tail"])

    return chunks.mapInArrow(of, "row long, k int, last boolean, text string, spans binary, head array<int>, tail array<int>")


def of_chunks(stitched: DataFrame, chunk: int, ranks: str, pattern: str) -> DataFrame:
    """``(row, k, ids)`` of the pre-tokens from each chunk's joint with the one before to its joint with the next."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(ranks, pattern)
        for batch in by_rows(batches):
            found = []
            for text, spans, begin, until in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "begin", "until")), strict=True):
                start, end = np.frombuffer(spans, "<u4").reshape(-1, 2).astype(np.int64).T
                own = (start >= (begin or 0)) & (start < (len(text) if until is None else chunk + until))
                found.append(known.ids([text[a:b] for a, b in zip(start[own].tolist(), end[own].tolist(), strict=True)]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("k"), lists(found, pa.int32())], ["row", "k", "ids"])

    return stitched.select("row", "k", "text", "spans", "begin", "until").mapInArrow(of, "row long, k int, ids array<int>")


def encode(docs: DataFrame, ranks: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``keep`` and ``ids`` (array of int) for each row of ``docs``: the ids of its whole ``text``.

    Long texts are cut into chunks that overlap. Each is pre-tokenised in a task of its own, from wherever it begins.
    A pre-token depends only on what follows its start, so once both neighbours have one begin at the same place of their
    overlap, they agree from there on: that place is their joint. Between its two joints a chunk's pre-tokens are those
    of the text, and each is merged into ids by rank. Where some overlap has no such place (a pre-token covers it), the
    text goes again with longer chunks, until all agree or the text is one chunk; so results never depend on the sizes.

    The pattern may look at most LOOK characters beyond a match, besides the run of equal kind that it takes. A null or
    empty text has no ids. Null and repeated ids are rows like others; columns that are not kept are not read. A
    document's ids are one row, as its text is. An empty table gives no rows.
    """
    if overlap > chunk:
        raise ValueError("a chunk meets its direct neighbours only: the overlap can't be longer than a chunk")
    own = F.struct(*[F.col(f"`{c}`").alias(c) for c in keep]).alias("own")
    rows, size = docs.select(own, F.col("text")), F.coalesce(F.length("text"), F.lit(0))
    out = of_one_chunk(rows.filter(size <= chunk + overlap), ranks, pattern)
    left = rows.filter(size > chunk + overlap).withColumn("row", F.monotonically_increasing_id())
    left = materialize(left, "bpe-long")
    while not left.isEmpty():
        done, left = stitch(left, chunk, overlap, ranks, pattern)
        chunk, overlap = chunk * GROW, overlap * GROW
        out = out.union(done).union(of_one_chunk(left.filter(size <= chunk + overlap), ranks, pattern))
        left = left.filter(size > chunk + overlap)
    return out.select("own.*", "ids")


def stitch(rows: DataFrame, chunk: int, overlap: int, ranks: str, pattern: str) -> tuple[DataFrame, DataFrame]:
    """``own`` and ``ids`` of the rows whose chunks all agree with their neighbours, and the other rows."""
    chunks = cut(rows, chunk, overlap).repartition("row", "k")
    marked = materialize(pretokenised(chunks, chunk, overlap, ranks, pattern), "bpe-chunks")
    before = marked.select("row", (F.col("k") + 1).alias("k"), "tail")
    meet = F.array_min(F.array_intersect("head", "tail")).alias("begin")
    joints = materialize(marked.filter("k > 0").select("row", "k", "head").join(before, ["row", "k"]).select("row", "k", meet), "bpe-joints")
    apart = joints.filter("begin is null").select("row").distinct()
    after = joints.select("row", (F.col("k") - 1).alias("k"), F.col("begin").alias("until"))
    whole = marked.select("row", "k", "text", "spans").join(apart, "row", "left_anti")
    pieces = of_chunks(whole.join(joints, ["row", "k"], "left").join(after, ["row", "k"], "left"), chunk, ranks, pattern)
    ids = pieces.groupBy("row").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))
    return rows.join(ids, "row").select("own", "ids"), rows.join(apart, "row", "left_semi")


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``encoded`` with ``decoded``: the bytes of its ``ids``, one after the other. Null ids count as none; a number that
    the vocabulary does not have has no bytes."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(vocabulary(ranks, pattern).bytes, object)
        for batch in by_rows(batches):
            found = []
            for ids in batch.column("ids"):
                own = np.zeros(0, np.int32) if not ids.is_valid else ids.values.drop_null().to_numpy()
                found.append(b"".join(table[own[(own >= 0) & (own < len(table))]]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(of, f"{kinds}, decoded binary")
