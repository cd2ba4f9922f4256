"""Document fingerprints by winnowing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnguard.llm.columns import code_points, only, run_hashes, utf8, with_columns_of
from txnguard.workdir import materialize

#: Characters of a k-gram, and k-grams of a window. A passage of GRAM + WINDOW - 1 characters that two texts share has a
#: whole window in both, so both keep the same k-gram of it.
GRAM = 12
WINDOW = 27
LOW = np.uint64(0xFFFFFFFF)


def gram_hashes(points: np.ndarray, size: int) -> np.ndarray:
    """A 32-bit hash of each run of ``size`` code points."""
    return run_hashes(points, size) & LOW


def winnow(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The kept k-grams of a text: hashes and positions, by position. Of each window's k-grams the one with the smallest
    hash is kept, the rightmost of equal ones. A text shorter than a k-gram is one k-gram; fewer k-grams than a window
    has are one window; an empty text keeps none."""
    points = code_points(text)
    if not len(points):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    hashes = gram_hashes(points, min(GRAM, len(points)))
    n = len(hashes)
    least = (hashes << np.uint64(32)) | (LOW - np.arange(n, dtype=np.uint64))  # of equal hashes the rightmost is smallest
    window, span = min(WINDOW, n), 1
    while span * 2 <= window:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < window:
        least = np.minimum(least[: n - window + 1], least[window - span :])
    kept = least[np.concatenate(([True], least[1:] != least[:-1]))]
    return (kept >> np.uint64(32)).astype(np.uint32), (LOW - (kept & LOW)).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Common share of two sorted sets of hashes; 1 if both are empty."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``hashes`` and ``positions`` (in code points) of each row's kept k-grams; null texts count as empty."""

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [winnow(t or "") for t in batch.column("text").to_pylist()]
        hashes = pa.array([h.astype(np.int64) for h, _ in found], pa.list_(pa.int64()))
        positions = pa.array([p for _, p in found], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), hashes, positions], ["doc_id", "hashes", "positions"])

    return with_columns_of("doc_id long, hashes array<long>, positions array<long>", of, only(docs, "doc_id", "text"))


class Known:
    """A document with its kept k-grams and the sorted set of their hashes. Kept positions are at most a window apart, so a
    byte holds the way from one to the next."""

    def __init__(self, doc_id: int | None, text: str | None) -> None:
        self.doc_id, self.text = doc_id, text or ""
        self.hashes, positions = winnow(self.text)
        self.gaps = np.diff(positions, prepend=0).astype(np.uint8)
        self.kept = np.unique(self.hashes)

    def beside(self, after: Known) -> dict:
        """What is returned for this document, whose next one is ``after``."""
        half = len(self.text) // 2
        edited = self.text[: len(self.text) - half] + after.text[:half]
        kept = np.unique(winnow(edited)[0])
        return {
            "doc_id": self.doc_id, "n_chars": len(self.text), "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(),
            "kept": self.hashes.astype(">u4").tobytes(), "gaps": self.gaps.tobytes(), "edited_kept": relative(kept, self.kept),
            "near_edited": likeness(self.kept, kept), "near_next": likeness(self.kept, after.kept),
        }


def relative(kept: np.ndarray, to: np.ndarray) -> bytes:
    """A sorted set of hashes beside another one: a bit for each of the other's hashes, then the further ones."""
    return np.packbits(np.isin(to, kept)).tobytes() + np.setdiff1d(kept, to).astype(">u4").tobytes()


def absolute(data: bytes, to: bytes) -> bytes:
    """The hashes that ``relative`` has packed, sorted, four bytes each."""
    other = np.frombuffer(to, ">u4")
    bits = -(-len(other) // 8)
    common = np.unpackbits(np.frombuffer(data[:bits], np.uint8), count=len(other)).astype(bool)
    return np.sort(np.concatenate((other[common], np.frombuffer(data[bits:], ">u4")))).astype(">u4").tobytes()


def packed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``hash`` (of the text, to order by) and ``text`` compressed for the way; null counts as empty."""

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=9)
        texts = pa.array([small.compress(t) for t in utf8(batch.column("text"))], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), texts], ["doc_id", "hash", "text"])

    return with_columns_of("doc_id long, hash long, text binary", of, only(docs, "doc_id", "text").withColumn("hash", F.xxhash64("text")))


#: What is stored between the steps, and what is returned.
STORED = "doc_id long, n_chars long, edited_sha256 string, kept binary, gaps binary, edited_kept binary, near_edited double, near_next double"
RESULT = STORED.replace("gaps binary", "hashes array<long>, positions array<int>")
NORMAL, FIRST, LAST = 0, 1, 2


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    The next document has the next smaller doc_id, and after the last comes the first. Null doc_ids stand last; rows of
    one doc_id follow each other by their texts' hashes, null texts counting as empty. The edited text has the last
    ``n_chars // 2`` characters replaced by as many of the next document's first ones. ``kept`` and ``edited_kept`` are
    the sorted sets of kept hashes, four bytes each; ``hashes`` and ``positions`` (code points) are the document's kept
    k-grams in the order of the text; likeness is the share of common hashes, 1 for two empty ones.

    Rows are dealt by ranges of doc_id, so each text moves once, and a task holds two documents at a time. The ends of
    the ranges, two rows a task, are joined to each other afterwards. A single document is its own next. Repeated rows
    are rows like others, other columns are not read, and an empty table gives no rows.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("hash")]
    rows = packed(docs).repartitionByRange(*order).sortWithinPartitions(*order)
    fields = [f.split(" ")[0] for f in STORED.split(", ")]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, out, schema = TaskContext.get().partitionId(), None, [], arrow_schema()
        end = {f: None for f in fields}
        large = zstandard.ZstdDecompressor()
        for batch in batches:
            ids = batch.column("doc_id")
            for i in range(batch.num_rows):
                now = Known(ids[i].as_py(), large.decompress(batch.column("text")[i].as_py()).decode())
                if held is None:
                    out.append(end | {"kind": FIRST, "part": part, "doc_id": now.doc_id, "text": now.text})
                else:
                    out.append(held.beside(now) | {"kind": NORMAL, "part": part, "text": None})
                held = now
                if len(out) >= 256:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
        if held is not None:
            out.append(end | {"kind": LAST, "part": part, "doc_id": held.doc_id, "text": held.text})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    found = materialize(rows.mapInArrow(of, f"kind int, part int, text string, {STORED}"), "winnow", "zstd")
    ends = found.filter(F.col("kind") != NORMAL)
    parts = [r.part for r in ends.filter(F.col("kind") == FIRST).select("part").orderBy("part").collect()]  # one per task
    follows = list(zip(parts, parts[1:] + parts[:1], strict=True))
    follows = docs.sparkSession.createDataFrame(follows, "part int, after int")
    first = ends.filter(F.col("kind") == FIRST).select(F.col("part").alias("after"), F.col("doc_id").alias("next_id"), F.col("text").alias("next_text"))
    joined = ends.filter(F.col("kind") == LAST).select("part", "doc_id", "text").join(follows, "part").join(first, "after")

    def close(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = [Known(r["doc_id"], r["text"]).beside(Known(r["next_id"], r["next_text"])) for r in batch.to_pylist()]
        yield pa.RecordBatch.from_pylist(out, arrow_schema(fields))

    closed = with_columns_of(STORED, close, joined)

    def unpacked(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        hashes = [np.frombuffer(k, ">u4") for k in batch.column("kept").to_pylist()]
        kept = [np.unique(h).astype(">u4").tobytes() for h in hashes]
        made = {
            "kept": pa.array(kept, pa.binary()), "hashes": pa.array([h.astype(np.int64) for h in hashes], pa.list_(pa.int64())),
            "positions": pa.array([np.cumsum(np.frombuffer(g, np.uint8), dtype=np.int32) for g in batch.column("gaps").to_pylist()], pa.list_(pa.int32())),
            "edited_kept": pa.array([absolute(e, k) for e, k in zip(batch.column("edited_kept").to_pylist(), kept, strict=True)], pa.binary()),
        }
        names = [f.split(" ")[0] for f in RESULT.split(", ")]
        yield pa.RecordBatch.from_arrays([made[f] if f in made else batch.column(f) for f in names], names)

    return with_columns_of(RESULT, unpacked, found.filter(F.col("kind") == NORMAL).select(fields).unionByName(closed))


def arrow_schema(fields: list[str] | None = None) -> pa.Schema:
    kinds = {
        "kind": pa.int32(), "part": pa.int32(), "text": pa.string(), "doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(),
        "kept": pa.binary(), "gaps": pa.binary(), "edited_kept": pa.binary(), "near_edited": pa.float64(), "near_next": pa.float64(),
    }
    return pa.schema([(f, kinds[f]) for f in fields or kinds])
