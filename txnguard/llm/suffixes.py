"""Removal of repeated passages by hashed equality of 50-byte strings, with a difference cover as a prefilter.

The texts are cut into chunks of whole documents. A chunk is packed once, in a bucketed table, and read by each pass:

1. *Cover samples.* A difference cover modulo 21 has five residues; of any two positions some common shift of at most 20
   leads to the cover from both. So if two 50-byte strings are equal, the same shift of both leads to equal 30-byte
   strings that are sampled in both documents. The samples' keys are sorted bucket by bucket; a sample is marked
   (in the code: ranked, without any order) if its string is in two documents.
2. *Suffixes.* Only positions with a marked sample within 20 bytes can start a string that another document has. Their
   50 bytes' keys and checks are sorted bucket by bucket, and the smallest document of each key is found.
3. *Removal.* Positions whose string has a smaller document are marked and their bytes taken out.

Each bucket has a bounded share of the keys, is sorted by itself, and answers each chunk with one bit for each of its
keys, in their order. Keys that a chunk has several times are sent once, so what is common to very many documents costs
a bucket no more than a key per chunk.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnguard.llm.columns import only, run_hashes
from txnguard.workdir import materialize, run_dir

LENGTH = 50
PERIOD = 21
COVER = (3, 6, 7, 12, 14)
IN_COVER = np.isin(np.arange(PERIOD), COVER)
SAMPLE = LENGTH - PERIOD + 1
CHUNK_BYTES = 4 << 20
CHUNK_DOCS = 8192
#: Keys of a bucket. A task holds one bucket at a time.
BUCKET_KEYS = 2_000_000
#: Bits of a key beyond those that number the keys: a sample's answer may be wrong once in 4096 (which only makes more
#: suffixes). A suffix's key goes with a check, the upper CHECK_BITS of a second hash; strings are equal if both are.
SAMPLE_SPARE, SUFFIX_SPARE = 12, 34
CHECK_BITS = 32
CHUNKS = "chunk long, ids array<long>, sizes array<long>, digests array<binary>, body binary"
KEYS = "bucket long, chunk long, keys binary, checks binary, docs binary"
ANSWER = "chunk long, bucket long, bits binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


# --- packing --------------------------------------------------------------------------------------------------------


def squeeze(numbers: np.ndarray) -> bytes:
    """64-bit numbers by byte planes, compressed: planes of small numbers' high bytes take no room."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8).T).tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


def chunked(docs: DataFrame) -> DataFrame:
    """Rows of whole documents with about four million bytes together: ids, sizes, digests and the packed bytes."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[bytes] = []
        held, number = 0, TaskContext.get().partitionId() << 32

        def row() -> pa.RecordBatch:
            body = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            digests = [hashlib.sha256(t).digest()[:16] for t in texts]
            columns = [[number], [ids[:]], [[len(t) for t in texts]], [digests], [body]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.binary()]
            ids.clear(), texts.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["chunk", "ids", "sizes", "digests", "body"])

        for batch in batches:
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                text = (batch.column("text")[i].as_py() or "").encode()
                if texts and (held + len(text) > CHUNK_BYTES or len(texts) >= CHUNK_DOCS):
                    yield row()
                    held, number = 0, number + 1
                ids.append(doc)
                texts.append(text)
                held += len(text)
        if texts:
            yield row()

    return only(docs, "doc_id", "text").mapInArrow(of, CHUNKS)


# --- one chunk ------------------------------------------------------------------------------------------------------


class Chunk:
    """The documents of a chunk. ``fresh``: those that take part, neither copies of a smaller document nor without id."""

    def __init__(self, row: dict) -> None:
        self.number, self.ids = row["chunk"], row["ids"]
        self.sizes = np.array(row["sizes"], np.int64)
        self.bytes = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["body"]), np.uint8)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.copies = set(row.get("copies") or ())
        self.doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.sizes)
        self.known_ids = np.array([d if d is not None else 0 for d in self.ids], np.int64)
        self.fresh = np.array([d is not None and k not in self.copies for k, d in enumerate(self.ids)])

    def fits(self, length: int, pattern: np.ndarray | None = None) -> np.ndarray:
        """Positions of fresh documents at which a string of this length fits, and which the pattern of positions has."""
        out = np.zeros(len(self.bytes), bool)
        room = np.where(self.fresh, self.sizes - length + 1, 0)
        line = np.ones(room.max(initial=0), bool) if pattern is None else np.resize(pattern, room.max(initial=0))
        for start, n in zip(self.starts[room > 0].tolist(), room[room > 0].tolist(), strict=True):
            out[start : start + n] = line[:n]
        return out

    def samples(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the cover's samples, and their positions."""
        at = np.flatnonzero(self.fits(SAMPLE, IN_COVER))
        return (run_hashes(self.bytes, SAMPLE)[at] >> np.uint64(64 - bits) if len(at) else np.zeros(0, np.uint64)), at

    def suffixes(self, plan: Plan, ranks: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys and checks of the strings that may be in another document, and their positions."""
        keys, at = self.samples(plan.sample_bits)
        ranked = answers(keys, ranks, plan.sample_bits, plan.sample_buckets) | in_two(keys, self.doc[at])
        near = np.zeros(len(self.bytes) + PERIOD + 1, np.int32)
        near[at[ranked] + 1] = 1
        near = np.cumsum(near, dtype=np.int32)
        at = np.flatnonzero((near[PERIOD:-1] > near[: -PERIOD - 1]) & self.fits(LENGTH))
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint32), at
        keys = run_hashes(self.bytes, LENGTH)[at] >> np.uint64(64 - plan.suffix_bits)
        checks = run_hashes(self.bytes.astype(np.uint16) + np.uint16(256), LENGTH)[at] >> np.uint64(64 - CHECK_BITS)
        return keys, checks.astype(np.uint32), at

    def removed(self, plan: Plan, ranks: dict[int, bytes], smaller: dict[int, bytes]) -> np.ndarray:
        """Which bytes go: those of strings that start in a smaller document, in this chunk or another."""
        keys, checks, at = self.suffixes(plan, ranks)
        out = np.zeros(len(self.bytes) + 1, np.int32)
        if len(keys):
            own = self.known_ids[self.doc[at]]
            order, first, length = grouped(keys, checks)
            least = np.minimum.reduceat(own[order], first)
            elsewhere = flags_of(keys[order[first]], smaller, plan.suffix_bits, plan.suffix_buckets)
            gone = at[order[(own[order] > np.repeat(least, length)) | np.repeat(elsewhere, length)]]
            out[gone] += 1  # each position once, its end also
            np.add.at(out, gone + LENGTH, -1)
        removed = np.cumsum(out[:-1]) > 0
        for k in self.copies:
            if self.sizes[k] >= LENGTH:
                removed[self.starts[k] : self.starts[k] + self.sizes[k]] = True
        return removed

    def results(self, removed: np.ndarray) -> Iterator[dict]:
        for doc, start, size in zip(self.ids, self.starts.tolist(), self.sizes.tolist(), strict=True):
            gone = removed[start : start + size]
            edges = np.count_nonzero(gone[1:] & ~gone[:-1]) + int(size > 0 and gone[0])
            kept = self.bytes[start : start + size][~gone].tobytes()
            yield {"doc_id": doc, "n_bytes": size, "n_removed": int(gone.sum()), "n_spans": int(edges), "kept_sha256": hashlib.sha256(kept).hexdigest()}


def different(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and the numbers of keys that each stands for."""
    ordered = np.sort(keys)
    first = np.flatnonzero(np.concatenate((np.ones(min(len(keys), 1), bool), ordered[1:] != ordered[:-1])))
    return ordered[first], np.diff(np.append(first, len(keys)))


def grouped(keys: np.ndarray, checks: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by key and check, where in it each different pair begins, and how many each stands for. Different
    strings of one key are very rare; only then is the check sorted too."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.concatenate((np.ones(min(len(keys), 1), bool), ordered[1:] != ordered[:-1]))
    if checks is not None:
        apart = checks[order][1:] != checks[order][:-1]
        if (apart & ~new[1:]).any():
            order = np.lexsort((checks, keys))
            apart = checks[order][1:] != checks[order][:-1]
            new[1:] |= apart
    first = np.flatnonzero(new)
    return order, first, np.diff(np.append(first, len(keys)))


def among(keys: np.ndarray, few: np.ndarray) -> np.ndarray:
    """Which keys are among a few ones in order."""
    if not len(few):
        return np.zeros(len(keys), bool)
    return few[np.minimum(np.searchsorted(few, keys), len(few) - 1)] == keys


def in_two(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether another document of the chunk has the key as well."""
    known, times = different(keys)
    at = np.flatnonzero(among(keys, known[times > 1]))
    order = np.argsort(keys[at], kind="stable")  # documents stay in order within a key
    k, d = keys[at][order], doc[at][order]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(k), 1), bool), k[1:] != k[:-1])))
    length = np.diff(np.append(first, len(k)))
    out = np.zeros(len(keys), bool)
    if len(k):
        out[at[order]] = np.repeat(d[first] != d[first + length - 1], length)
    return out


def bucket_of(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Buckets are ranges of keys."""
    return ((keys >> np.uint64(max(bits - 32, 0))) * np.uint64(buckets) >> np.uint64(min(bits, 32))).astype(np.int64)


def answers(keys: np.ndarray, given: dict[int, bytes], bits: int, buckets: int) -> np.ndarray:
    """The buckets' answers to each key; they are given for the different keys in their order."""
    known, _ = different(keys)
    return among(keys, known[flags_of(known, given, bits, buckets)])


def flags_of(known: np.ndarray, given: dict[int, bytes], bits: int, buckets: int) -> np.ndarray:
    """The buckets' answers, one for each different key (and check) in order."""
    flags = np.zeros(len(known), bool)
    for b, s, e in slices(bucket_of(known, bits, buckets)):
        if b in given:
            flags[s:e] = np.unpackbits(np.frombuffer(given[b], np.uint8), count=e - s).astype(bool)
    return flags


def slices(sorted_numbers: np.ndarray) -> Iterator[tuple[int, int, int]]:
    cuts = [0, *(np.flatnonzero(sorted_numbers[1:] != sorted_numbers[:-1]) + 1).tolist(), len(sorted_numbers)]
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        if s < e:
            yield int(sorted_numbers[s]), s, e


# --- passes over all chunks -----------------------------------------------------------------------------------------


class Plan:
    """Sizes of keys and numbers of buckets, from the bytes of all texts and the number of suffix keys."""

    def __init__(self, total: int) -> None:
        samples = max(1, total * len(COVER) // PERIOD)
        self.sample_bits = min(64, math.ceil(math.log2(samples + 1)) + SAMPLE_SPARE)
        self.suffix_bits = min(64, math.ceil(math.log2(total + 2)) + SUFFIX_SPARE)
        self.sample_buckets = -(-samples // BUCKET_KEYS)
        self.suffix_buckets = -(-total // (4 * BUCKET_KEYS)) or 1


def each_chunk(chunks: DataFrame, fn: Callable[[dict], Iterator[dict]], schema: str, kinds: pa.Schema) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                out = list(fn(batch.slice(i, 1).to_pylist()[0]))
                if out:
                    yield pa.RecordBatch.from_pylist(out, kinds)

    return chunks.mapInArrow(of, schema)


KEY_KINDS = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("checks", pa.binary()), ("docs", pa.binary())])
RESULT_KINDS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def deal(chunk: int, keys: np.ndarray, checks: np.ndarray | None, docs: np.ndarray | None, bits: int, buckets: int) -> Iterator[dict]:
    """A chunk's different keys (with their checks and smallest documents) by bucket, in their order."""
    own = least = None
    if docs is None:
        known, _ = different(keys)
    else:
        order, first, _ = grouped(keys, checks)
        known, own, least = keys[order[first]], checks[order[first]], np.minimum.reduceat(docs[order], first) if len(keys) else docs
    for b, s, e in slices(bucket_of(known, bits, buckets)):
        packed = squeeze(np.diff(known[s:e], prepend=np.uint64(0)))
        yield {
            "bucket": b, "chunk": chunk, "keys": packed, "checks": None if own is None else own[s:e].tobytes(),
            "docs": None if least is None else squeeze(least[s:e].view(np.uint64)),
        }


def sorted_buckets(dealt: DataFrame) -> DataFrame:
    """One bit for each key of each chunk: without documents, whether another chunk has the key; with documents, whether
    another chunk has it in a smaller one. One bucket is sorted at a time."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def close() -> Iterator[pa.RecordBatch]:
            lists = [np.cumsum(unsqueeze(r["keys"]), dtype=np.uint64) for r in held]
            ends = np.cumsum([len(x) for x in lists])
            keys = np.concatenate(lists)
            lists.clear()
            checks = None if held[0]["docs"] is None else np.concatenate([np.frombuffer(r["checks"], np.uint32) for r in held])
            order, first, length = grouped(keys, checks)
            flags = np.empty(len(keys), bool)
            if held[0]["docs"] is None:
                flags[order] = np.repeat(length > 1, length)
            else:
                docs = np.concatenate([unsqueeze(r["docs"]).view(np.int64) for r in held])
                flags[order] = docs[order] > np.repeat(np.minimum.reduceat(docs[order], first), length)
            bits = [np.packbits(x).tobytes() for x in np.split(flags, ends[:-1])]
            arrays = [pa.array([r[c] for r in held], pa.int64()) for c in ("chunk", "bucket")]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(bits, pa.binary())], ["chunk", "bucket", "bits"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if held and held[0]["bucket"] != row["bucket"]:
                    yield from close()
                    held.clear()
                held.append(row)
        if held:
            yield from close()

    return dealt.repartition("bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(of, ANSWER)


def with_answers(chunks: DataFrame, given: DataFrame, name: str) -> DataFrame:
    """``chunks`` with what the buckets say about each. The large side is bucketed by chunk and stays where it is."""
    own = given.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))
    return chunks.join(own, "chunk", "left")


def pairs(rows: list[dict] | None) -> dict[int, bytes]:
    return {r["bucket"]: r["bits"] for r in rows or ()}


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` of each row of ``docs(doc_id, text)``.

    A byte goes if a 50-byte string over it also starts in a document with a smaller doc_id; texts are UTF-8, null is
    empty, and strings never cross documents. Texts that equal a smaller document's are settled by their digests.

    A null doc_id is neither smaller nor larger than others: such rows lose nothing and take nothing from others. Rows
    of one doc_id do not remove from each other. Texts shorter than 50 bytes stay. A very long text is a chunk of its
    own. Other columns are not read. An empty table gives no rows.
    """
    spark, where = docs.sparkSession, run_dir(docs.sparkSession, "suffixes")
    table = f"suffixes_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunked(docs).write.option("path", where).bucketBy(buckets, "chunk").saveAsTable(table)
    try:
        return _removed(spark.table(table))
    finally:
        spark.sql(f"DROP TABLE {table}")  # the catalogue's entry; its files stay in the shared folder


def _removed(chunks: DataFrame) -> DataFrame:
    numbered = chunks.select("chunk", F.posexplode(F.arrays_zip("ids", "digests", "sizes")).alias("place", "doc"))
    numbered = numbered.select("chunk", "place", "doc.ids", "doc.digests", "doc.sizes").filter("ids is not null")
    least = numbered.groupBy("digests").agg(F.min("ids").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    copies = numbered.join(least, "digests").filter("ids > least").groupBy("chunk").agg(F.collect_list("place").alias("copies"))
    total = chunks.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    plan = Plan(total)
    copies = materialize(copies, "suffix-copies")
    fresh = chunks.select("chunk", "ids", "sizes", "body").join(copies, "chunk", "left")

    def samples(row: dict) -> Iterator[dict]:
        own = Chunk(row)
        yield from deal(own.number, own.samples(plan.sample_bits)[0], None, None, plan.sample_bits, plan.sample_buckets)

    def suffixes(row: dict) -> Iterator[dict]:
        own = Chunk(row)
        keys, checks, at = own.suffixes(plan, pairs(row["ranks"]))
        yield from deal(own.number, keys, checks, own.known_ids[own.doc[at]], plan.suffix_bits, plan.suffix_buckets)

    def removal(row: dict) -> Iterator[dict]:
        own = Chunk(row)
        yield from own.results(own.removed(plan, pairs(row["ranks"]), pairs(row["smaller"])))

    ranks = materialize(sorted_buckets(each_chunk(fresh, samples, KEYS, KEY_KINDS)), "suffix-ranks")
    ranked = with_answers(fresh, ranks, "ranks")
    smaller = materialize(sorted_buckets(each_chunk(ranked, suffixes, KEYS, KEY_KINDS)), "suffix-smaller")
    return each_chunk(with_answers(ranked, smaller, "smaller"), removal, RESULT, RESULT_KINDS)
