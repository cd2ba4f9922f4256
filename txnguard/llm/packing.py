"""Packing of documents into windows of equal length by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import base64
import heapq
import itertools
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from txnguard.llm.columns import only

WINDOW = 2048
#: Documents' ends are cut into pieces of this many tokens and one rest.
PIECE = 256
#: Windows that are levelled out together, and the room that each of them is meant to keep.
GROUP = 128
ROOM = 12
END = 1
SPECIAL = {"<|endoftext|>": 50256}
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"


class Tokens:
    """Ids of whole texts, as the byte-level vocabulary gives them; the end mark's string in a text is its one id."""

    def __init__(self, ranks: str, pattern: str) -> None:
        with open(ranks, "rb") as lines:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=known, special_tokens=SPECIAL)
        self.special = tuple(SPECIAL)

    def encode(self, text: str) -> np.ndarray:
        allowed = {s for s in self.special if s in text}
        return np.asarray(self.encoding.encode_to_numpy(text, allowed_special=allowed, disallowed_special=()), "<u4")


@cache
def tokens(ranks: str, pattern: str) -> Tokens:
    return Tokens(ranks, pattern)


def differencing(sizes: list[int], windows: int) -> list[tuple[int, list[int]]]:
    """The items' numbers for each window, with their sum: sums are as equal as merging partial partitions makes them.

    Each item begins as a partition of its own. The two partitions with the largest difference between their fullest
    and emptiest windows are merged, the one's fullest window with the other's emptiest, until one is left.
    """
    heap = [(-s, k, [s], [[k]]) for k, s in enumerate(sizes)]
    heapq.heapify(heap)
    for number in itertools.count(len(sizes)):
        if len(heap) == 1:
            break
        _, _, sums, items = heapq.heappop(heap)
        _, _, more, others = heapq.heappop(heap)
        sums, items = sums + [0] * (windows - len(sums)), items + [[] for _ in range(windows - len(items))]
        for k, (s, own) in enumerate(zip(more, others, strict=True)):  # the fullest of these to the emptiest of those
            sums[-1 - k] += s
            items[-1 - k] = items[-1 - k] + own
        order = sorted(range(windows), key=sums.__getitem__, reverse=True)
        sums, items = [sums[k] for k in order if sums[k]], [items[k] for k in order if sums[k]]
        low = sums[-1] if len(sums) == windows else 0
        heapq.heappush(heap, (low - sums[0], number, sums, items))
    return list(zip(heap[0][2], heap[0][3], strict=True)) if heap else []


def level(sizes: list[int], capacity: int = WINDOW) -> list[list[int]]:
    """The items' numbers window by window. There are as many windows as their total needs, and one more whenever one
    would hold more than ``capacity``."""
    windows = -(-sum(sizes) // capacity)
    while True:
        found = differencing(sizes, windows) if windows else []
        if all(total <= capacity for total, _ in found):
            return [items for _, items in found]
        windows += 1


def pack(docs: DataFrame, ranks: str, pattern: str, keep: str = "doc_id") -> DataFrame:
    """Pieces of all documents with their places in windows of at most 2048 tokens.

    Per piece: ``doc_id``; ``start`` (its document's tokens before it) and ``length``; ``ids_crc32`` of its ids as
    little-endian 32-bit numbers; ``doc_tokens``, with the end mark; ``sequence_id``; ``offset`` in the sequence, without
    gaps from 0. Each document's ids are those of its whole text and then the end mark 1. Whole windows of a long
    document are sequences of their own; what is left of documents is cut into pieces, and these are levelled out over
    windows, a bounded group of them at a time. Each task packs its own rows: there is no shuffle, and the last group
    of a task may leave one window less full. Numbers of sequences are unique, not consecutive.

    A null or empty text is the end mark alone. Null and repeated doc_ids are packed like others, row by row. Other
    columns are not read. An empty table gives no pieces.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sequence = tokens(ranks, pattern), itertools.count(TaskContext.get().partitionId() << 33)
        items: list[tuple] = []
        rows: list[tuple] = []
        total = 0

        def close() -> None:
            for window in level([i[2] for i in items]):
                number, at = next(sequence), 0
                for k in window:
                    rows.append((*items[k], number, at))
                    at += items[k][2]
            items.clear()

        def give() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                ids = np.append(encoder.encode(batch.column("text")[i].as_py() or ""), np.uint32(END))
                whole = len(ids) - len(ids) % WINDOW
                for start in (*range(0, whole, WINDOW), *range(whole, len(ids), PIECE)):
                    piece = ids[start : start + (WINDOW if start < whole else PIECE)]
                    item = (doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids))
                    if start < whole:
                        rows.append((*item, next(sequence), 0))
                    else:
                        items.append(item)
                        total += len(piece)
                if total >= GROUP * (WINDOW - ROOM):
                    close()
                    total = 0
                if len(rows) > 20_000:
                    yield give()
        close()
        if rows:
            yield give()

    return only(docs, keep, "text").toDF("doc_id", "text").mapInArrow(of, SCHEMA)
