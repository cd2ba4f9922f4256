"""Small helpers that every operator of this folder shares."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_CHUNK = 512
HASHED_AT_ONCE = 1 << 14


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just the columns an operator works on, so that no other column of the input can clash with its own names."""
    return df.select(*[F.col(f"`{n}`").alias(n) for n in names])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or the next longer one that no column of ``df`` has; upper and lower case count as equal, as in Spark."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_columns_of(schema: str, fn: Callable, df: DataFrame) -> DataFrame:
    """``mapInArrow`` in chunks of few rows: texts can be long, so a whole batch is never expanded at once."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_PER_CHUNK):
                yield from fn(batch.slice(start, ROWS_PER_CHUNK))

    return df.mapInArrow(chunks, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null becomes empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def spread(h: np.ndarray) -> np.ndarray:
    """Mixes the bits of 64-bit numbers, in numpy's wrapping arithmetic."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def run_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` numbers. Long inputs go block by block, so that each block's steps stay in the
    processor's cache."""
    n = len(values) - size + 1
    if n <= HASHED_AT_ONCE:
        return _run_hashes(values, size)
    out = np.empty(n, np.uint64)
    for at in range(0, n, HASHED_AT_ONCE):
        end = min(at + HASHED_AT_ONCE, n)
        out[at:end] = _run_hashes(values[at : end + size - 1], size)
    return out


def _run_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """From the hashes of runs of 1, 2, 4 .. numbers."""
    run, have, out, at = spread(values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 1, None, 0
    n, left = len(values) - size + 1, size
    while left:
        if left & 1:
            piece = run[at : at + n]
            out = piece if out is None else (out * np.uint64(0x9FB21C651E98DF25)) ^ piece
            out = out ^ (out >> np.uint64(29))
            at += have
        left >>= 1
        if left:
            run = (run[:-have] * np.uint64(0xD6E8FEB86659FD93)) + run[have:]
            run ^= run >> np.uint64(32)
            have *= 2
    return spread(out)
