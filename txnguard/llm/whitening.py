"""Whitening of embeddings: exact sums and a centred covariance from Spark, components by contour integration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnguard.llm import feast

GRID, SHIFT = 1024, 100_000
COMPONENTS = 8
ROWS_AT_ONCE = 4096
#: Variances below this share of all variance are rounding: such components are none.
LEAST = 1e-12
LARGEST = 2**63 - 1


@dataclass(frozen=True)
class Fit:
    """``n`` vectors with exact ``sums`` by dimension; their covariance's largest ``values`` and unit ``components`` (as
    columns), and its ``trace``."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return x - np.array([s / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.values)


def vectors_of(rows: DataFrame, vector: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``own`` (the kept columns) and ``x``: the entries on the grid, of the rows whose vector is whole and finite."""
    c = F.col(f"`{vector}`")
    finite = F.forall(c, lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(v.cast("double")))
    grid = F.transform(c, lambda v: F.floor(v.cast("double") * GRID).cast("long") + SHIFT)
    own = F.struct(*[F.col(f"`{k}`").alias(k) for k in keep], F.lit(0).alias("_")).alias("own")
    return rows.filter(c.isNotNull() & finite & (F.size(c) > 0)).select(own, grid.alias("x"))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with their vectors as rows of a matrix."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def common_size(rows: DataFrame) -> int:
    """The commonest number of dimensions, of equally common ones the largest; 0 without rows."""
    top = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    return top[0].size if top else 0


def exact_sums(rows: DataFrame, size: int) -> tuple[int, tuple[int, ...]]:
    """The number of vectors and their sums by dimension; each task adds up its own."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * size
        for _, x in blocks(batches):
            n += len(x)
            high, low = x >> 32, x & 0xFFFFFFFF  # neither half's sum can overflow
            total = [t + (int(h) << 32) + int(k) for t, h, k in zip(total, high.sum(axis=0), low.sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_pydict({"i": list(range(-1, size)), "total": [str(t) for t in (n, *total)]}, pa.schema([("i", pa.int32()), ("total", pa.string())]))

    sums = rows.select("x").mapInArrow(of, "i int, total string").groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found = {r.i: int(r.total) for r in sums.collect()}  # a number per dimension
    return found.get(-1, 0), tuple(found.get(i, 0) for i in range(size))


def moments(rows: DataFrame, of_block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums by dimension and sums of products of ``of_block(x)``, a matrix of ``size`` columns."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(size), np.zeros((size, size))
        for _, x in blocks(batches):
            y = of_block(x)
            first += y.sum(axis=0)
            second += y.T @ y
        row, col = np.divmod(np.arange(size * (size + 1)), size)
        yield pa.RecordBatch.from_arrays([pa.array(row - 1), pa.array(col), pa.array(np.concatenate((first, second.ravel())))], ["i", "j", "total"])

    sums = rows.select("x").mapInArrow(of, "i long, j long, total double").groupBy("i", "j").agg(F.sum("total").alias("total"))
    first, second = np.zeros(size), np.zeros((size, size))
    for r in sums.collect():  # a number per pair of dimensions
        if r.i < 0:
            first[r.j] = r.total
        else:
            second[r.i, r.j] = r.total
    return first, second


def fit(rows: DataFrame, size: int, components: int = COMPONENTS) -> Fit:
    n, sums = exact_sums(rows, size)
    if not n:
        return Fit(0, (), np.zeros(0), np.zeros((size, 0)), 0.0)
    plain = Fit(n, sums, np.zeros(0), np.zeros((size, 0)), 0.0)
    first, second = moments(rows, plain.centred, size)
    v = second / n - np.outer(first / n, first / n)  # first is what rounding has left of zero
    v, trace = (v + v.T) / 2, float(v.trace())
    values, found = feast.largest(v, components)
    kept = values > LEAST * trace
    return Fit(n, sums, values[kept], found[:, kept], trace)


def identity_error(rows: DataFrame, model: Fit) -> float:
    """The largest entry, in size, of the whitened rows' covariance minus the identity."""
    k = len(model.values)
    if not k:
        return 0.0
    first, second = moments(rows, model.whitened, k)
    return float(np.abs(second / model.n - np.outer(first / model.n, first / model.n) - np.eye(k)).max())


def deviations(model: Fit, x: np.ndarray) -> list[int | None]:
    """The sums of (n * x - S)^2, exactly; null where a long cannot hold it."""
    reach = max(max(abs(model.n * int(x[:, j].min()) - s), abs(model.n * int(x[:, j].max()) - s)) for j, s in enumerate(model.sums))
    kind = np.int64 if reach**2 * len(model.sums) <= LARGEST and model.n * int(np.abs(x).max()) <= LARGEST else object
    far = model.n * x.astype(kind) - np.array(model.sums, kind)
    return [int(d) if d <= LARGEST else None for d in (far * far).sum(axis=1)]


def whiten(rows: DataFrame, keep: tuple[str, ...] = ("vec_id",), vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per row and component: ``keep``, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained``,
    ``identity_error``.

    A row's entries c become x = floor(1024 * c) + 100000. The covariance of all x-vectors (divisor n, centred before
    multiplying) comes from sums over tasks, a matrix of the dimensions each; its largest eigenpairs come from contour
    integration on the driver, and every row is projected in the tasks. Four passes over the vectors, no shuffle of
    rows, and nothing held but blocks and matrices of the dimensions.

    Vectors that are null or empty or hold null or non-finite entries are left out, and so are those that have not the
    commonest number of dimensions. Components without variance are none, so equal vectors give no rows, and neither
    does an empty table. Repeated rows count each; null ids are ids like others. Other columns are not read.
    """
    known = vectors_of(rows, vector, keep)
    size = common_size(known)
    known = known.filter(F.size("x") == size)
    model = fit(known, size, components)
    error, k = identity_error(known, model), len(model.values)
    shared = rows.sparkSession.sparkContext.broadcast(model)  # a matrix of dimensions by components
    kinds = "component int, n long, deviation long, whitened double, explained double, identity_error double"

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part, x in blocks(batches):
            if not k or not len(x):
                continue
            made = {
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), "n": pa.array(np.full(len(x) * k, own.n)),
                "deviation": pa.array(deviations(own, x), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))),
                "whitened": pa.array(own.whitened(x).ravel()), "explained": pa.array(np.tile(own.values / own.trace, len(x))),
                "identity_error": pa.array(np.full(len(x) * k, error)),
            }
            ids = part.column("own").take(pa.array(np.repeat(np.arange(len(x)), k)))
            yield pa.RecordBatch.from_arrays([ids, *made.values()], ["own", *made])

    return known.mapInArrow(of, f"own {known.schema['own'].dataType.simpleString()}, {kinds}").select(*[F.col("own").getField(c).alias(c) for c in keep], *[c.split(" ")[0] for c in kinds.split(", ")])
