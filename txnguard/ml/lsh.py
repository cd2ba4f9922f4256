"""Near neighbours of every row within one large set, by random projections; candidates meet in blocks of limited size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnguard.ml.neighbours import nearest_columns
from txnguard.workdir import materialize

TABLES, PROJECTIONS = 16, 4
#: Rows that a cell is meant to have at most; larger ones are halved by further projections. With more than four halvings
#: there are so many more tables for each.
CELL_ROWS, FREE_HALVINGS, MORE_TABLES = 8192, 4, 1.4
#: Sampled rows for each cell that halving makes, by which the halves are found.
SAMPLE_A_CELL = 32
#: Width of a projection's cells, in distances to the k-th neighbour.
WIDTH = 4.0
#: Rows on which the distance to the k-th neighbour is estimated.
SAMPLE = 1024
BLOCK_ROWS = 4096
SEED = 42


def typical_distance(points: DataFrame, k: int, sample: int = SAMPLE) -> float:
    """The median distance of a row to its k-th neighbour, from sampled rows.

    Of all rows' k nearest, the sample has its share. Where that is less than one, the distance to the sample's nearest is
    scaled down by how fast the number of neighbours grows with the distance within the sample.
    """
    n = points.count()
    rows = points.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    if len(rows) < 2:
        return 1.0
    x = np.array([r.x for r in rows], float)
    square = (x**2).sum(axis=1)
    d = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * x @ x.T, 0))
    np.fill_diagonal(d, np.inf)
    d.sort(axis=1)
    share, last = k * len(rows) / n, len(rows) - 2
    median = np.median(d, axis=0)
    found = float(median[min(last, max(1, round(share)) - 1)])
    if share < 1 and last >= 3 and 0 < median[0] < median[3]:
        found *= share ** (np.log(median[3] / median[0]) / np.log(4))
    return found or float(median[last]) or 1.0


class Cells:
    """The cells of every table: of random projections, and for each crowded one the further lines and places that halve it."""

    def __init__(self, width: float, dimensions: int, tables: int, projections: int, halvings: int) -> None:
        rng = np.random.default_rng(SEED)
        self.width, self.tables, self.projections = width, tables, projections
        self.lines, self.shifts = rng.standard_normal((dimensions, tables * projections)), rng.uniform(0, width, tables * projections)
        self.mix = rng.integers(1, 2**62, projections) | 1
        self.further = rng.standard_normal((tables, dimensions, halvings))
        self.places: dict[tuple[int, int], np.ndarray] = {}

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row in each table."""
        cells = np.floor((x @ self.lines + self.shifts) / self.width).astype(np.int64).reshape(len(x), self.tables, self.projections)
        return (cells * self.mix).sum(axis=2)

    def halve(self, sizes: dict[tuple[int, int], int], sample: np.ndarray, cell_rows: int) -> None:
        """Finds the places at which cells of more than ``cell_rows`` rows are halved, from sampled rows."""
        buckets = self.buckets(sample)
        for (tab, bucket), n in sizes.items():
            x = sample[buckets[:, tab] == bucket] @ self.further[tab]
            depth = min(halvings(n, cell_rows), x.shape[1])
            places, node = np.zeros(2**depth - 1), np.zeros(len(x), np.int64)
            for d in range(depth):
                for at in range(2**d - 1, 2 ** (d + 1) - 1):
                    if (own := x[node == at, d]).size:
                        places[at] = np.median(own)
                node = 2 * node + 1 + (x[:, d] > places[node])
            self.places[tab, bucket] = places

    def parts(self, x: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """The part of its cell in which each row is in each table; 0 in cells that are not halved."""
        out = np.zeros(buckets.shape, np.int32)
        for (tab, bucket), places in self.places.items():
            rows = np.flatnonzero(buckets[:, tab] == bucket)
            if len(rows):
                along, node = x[rows] @ self.further[tab], np.zeros(len(rows), np.int64)
                for d in range(int(len(places) + 1).bit_length() - 1):
                    node = 2 * node + 1 + (along[:, d] > places[node])
                out[rows, tab] = node - len(places)
        return out


def halvings(n: int, cell_rows: int) -> int:
    """How often a cell of ``n`` rows is halved."""
    return int(np.ceil(np.log2(max(1.0, n / cell_rows))))


def bucketed(points: DataFrame, cells: Cells, rows: bool = True) -> DataFrame:
    """``(tab, bucket, part)`` of every row in each table and, with ``rows``, its ``id`` and ``x``."""
    shared = points.sparkSession.sparkContext.broadcast(cells)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                bucket = own.buckets(x)
                made = [np.tile(np.arange(own.tables, dtype=np.int32), len(x)), bucket.ravel(), own.parts(x, bucket).ravel()]
                columns = dict(zip(("tab", "bucket", "part"), map(pa.array, made), strict=True))
                if rows:
                    again = pa.array(np.repeat(np.arange(len(x)), own.tables))
                    columns |= {"id": part.column("id").take(again), "x": part.column("x").take(again)}
                yield pa.RecordBatch.from_pydict(columns)

    return points.mapInArrow(of, "tab int, bucket long, part int" + ", id string, x array<double>" * rows)


def block_neighbours(k: int):
    """The k nearest of each row within a block, or between two blocks; rows come sorted by block pair, one pair is held."""

    def nearest(ids: np.ndarray, x: np.ndarray, side: np.ndarray, same: bool) -> Iterator[pa.RecordBatch]:
        every = np.arange(len(x))
        for s in (side[:1] if same else np.unique(side)):
            left, right = (every, every) if same else (every[side == s], every[side != s])
            itself = (every, every) if same else (every[:0], every[:0])
            for i, j, far in nearest_columns(x[left], x[right], itself, k):
                yield pa.RecordBatch.from_arrays([pa.array(ids[left[i]], pa.string()), pa.array(ids[right[j]], pa.string()), pa.array(far)], ["id", "neighbour", "distance"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                ids, x, side = (np.concatenate(c) for c in zip(*held, strict=True))
                if len(ids) > 1:
                    yield from nearest(ids, x, side, key[-2] == key[-1])

        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in ("tab", "bucket", "part", "i", "j")], strict=True))
            ids = np.array(batch.column("id").to_pylist(), object)
            own = batch.column("own").to_numpy(zero_copy_only=False)
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else None
            cuts = [k for k in range(len(keys)) if not k or keys[k] != keys[k - 1]] + [len(keys)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if keys[s] != key:
                    yield from close()
                    key, held = keys[s], []
                held.append((ids[s:e], x[s:e].copy(), own[s:e].copy()))
        yield from close()

    return of


def cells_of(points: DataFrame, width: float, tables: int, projections: int, cell_rows: int) -> Cells:
    """The tables' cells for these rows: sampled rows say where the crowded ones are halved."""
    n, dimensions = points.count(), len(points.first().x)
    most = halvings(n, cell_rows)
    tables = int(np.ceil(tables * MORE_TABLES ** max(0, most - FREE_HALVINGS)))
    cells = Cells(width, dimensions, tables, projections, most)
    if most:
        sizes = bucketed(points, cells, False).groupBy("tab", "bucket").count().filter(F.col("count") > cell_rows)
        crowded = {(r.tab, r.bucket): r["count"] for r in sizes.collect()}  # at most n / cell_rows a table
        share = min(1.0, SAMPLE_A_CELL * 2**most / n)
        sample = points.filter(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 30)) < share * (1 << 30)).select("x").collect()  # rows in proportion to the cells
        if sample:
            cells.halve(crowded, np.array([r.x for r in sample], float), cell_rows)
    return cells


def near_neighbours(
    df: DataFrame, id_col: str, vector: str, k: int = 5, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, block_rows: int = BLOCK_ROWS,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """``(id, neighbour, rank, distance)``: up to ``k`` near other rows of each row, nearly always the nearest ones.

    Rows that share a cell of one of the tables' random projections are compared exactly. A cell of more than ``cell_rows``
    rows is halved by further projections at medians of sampled rows, so that the work of a table follows the rows; a neighbour
    is cut off more often then, and from four halvings on there are MORE_TABLES times as many tables for each. What is
    still a cell (copies can't be halved) stays whole: one of more than ``block_rows`` rows is dealt into blocks, and every two of them meet in a group of their own, so no task holds more
    than two blocks; each gives at most k candidates a row. Without halving, two rows as near as a typical k-th neighbour share no cell
    with a chance of about 2e-4 (four projections of cells four times as wide, sixteen tables). Ids must be unique; of
    equal distances the smaller id counts. Rows without vector have no neighbours.
    """
    points = df.filter(F.col(vector).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    points = materialize(points, "lsh-points")
    first = points.limit(1).collect()
    if not first:
        return points.select("id", F.col("id").alias("neighbour"), F.lit(1).alias("rank"), F.lit(0.0).alias("distance"))
    cells = cells_of(points, width * typical_distance(points, k), tables, projections, cell_rows)
    spot = ["tab", "bucket", "part"]
    sizes = bucketed(points, cells, False).groupBy(*spot).agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("blocks"), F.count("*").alias("n"))
    sizes = materialize(sizes.filter("n > 1").drop("n"), "lsh-sizes")
    known = bucketed(points, cells).join(sizes, spot).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = known.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = other.select(*spot, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "x")
    group = [*spot, "i", "j"]
    found = met.repartition(*group).sortWithinPartitions(*group, "id").mapInArrow(block_neighbours(k), "id string, neighbour string, distance double")
    once = found.groupBy("id", "neighbour").agg(F.min("distance").alias("distance"))
    best = Window.partitionBy("id").orderBy("distance", "neighbour")
    return once.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("id", "neighbour", "rank", "distance")
