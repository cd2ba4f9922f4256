"""Exact nearest neighbours of every row within one set, as a pruned and blocked Spark job.

Rows are put into cells around pivots. Distance bounds between cells tell which cells can hold a neighbour; only
those rows meet, in blocks of limited size, and each block keeps ``k`` candidates per row. Copies of one point are
folded into one point first, so a point that fills a third of the table costs one row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, and the most of one where there are very many rows: each row goes to about as many blocks as there are cells.
BLOCK_ROWS, MOST_BLOCK_ROWS = 4096, 1 << 15
LEAST_CELLS = 16
MAX_CELLS = 512
SLACK = 1e-9


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=float)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))


def _slices(rows: int, other: int, width: int) -> Iterator[slice]:
    step = max(1, 4_000_000 // max(1, other * width))
    return (slice(i, i + step) for i in range(0, rows, step))


def equal_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places ``(in a, in b)`` of all equal ids, by place in ``a``; ids may be null or come repeatedly."""
    codes = pd.factorize(np.concatenate([b, a]), use_na_sentinel=False)[0]
    order = np.argsort(codes[: len(b)], kind="stable")
    known, wanted = codes[order], codes[len(b) :]
    begin, end = np.searchsorted(known, wanted, "left"), np.searchsorted(known, wanted, "right")
    count = end - begin
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
    return np.repeat(np.arange(len(a)), count), order[at]


def nearest_columns(
    a: np.ndarray, b: np.ndarray, own: tuple[np.ndarray, np.ndarray], k: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(row of a, row of b, distance)``: of each row of ``a`` the k nearest rows of ``b`` by distance, then by place in ``b``.
    ``own``: places (in a, in b) of rows that are no neighbours, by place in ``a``. Rows that are not finite have none.

    Products of matrices give all squared distances but for rounding, whose bound is known. What may be among the k
    nearest within that bound is computed again by differences, so the result is that of comparing all.
    """
    finite_a, finite_b = np.flatnonzero(np.isfinite(a).all(axis=1)), np.flatnonzero(np.isfinite(b).all(axis=1))
    if not len(finite_a) or not len(finite_b):
        return
    own_a, own_b = own
    if len(finite_a) < len(a) or len(finite_b) < len(b):
        kept = np.isin(own_a, finite_a) & np.isin(own_b, finite_b)
        own_a, own_b = np.searchsorted(finite_a, own_a[kept]), np.searchsorted(finite_b, own_b[kept])
    a, b = a[finite_a], b[finite_b]
    centre = b[0]
    with np.errstate(over="ignore", invalid="ignore"):
        ca, cb = a - centre, b - centre
        sa, sb = (ca**2).sum(axis=1), (cb**2).sum(axis=1)
        scale = float(sa.max() + sb.max())
        wide_a = np.hstack([-2 * ca, np.ones((len(a), 1)), sa[:, None]])
        wide_b = np.ascontiguousarray(np.hstack([cb, sb[:, None], np.ones((len(b), 1))]).T)
        slack = 16 * (a.shape[1] + 8) * np.finfo(float).eps * scale
    group = len(b) // (8 * k + 1)
    for at in range(0, len(a), step := max(1, 500_000 // len(b))):
        rows = np.arange(at, min(at + step, len(a)))
        mine = slice(*np.searchsorted(own_a, (at, at + len(rows))))
        if np.isfinite(scale):
            d = wide_a[rows] @ wide_b
        else:  # too large to be squared
            d = np.zeros((len(rows), len(b)))
        d[own_a[mine] - at, own_b[mine]] = np.inf
        if group > 1:  # the k-th least of the groups' least is no less than the k-th least of all
            least = d[:, : len(b) // group * group].reshape(len(rows), -1, group).min(axis=2)
        else:
            least = d
        most = np.partition(least, k - 1, axis=1)[:, k - 1] if least.shape[1] > k else np.full(len(rows), np.inf)
        left, right = np.divmod(np.flatnonzero(d <= np.minimum(most + slack, np.finfo(float).max)[:, None]), len(b))
        far = np.empty(len(left))
        with np.errstate(over="ignore"):
            for part in _slices(len(left), 1, a.shape[1]):
                far[part] = np.sqrt(((a[rows[left[part]]] - b[right[part]]) ** 2).sum(axis=1))
        order = np.lexsort((right, far, left))
        left, right, far = left[order], right[order], far[order]
        rank = np.arange(len(left)) - np.searchsorted(left, left, "left")
        kept = (rank < k) & np.isfinite(far)
        yield finite_a[rows[left[kept]]], finite_b[right[kept]], far[kept]


def assign_cells(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds the nearest pivot and the distance to it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            x = _matrix(pdf["x"])
            cell, near = np.empty(len(x), dtype=int), np.empty(len(x))
            for part in _slices(len(x), len(pivots), x.shape[1]):
                d = _distances(x[part], pivots)
                cell[part], near[part] = d.argmin(axis=1), d.min(axis=1)
            yield pdf.assign(cell=cell, near=near)

    return points.mapInPandas(run, "pid string, x array<double>, cell int, near double")


def cell_bounds(pivots: np.ndarray, stats: list, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(reach, need)``: ``need[j, i]`` is the smallest distance to pivot j a row of cell j must have to matter to cell i.

    ``reach[i]`` bounds the distance from any row of cell i to its k-th neighbour, from the rows closest to each pivot.
    """
    gap = _distances(pivots, pivots)
    radius = np.full(len(pivots), -np.inf)
    close_cell, close_near = [], []
    for row in stats:
        radius[row.cell] = row.radius
        close_cell += [row.cell] * len(row.closest)
        close_near += list(row.closest)
    close_cell, close_near = np.array(close_cell), np.array(close_near)
    reach = np.empty(len(pivots))
    for i in range(len(pivots)):
        upper = np.sort(radius[i] + gap[i, close_cell] + close_near)
        # One of the bounded rows may be the row itself.
        reach[i] = upper[k] if len(upper) > k else np.inf
    need = gap - radius[None, :] - reach[None, :] - SLACK
    need[:, ~np.isfinite(radius)] = np.inf
    return reach, need


def block_candidates(k: int):
    """Top ``k`` of one block of candidates for each row of one block."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"pid": pd.Series(dtype=str), "nid": pd.Series(dtype=str), "distance": pd.Series(dtype=float)})
        if left.empty or right.empty:
            return empty
        right = right.sort_values("pid").reset_index(drop=True)
        a, b = _matrix(left["x"]), _matrix(right["x"])
        lid, rid = left["pid"].to_numpy(), right["pid"].to_numpy()
        near = nearest_columns(a, b, equal_pairs(lid, rid), k)
        found = [pd.DataFrame({"pid": lid[i], "nid": rid[j], "distance": d}) for i, j, d in near]
        return pd.concat(found) if found else empty

    return run


def _distinct_neighbours(points: DataFrame, k: int, block_rows: int | None) -> DataFrame:
    """``(pid, nid, distance)`` for distinct points: the k nearest others, ties by id."""
    n = points.count()
    block_rows = block_rows or min(MOST_BLOCK_ROWS, max(BLOCK_ROWS, n // LEAST_CELLS))
    cells = max(1, min(MAX_CELLS, math.ceil(n / block_rows)))
    picked = points.orderBy(F.md5("pid"), "pid").limit(cells).collect()
    if not picked:
        return points.select("pid", F.col("pid").alias("nid"), F.lit(0.0).alias("distance")).limit(0)
    pivots = np.array([r.x for r in picked], dtype=float)
    placed = assign_cells(points, pivots)
    by_near = Window.partitionBy("cell").orderBy("near", "pid")
    closest = placed.withColumn("_rn", F.row_number().over(by_near)).filter(F.col("_rn") <= k + 1)
    closest = closest.groupBy("cell").agg(F.collect_list("near").alias("closest"))
    sizes = placed.groupBy("cell").agg(F.max("near").alias("radius"), F.count("*").alias("n"))
    stats = sizes.join(closest, "cell").collect()  # at most MAX_CELLS rows
    _, need = cell_bounds(pivots, stats, k)
    radius = {r.cell: r.radius for r in stats}
    size = {r.cell: r.n for r in stats}
    # How many rows can come to each cell at most, and so how many blocks each side needs.
    coming = {i: sum(size[j] for j in size if radius[j] >= need[j, i]) for i in size}
    left_blocks = {i: math.ceil(size[i] / block_rows) for i in size}
    right_blocks = {i: max(1, math.ceil(coming[i] / block_rows)) for i in size}

    def block_of(ids: pd.Series, blocks: int) -> np.ndarray:
        return (pd.util.hash_array(ids.to_numpy().astype(object)) % blocks).astype(int)

    def spread_left(batches):
        for pdf in batches:
            for i, part in pdf.groupby("cell"):
                own = block_of(part["pid"], left_blocks[i])
                for s in range(right_blocks[i]):
                    yield part[["pid", "x"]].assign(cell=i, lb=own, rb=s)

    def spread_right(batches):
        for pdf in batches:
            for j, part in pdf.groupby("cell"):
                for i in size:
                    near = part[part["near"].to_numpy() >= need[j, i]]
                    if near.empty:
                        continue
                    own = block_of(near["pid"], right_blocks[i])
                    for b in range(left_blocks[i]):
                        yield near[["pid", "x"]].assign(cell=i, lb=b, rb=own)

    shape = "pid string, x array<double>, cell int, lb int, rb int"
    left = placed.mapInPandas(spread_left, shape).groupBy("cell", "lb", "rb")
    right = placed.mapInPandas(spread_right, shape).groupBy("cell", "lb", "rb")
    found = left.cogroup(right).applyInPandas(block_candidates(k), "pid string, nid string, distance double")
    best = Window.partitionBy("pid").orderBy("distance", "nid")
    return found.withColumn("_rn", F.row_number().over(best)).filter(F.col("_rn") <= k).drop("_rn")


def nearest(df: DataFrame, id_col: str, vector: str, k: int = 5, block_rows: int | None = None) -> DataFrame:
    """``(id, neighbour, rank, distance)``: the ``k`` nearest other rows of each row, ties by id as text."""
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    rows = rows.withColumn("point", F.md5(F.to_json("x")))
    by_id = Window.partitionBy("point").orderBy("id")
    # The first k + 1 ids of each point are all that any row can need; the first one stands for the point.
    heads = rows.withColumn("_rn", F.row_number().over(by_id)).filter(F.col("_rn") <= k + 1)
    heads = heads.withColumn("pid", F.min("id").over(Window.partitionBy("point")))
    firsts = heads.filter(F.col("_rn") == 1)
    ids = heads.select("pid", "id")
    near = _distinct_neighbours(firsts.select("pid", "x"), k, block_rows)
    others = near.join(ids.withColumnRenamed("pid", "nid"), "nid").select("pid", "id", "distance")
    own = ids.select("pid", "id", F.lit(0.0).alias("distance"))
    order = Window.partitionBy("pid").orderBy("distance", "id")
    short = own.unionByName(others).withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= k + 1)
    short = short.groupBy("pid").agg(F.sort_array(F.collect_list(F.struct("distance", "id"))).alias("near"))
    short = short.join(firsts.select("pid", "point"), "pid").select("point", "near")
    joined = rows.select("id", "point").join(short, "point")
    mine = F.slice(F.filter("near", lambda c: c["id"] != F.col("id")), 1, k)
    ranked = joined.select("id", F.posexplode(mine).alias("pos", "c"))
    return ranked.select("id", F.col("c.id").alias("neighbour"), (F.col("pos") + 1).alias("rank"), "c.distance")
