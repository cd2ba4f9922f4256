"""Boosted trees from histograms: quantile bins, gradient sums per level added up by Spark, columns drawn per tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnguard.ml import metrics
from txnguard.workdir import materialize

BINS = 64
ACCURACY = 10_000
#: Rows of a block. The rows of one block are held by a task at a time, a byte per feature.
BLOCK_ROWS = 1 << 16
#: Rows of a block where there are several, as long as that gives every core a block.
LEAST_BLOCK = 1 << 13
#: Tasks whose histograms, a table of fixed size each, the driver adds up; those of more are added up by groups first.
MOST_TABLES = 32
#: Rounds after which the blocks are written anew with their margins; until then tasks apply the trees since, once a tree.
ROUNDS_HELD = 10
#: Gradients are whole numbers of this unit, so that their sums do not depend on the order of adding.
UNIT = float(1 << 24)
LAMBDA = 1.0
LEAST_WEIGHT = 1.0
LEAST_GAIN = 1e-6
DEFAULTS = {"rounds": 300, "depth": 6, "rate": 0.05, "row_share": 0.8, "feature_share": 0.8, "seed": 42}
BLOCK_SCHEMA = "bins binary, y binary, rid binary, margin binary"


@dataclass(frozen=True)
class Tree:
    """Nodes in heap order (children of i: 2 i + 1 and 2 i + 2). ``feature`` is -1 at leaves; a row goes left if its bin is at
    most ``at``."""

    feature: np.ndarray
    at: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return Tree(np.full(n, -1, np.int16), np.zeros(n, np.uint8), np.zeros(n), np.zeros(n))

    def places(self, bins: np.ndarray) -> np.ndarray:
        """The node in which each row of bins ends."""
        node, every = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(int(np.log2(len(self.feature) + 1)) - 1):
            f = self.feature[node]
            node = np.where(f >= 0, 2 * node + 1 + (bins[every, f] > self.at[node]), node)
        return node

    def margins(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.places(bins)]


@dataclass
class Model:
    edges: list[np.ndarray]
    trees: list[Tree] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """The number of a feature's edges below each value; a value that is no number counts as the least."""
        out = [np.searchsorted(e, np.where(np.isnan(x[:, j]), -np.inf, x[:, j]), "left") for j, e in enumerate(self.edges)]
        return np.array(out, np.uint8).T.reshape(len(x), len(self.edges))

    def probability(self, x: np.ndarray) -> np.ndarray:
        bins, margin = self.bins(x), np.zeros(len(x))
        for tree in self.trees:
            margin += tree.margins(bins)
        return 1 / (1 + np.exp(-margin))

    def probability_column(self, spark: SparkSession, vector: Column) -> Column:
        """The probability of class 1 from an array column, in Arrow batches; null stays null."""
        shared = spark.sparkContext.broadcast(self)  # trees of a fixed size, whatever the number of rows

        @F.pandas_udf("double")
        def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                out, known = np.full(len(batch), np.nan), batch.notna().to_numpy()
                if known.any():
                    out[known] = shared.value.probability(np.array(batch[known].tolist(), float))
                yield pd.Series(out)

        return F.nanvl(of(vector), F.lit(None).cast("double"))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [
            (k, i, int(t.feature[i]), int(t.at[i]), float(t.value[i]), float(t.gain[i]))
            for k, t in enumerate(self.trees) for i in range(len(t.feature))
        ]
        spark.createDataFrame(rows, "tree int, node int, feature int, at int, value double, gain double").write.mode("overwrite").parquet(f"{path}/trees")
        edges = [(j, e.tolist()) for j, e in enumerate(self.edges)]
        spark.createDataFrame(edges, "feature int, edges array<double>").write.mode("overwrite").parquet(f"{path}/edges")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        edges = [np.array(r.edges, float) for r in spark.read.parquet(f"{path}/edges").orderBy("feature").collect()]
        rows = spark.read.parquet(f"{path}/trees").toPandas().sort_values(["tree", "node"])
        kinds = {"feature": np.int16, "at": np.uint8, "value": float, "gain": float}
        return Model(edges, [Tree(*[t[c].to_numpy(k) for c, k in kinds.items()]) for _, t in rows.groupby("tree")])


# --- bins and blocks ---------------------------------------------------------------------------------------------------


def quantile_edges(rows: DataFrame, vector: str, bins: int = BINS) -> list[np.ndarray]:
    """For each feature the values at the inner quantiles; fewer where they are equal."""
    shares = [k / bins for k in range(1, bins)]
    long = rows.select(F.posexplode(vector).alias("feature", "x")).filter(~F.isnan("x"))
    found = long.groupBy("feature").agg(F.percentile_approx("x", shares, ACCURACY).alias("edges")).collect()
    known = {r.feature: np.unique(np.array(r.edges, float)) for r in found}
    return [known.get(j, np.zeros(0)) for j in range(max(known, default=-1) + 1)]


def blocks(rows: DataFrame, id_col: str, label: str, vector: str, model: Model, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """``rows`` as written blocks of bins, labels, row hashes and margins, and the number of blocks."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def block() -> pa.RecordBatch:
            bins, y, rid = (np.concatenate(c) for c in zip(*held, strict=True))
            made = [b.tobytes() for b in (bins, y, rid, np.zeros(len(y)))]
            return pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in made], [c.split(" ")[0] for c in BLOCK_SCHEMA.split(", ")])

        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                part = batch.slice(at, block_rows)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, -1)
                own = (model.bins(x), part.column("y").to_numpy(zero_copy_only=False).astype(np.int8), part.column("rid").to_numpy(zero_copy_only=False))
                if held and sum(len(h[1]) for h in held) + part.num_rows > block_rows:
                    yield block()
                    held = []
                held.append(own)
        if held:
            yield block()

    n = rows.count()
    plain = rows.select(F.xxhash64(F.col(id_col).cast("string")).alias("rid"), F.col(label).cast("int").alias("y"), F.col(vector).alias("x"))
    least = -(-n // block_rows)
    if least > 1:
        least = max(least, min(rows.sparkSession.sparkContext.defaultParallelism, n // LEAST_BLOCK))
    dealt = plain.repartition(max(1, least), "rid")
    made = materialize(dealt.mapInArrow(of, BLOCK_SCHEMA), "boost-blocks")
    return made, made.count()


class Rows:
    """One block in a task, with its margins after the given trees."""

    def __init__(self, block: dict, trees: list[Tree]) -> None:
        self.y, self.rid = np.frombuffer(block["y"], np.int8), np.frombuffer(block["rid"], np.int64).view(np.uint64)
        self.bins = np.frombuffer(block["bins"], np.uint8).reshape(len(self.y), -1)
        self.margin = np.frombuffer(block["margin"], float).copy()
        for tree in trees:
            self.margin += tree.margins(self.bins)

    def gradients(self) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-self.margin))
        return np.rint((p - self.y) * UNIT), np.rint(p * (1 - p) * UNIT)

    def drawn(self, number: int, share: float, seed: int) -> np.ndarray:
        """Which rows the tree of this number learns from; the same wherever a row is stored."""
        h = self.rid ^ np.uint64((number * 0x9E3779B97F4A7C15 + seed * 0xBF58476D1CE4E5B9) % 2**64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (h >> np.uint64(11)).astype(float) < share * 2.0**53


@dataclass(frozen=True)
class Drawn:
    """What a tree learns from one block: the drawn rows' bins, a line for each drawn column, and their gradients."""

    bins: np.ndarray
    g: np.ndarray
    h: np.ndarray

    @staticmethod
    def of(rows: Rows, number: int, columns: np.ndarray, s: dict) -> Drawn:
        used = np.flatnonzero(rows.drawn(number, s["row_share"], s["seed"]))
        g, h = rows.gradients()
        return Drawn(np.ascontiguousarray(rows.bins[used][:, columns].T), g[used], h[used])

    def nodes(self, tree: Tree, first: int, columns: np.ndarray) -> np.ndarray:
        """The node in which each row is at the level that begins with ``first``, or an earlier one if that is a leaf."""
        node, every = np.zeros(len(self.g), np.int64), np.arange(len(self.g))
        line = np.searchsorted(columns, tree.feature)  # a tree splits by drawn columns only
        for _ in range(int(first + 1).bit_length() - 1):
            f = tree.feature[node]
            node = np.where(f >= 0, 2 * node + 1 + (self.bins[np.minimum(line[node], len(columns) - 1), every] > tree.at[node]), node)
        return node

    def histogram(self, tree: Tree, first: int, columns: np.ndarray) -> np.ndarray:
        """Sums of gradients and second derivatives by (column, which sum, node of the level, bin)."""
        node, slots = self.nodes(tree, first, columns), first + 1
        on = np.flatnonzero(node >= first)
        base, g, h = (node[on] - first) * BINS, self.g[on], self.h[on]
        out = np.empty((len(columns), 2, slots * BINS))
        for k, line in enumerate(self.bins):
            place = base + line[on]
            out[k, 0] = np.bincount(place, g, minlength=slots * BINS)
            out[k, 1] = np.bincount(place, h, minlength=slots * BINS)
        return out.reshape(len(columns), 2, slots, BINS)


# --- trees -------------------------------------------------------------------------------------------------------------


def drawn_columns(features: int, share: float, seed: int, number: int) -> np.ndarray:
    size = max(1, round(share * features))
    return np.sort(np.random.default_rng([seed, number]).choice(features, size, replace=False))


def set_splits(tree: Tree, first: int, sums: np.ndarray, columns: np.ndarray, rate: float) -> bool:
    """Splits the nodes of the level that begins with ``first`` where that gains; children get their values. Of equal gains
    the first column and bin count. Whether anything was split."""
    gl, hl = np.cumsum(sums, axis=3).transpose(1, 2, 0, 3) / UNIT
    g, h = gl[:, :1, -1:], hl[:, :1, -1:]
    gr, hr = g - gl, h - hl
    gain = (gl**2 / (hl + LAMBDA) + gr**2 / (hr + LAMBDA) - g**2 / (h + LAMBDA)) / 2
    gain = np.where((hl >= LEAST_WEIGHT) & (hr >= LEAST_WEIGHT), gain, -np.inf)
    if not first:
        tree.value[0] = -rate * g[0, 0, 0] / (h[0, 0, 0] + LAMBDA)
    split = False
    for slot in range(len(gain)):
        node = first + slot
        k, b = np.unravel_index(gain[slot].argmax(), gain[slot].shape)
        if gain[slot, k, b] > LEAST_GAIN:
            split = True
            tree.feature[node], tree.at[node], tree.gain[node] = columns[k], b, gain[slot, k, b]
            tree.value[2 * node + 1] = -rate * gl[slot, k, b] / (hl[slot, k, b] + LAMBDA)
            tree.value[2 * node + 2] = -rate * gr[slot, k, b] / (hr[slot, k, b] + LAMBDA)
    return split


def grow(number: int, features: int, s: dict, level: Callable[[Tree, int, np.ndarray], np.ndarray]) -> Tree:
    """One tree; ``level(tree, first, columns)`` gives the histograms of the level that begins with node ``first``."""
    tree, columns = Tree.empty(s["depth"]), drawn_columns(features, s["feature_share"], s["seed"], number)
    for depth in range(s["depth"]):
        first = 2**depth - 1
        if not set_splits(tree, first, level(tree, first, columns), columns, s["rate"]):
            break
    return tree


def drawn_blocks(held: RDD, since: list[Tree], number: int, columns: np.ndarray, s: dict) -> RDD:
    """What the tree of this number learns from, block by block; kept in the executors while the tree grows."""
    made = held.map(lambda block: Drawn.of(Rows(block, since), number, columns, s))
    return made.persist(StorageLevel.MEMORY_AND_DISK)


def level_sums(drawn: RDD, tree: Tree, first: int, columns: np.ndarray) -> np.ndarray:
    """A level's histograms over all blocks: each task adds up its own, Spark adds up the tasks, by groups where they are many."""

    def of(blocks: Iterator[Drawn]) -> Iterator[np.ndarray]:
        total = None
        for block in blocks:
            own = block.histogram(tree, first, columns)
            total = own if total is None else total + own
        return iter(()) if total is None else iter([total])

    tasks = drawn.getNumPartitions()
    return drawn.mapPartitions(of).treeReduce(np.add, 1 if tasks <= MOST_TABLES else 2)


def grown_in_task(made: DataFrame, since: list[Tree], begin: int, count: int, features: int, s: dict) -> list[Tree]:
    """The next trees of a table that is one block: its task sees every histogram whole and needs no other."""
    fields = ("feature", "at", "value", "gain")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                rows, out = Rows(block, since), []
                for number in range(begin, begin + count):
                    drawn = Drawn.of(rows, number, drawn_columns(features, s["feature_share"], s["seed"], number), s)
                    tree = grow(number, features, s, drawn.histogram)
                    rows.margin += tree.margins(rows.bins)
                    out.append({"number": number, **{f: getattr(tree, f).tobytes() for f in fields}})
                yield pa.RecordBatch.from_pylist(out)

    found = made.mapInArrow(of, "number long, feature binary, at binary, value binary, gain binary").collect()
    kinds = (np.int16, np.uint8, float, float)
    return [Tree(*[np.frombuffer(bytes(r[f]), k) for f, k in zip(fields, kinds, strict=True)]) for r in sorted(found, key=lambda r: r.number)]


def grown_over_blocks(made: DataFrame, begin: int, count: int, features: int, s: dict) -> list[Tree]:
    """The next trees of a table of many blocks: a Spark job per level."""
    held, since = made.rdd.map(lambda row: row.asDict()).persist(StorageLevel.MEMORY_AND_DISK), []
    for number in range(begin, begin + count):
        drawn = drawn_blocks(held, list(since), number, drawn_columns(features, s["feature_share"], s["seed"], number), s)
        since.append(grow(number, features, s, lambda t, first, columns, drawn=drawn: level_sums(drawn, t, first, columns)))
        drawn.unpersist()
    held.unpersist()
    return since


def with_margins(made: DataFrame, since: list[Tree]) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([block | {"margin": Rows(block, since).margin.tobytes()}], batch.schema)

    return materialize(made.mapInArrow(of, BLOCK_SCHEMA), "boost-blocks")


def fit(rows: DataFrame, id_col: str, label: str, vector: str, block_rows: int = BLOCK_ROWS, **changes) -> Model:
    """A model of all ``rows``: ``vector`` is an array column of equal lengths, ``label`` 0 or 1.

    Logistic loss with second derivatives, starting at probability one half. Features are cut into BINS quantile bins.
    For each tree a share of the columns and a share of the rows, by a hash of their ids, is drawn; their bins and
    gradients stay in the executors (on their disks, where memory is short) while the tree grows. Per level, one job: tasks
    sum up gradients by node, column and bin, Spark adds up the tasks' sums, and the driver, which holds edges and trees
    only, chooses the splits. Sums are of whole numbers, so the same rows give the same trees, however they are stored
    and whichever task runs twice. Where all rows are one block, its task goes on from level to level by itself.

    No rows give a model without trees, as do rows of one class after their leaves have run out of weight.
    """
    s = DEFAULTS | changes
    model = Model(quantile_edges(rows, vector))
    if not model.edges:
        return model
    made, parts = blocks(rows, id_col, label, vector, model, block_rows)
    while len(model.trees) < s["rounds"]:
        count, begin = min(ROUNDS_HELD, s["rounds"] - len(model.trees)), len(model.trees)
        if parts == 1:
            since = grown_in_task(made, [], begin, count, len(model.edges), s)
        else:
            since = grown_over_blocks(made, begin, count, len(model.edges), s)
        model.trees += since
        if len(model.trees) < s["rounds"]:
            made = with_margins(made, since)
    return model


def round_log(model: Model, rows: DataFrame, id_col: str, label: str, vector: str, every: int = 1) -> DataFrame:
    """``round``, ``log_loss`` and ``auprc`` (average precision) on ``rows``, after every so many trees and after the last."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    wanted = sorted({*range(every, len(model.trees) + 1, every), len(model.trees)} - {0})

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, -1)
                bins, margin = own.bins(x), np.zeros(part.num_rows)
                for k, tree in enumerate(own.trees):
                    margin += tree.margins(bins)
                    if k + 1 in wanted:
                        p = pa.array(1 / (1 + np.exp(-margin)))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(margin), k + 1, np.int32)), part.column("y"), p], ["round", "y", "p"])

    plain = rows.select(F.col(label).cast("int").alias("y"), F.col(vector).alias("x"))
    staged = materialize(plain.mapInArrow(of, "round int, y int, p double"), "boost-staged")
    loss = -F.avg(F.when(F.col("y") == 1, F.log("p")).otherwise(F.log(1 - F.col("p"))))
    precision = metrics.ranking_metrics(staged, "p", "y", ["round"]).select("round", "auprc")
    return staged.groupBy("round").agg(loss.alias("log_loss")).join(precision, "round")
