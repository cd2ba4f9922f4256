"""Near-duplicate vectors by binary codes under random rotations, with stored correction factors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnguard.llm.graph import components
from txnguard.workdir import materialize

COSINE = 0.98
#: Chance that a pair of exactly this cosine shares no band; closer pairs are missed less.
MISS = 1e-5
#: Standard deviations that an estimate may lie below the threshold before a pair is dismissed.
SIGMAS = 5.0
SEED = 20_240_501
#: Rows of one band compared in one piece; a band value with more rows is cut into blocks, compared two by two.
BLOCK = 4096
STEPS = 8  # sizes that a coordinate of a query is rounded to, besides its sign


@cache
def rotation(dim: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, always the same for a dimension and number."""
    q, r = np.linalg.qr(np.random.default_rng((SEED, dim, number)).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def bands(n: int, cosine: float = COSINE) -> tuple[int, int]:
    """Bits of a band and number of bands. Bits grow with the logarithm of the number of vectors, so that the vectors that
    share a band by chance stay about as many; the number of bands follows from the chance of a miss."""
    bits = int(np.clip(math.ceil(math.log2(max(n, 2))) - 2, 6, 60))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-same))


def encode(unit: np.ndarray, bits: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Band values, 4-bit rotated vectors, their scales and the codes' correction factors, for rows of unit length.

    The code of a vector is the signs of its rotated coordinates; the factor is the inner product of the vector and its
    code, both of unit length. The code's inner product with another vector, divided by the factor, is an unbiased
    estimate of the two vectors' inner product."""
    dim = unit.shape[1]
    turned = [unit @ rotation(dim, k).T for k in range(-(-bits * count // dim))]
    signs = np.concatenate([t > 0 for t in turned], axis=1)[:, : bits * count].reshape(len(unit), count, bits)
    values = signs.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))
    first = turned[0]
    scale = np.abs(first).max(axis=1)
    size = np.minimum(np.abs(first) / np.where(scale > 0, scale, 1)[:, None] * STEPS, STEPS - 1).astype(np.uint8)
    nibbles = size | ((first > 0).astype(np.uint8) << 3)
    if dim % 2:
        nibbles = np.concatenate((nibbles, np.zeros((len(unit), 1), np.uint8)), axis=1)
    return values, nibbles[:, ::2] | nibbles[:, 1::2] << 4, scale, np.abs(first).sum(axis=1) / math.sqrt(dim)


def decode(packed: np.ndarray, scale: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Signs (unit length) and rounded rotated vectors of packed rows."""
    nibbles = np.stack((packed & 15, packed >> 4), axis=2).reshape(len(packed), -1)[:, :dim]
    sign = np.where(nibbles & 8, 1.0, -1.0).astype(np.float32)
    return sign / np.float32(math.sqrt(dim)), sign * ((nibbles & 7) + 0.5) / STEPS * scale[:, None].astype(np.float32)


def may_reach(code: np.ndarray, factor: np.ndarray, query: np.ndarray, scale: np.ndarray, cosine: float = COSINE) -> np.ndarray:
    """Which pairs (rows of codes by rows of queries) cannot be dismissed: the estimate plus its bound reaches the
    threshold. A pair of that cosine has an estimate that scatters by ``sqrt((1-f^2)/f^2 (1-cosine^2)/(dim-1))`` around
    it, and rounding scatters the query by a twelfth of a squared step per coordinate."""
    dim = code.shape[1]
    estimate = (code @ query.T) / factor[:, None]
    own = (1 - factor**2) * (1 - cosine**2) / max(dim - 1, 1)
    rounding = (scale / STEPS) ** 2 / 12
    bound = SIGMAS * np.sqrt(np.maximum(own[:, None], 0) + rounding[None, :]) / factor[:, None]
    return estimate + bound + 1e-6 >= cosine


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def by_dimension(column: pa.Array) -> Iterator[np.ndarray]:
    """Row numbers of each length of the lists."""
    lengths = np.array([len(x) for x in column])
    for dim in np.unique(lengths):
        yield np.flatnonzero(lengths == dim)


def unit_rows(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


SIGNED = "label int, dim int, band int, value long, key long, codes binary, scale double, factor double, others binary"


def signatures(vectors: DataFrame, bits: int, count: int) -> DataFrame:
    """A row per vector and band, with its code, factor, rounded query, and the values of all its bands."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                for rows in by_dimension(part.column("embedding")):
                    own = part.take(pa.array(rows))
                    m = unit_rows(matrix(own.column("embedding")))
                    values, packed, scale, factor = encode(m, bits, count)
                    n = len(rows)
                    each = np.repeat(np.arange(n), count)
                    codes, others = [p.tobytes() for p in packed], [v.tobytes() for v in values]
                    arrays = [
                        own.column("label").take(pa.array(each)), pa.array(np.full(n * count, m.shape[1], np.int32)),
                        pa.array(np.tile(np.arange(count, dtype=np.int32), n)), pa.array(values.ravel()), own.column("key").take(pa.array(each)),
                        pa.array([codes[i] for i in each], pa.binary()), pa.array(scale[each]), pa.array(factor[each]), pa.array([others[i] for i in each], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(arrays, [f.split(" ")[0] for f in SIGNED.split(", ")])

    return vectors.select("key", "label", "embedding").mapInArrow(of, SIGNED)


class Run:
    """The rows of one band value (and block pair): arrays to compare."""

    def __init__(self, rows: pa.Table) -> None:
        rows = rows.combine_chunks()
        self.key = rows.column("key").to_numpy()
        self.home = rows.column("home").to_numpy()
        self.factor, self.scale = rows.column("factor").to_numpy(), rows.column("scale").to_numpy()
        dim = rows.column("dim")[0].as_py()
        packed = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(len(self.key), -1)
        self.values = np.frombuffer(b"".join(rows.column("others").to_pylist()), np.int64).reshape(len(self.key), -1)
        self.code, self.query = decode(packed, self.scale, dim)

    def pairs(self, band: int, left: int, right: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs that may link, none that an earlier band has given already; between two blocks only pairs across."""
        a, b = np.flatnonzero(self.home == left), np.flatnonzero(self.home == right)
        for at in range(0, len(a), 512):
            own = a[at : at + 512]
            i, j = np.nonzero(may_reach(self.code[own], self.factor[own], self.query[b], self.scale[b]))
            i, j = own[i], b[j]
            once = (self.key[i] < self.key[j]) if left == right else np.ones(len(i), bool)
            i, j = i[once], j[once]
            for k in range(0, len(i), 65_536):
                x, y = i[k : k + 65_536], j[k : k + 65_536]
                new = ~(self.values[x, :band] == self.values[y, :band]).any(axis=1) if band else np.ones(len(x), bool)
                if new.any():
                    yield np.minimum(self.key[x], self.key[y])[new], np.maximum(self.key[x], self.key[y])[new]


def candidates(signed: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs ``(a, b)`` of keys that share a band value and whose estimate does not rule out a link, each once.

    Values that more than ``block`` rows share are cut into blocks by the rows' keys, and every two blocks meet in a
    group of their own. So a task holds two blocks at most, and no pair is left out."""
    where = ["label", "dim", "band", "value"]
    crowded = signed.groupBy(*where).agg(F.count("*").alias("n")).filter(F.col("n") > block)
    crowded = crowded.select(*where, F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    rows = signed.join(crowded, where, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("home", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"left": F.least("home", "other"), "right": F.greatest("home", "other")})
    where += ["left", "right"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        group = None

        def close() -> Iterator[pa.RecordBatch]:
            if sum(h.num_rows for h in held) > 1:
                run = Run(pa.Table.from_batches(held))
                for a, b in run.pairs(group[2], group[4], group[5]):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            names = [batch.column(c).to_numpy(zero_copy_only=False) for c in where]
            change = np.zeros(max(batch.num_rows - 1, 0), bool)
            for x in names:
                change |= x[1:] != x[:-1]
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s == e:
                    continue
                this = tuple(int(x[s]) for x in names)
                if this != group:
                    yield from close()
                    group, held = this, []
                held.append(batch.slice(s, e - s))
        yield from close()

    dealt = rows.repartition(*where).sortWithinPartitions(*where)
    return dealt.select(*where, "key", "home", "codes", "scale", "factor", "others").mapInArrow(of, "a long, b long")


def exact(pairs: DataFrame, vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """The pairs whose cosine in double precision reaches the threshold."""
    one = vectors.select(F.col("key").alias("a"), F.col("embedding").alias("x"))
    two = vectors.select(F.col("key").alias("b"), F.col("embedding").alias("y"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                for rows in by_dimension(part.column("x")):
                    own = part.take(pa.array(rows))
                    x, y = unit_rows(matrix(own.column("x"))), unit_rows(matrix(own.column("y")))
                    near = np.einsum("ij,ij->i", x, y) >= cosine
                    yield own.select(["a", "b"]).filter(pa.array(near))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(of, "a long, b long")


def near_duplicates(embeddings: DataFrame, block: int = BLOCK) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` for each row of ``embeddings(vec_id, embedding, label)``.

    Vectors of one label and length link if their cosine is at least 0.98. Candidates share a band of bits; a pair whose
    code estimate lies below the threshold by more than its bound is dismissed, all others are computed in full. Equal
    vectors of a label are folded first and link with each other.

    Null labels, null, empty or zero vectors and those with null or non-finite components link with nothing. A null
    vec_id takes part; a component without any vec_id has a null component_id, and is kept. Repeated rows count as
    links of each other. Other columns are not read. An empty table gives no rows.
    """
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.col("label").cast("int"))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    fit = F.col("label").isNotNull() & F.coalesce(F.forall("embedding", number) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    valid = rows.filter(fit)
    folded = valid.groupBy("label", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    folded = materialize(folded.withColumn("key", F.monotonically_increasing_id()), "vectors")
    bits, count = bands(folded.count())
    links = materialize(exact(candidates(signatures(folded, bits, count), block), folded), "vector-links")
    both = links.union(links.select("b", "a"))
    weight = folded.select(F.col("key").alias("b"), "copies")
    n_links = both.join(weight, "b").groupBy("a").agg(F.sum("copies").alias("n")).withColumnRenamed("a", "key")
    label = components(links).select(F.col("node").alias("key"), F.col("label").alias("root"))
    known = folded.join(n_links, "key", "left").join(label, "key", "left")
    known = known.select(
        F.col("label").alias("_label"), F.col("embedding").alias("_embedding"), "first", F.coalesce("root", "key").alias("root"),
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    known = known.join(least, "root").select("_label", "_embedding", "n_links", "component_id")
    linked = valid.join(known, (valid["label"] == F.col("_label")) & (valid["embedding"] == F.col("_embedding")))
    linked = linked.select("vec_id", "n_links", "component_id")
    alone = rows.filter(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
