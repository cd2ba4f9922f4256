"""Order-dependent building blocks that never put a whole key, or the whole table, in one task.

A plain ``Window.partitionBy(card)`` sends every row of a busy card to one task. The helpers here cut the
order into chunks, work inside (key, chunk), and carry a one-row summary per chunk across the cuts:

* ``spread_chunks``  - look-back limited to a time span: rows near a cut are copied into the next chunk;
* ``previous_value`` - look-back of unlimited span: the last value of each chunk is carried over;
* ``running_totals`` - prefix sums: the total of each chunk is carried over;
* ``ranked_totals``  - prefix sums over distinct values, in equal-depth buckets of the value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_WINDOWS = 8
CHUNK_ROWS = 1 << 20


#: Distinct values that one task ranks.
BUCKET_VALUES = 20_000


def chunk_of(ms: Column, chunk_ms: int) -> Column:
    return F.floor(ms / F.lit(chunk_ms))


def spread_chunks(df: DataFrame, ms: str, within_ms: int, chunk_ms: int | None = None) -> tuple[DataFrame, int]:
    """Add ``chunk``: the row's own chunk, plus each later chunk whose start is less than ``within_ms`` away.

    Inside one (key, chunk) group every row of the chunk then sees all rows less than ``within_ms`` before it.
    With the default chunk length of eight windows about one row in eight is copied. A shorter chunk gives more,
    smaller groups per key at the price of more copies.
    """
    if within_ms < 1:
        raise ValueError("within_ms must be positive")
    chunk_ms = chunk_ms or within_ms * CHUNK_WINDOWS
    first = chunk_of(F.col(ms), chunk_ms)
    last = chunk_of(F.col(ms) + F.lit(within_ms - 1), chunk_ms)
    return df.withColumn("chunk", F.explode(F.sequence(first, last))), chunk_ms


def previous_value(
    df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[str], value: str, out: str
) -> DataFrame:
    """``lag(value)`` per key in ``order``; ``chunk`` must never decrease along the order.

    Only chunk summaries (one row per key and chunk) are lagged without a chunk in the partition key.
    """
    keys = list(keys)
    rows = df.withColumn("_chunk", chunk)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    rows = rows.withColumn("_prev", F.lag(F.struct(value)).over(inside))
    lasts = rows.groupBy(*keys, "_chunk").agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_chunk")
    carried = lasts.select(*keys, "_chunk", F.lag("_last").over(across).alias("_carried"))
    joined = rows.join(carried, [*keys, "_chunk"], "left")
    return joined.withColumn(out, F.coalesce("_prev", "_carried")[value]).drop("_chunk", "_prev", "_carried")


def running_totals(
    df: DataFrame, chunk: Column, order: Sequence[str | Column], values: dict[str, Column], keys: Sequence[str] = ()
) -> DataFrame:
    """Running sums, current row included, of ``values`` in ``order``; ``chunk`` never decreases along it."""
    keys = list(keys)
    rows = df.withColumns({"_chunk": chunk, **{f"_v_{n}": c for n, c in values.items()}})
    totals = rows.groupBy(*keys, "_chunk").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_chunk", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in values]
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_r_{n}": F.sum(f"_v_{n}").over(inside) for n in values})
    joined = rows.join(offsets, [*keys, "_chunk"])
    out = joined.withColumns({n: F.col(f"_r_{n}") + F.col(f"_o_{n}") for n in values})
    return out.drop("_chunk", *[f"_{p}_{n}" for n in values for p in ("v", "r", "o")])


def bucket_count(df: DataFrame, value: str, depth: int = BUCKET_VALUES) -> int:
    """Buckets of about ``depth`` distinct values each: their number grows with the values, not their size."""
    found = df.agg(F.approx_count_distinct(F.col(value).cast("double"))).first()[0] or 0
    return max(2, -(-found // depth))


def depth_cuts(df: DataFrame, value: str, buckets: int) -> list[float]:
    """Strictly increasing inner cut points of ``value`` at about equal depth (at most ``buckets - 1`` numbers)."""
    probs = [i / buckets for i in range(1, buckets)]
    cuts = df.select(F.percentile_approx(F.col(value).cast("double"), probs, buckets * 10)).first()[0]
    return sorted(set(cuts or []))


def ranked_totals(
    df: DataFrame,
    value: str,
    counts: dict[str, Column],
    keys: Sequence[str] = (),
    descending: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """One row per distinct ``value`` (and key) with each count, and ``cum_<count>`` up to and including it.

    Ties are added up before any shuffle by value, so a single very frequent value costs one row. The distinct
    values are then cut at approximate quantiles; where a cut falls changes the load, never the result.
    """
    keys = list(keys)
    splits = [float("-inf"), *depth_cuts(df, value, buckets or bucket_count(df, value)), float("inf")]
    distinct = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias(value))
        .agg(*[F.sum(c).alias(n) for n, c in counts.items()])
    )
    bucketed = Bucketizer(splits=splits, inputCol=value, outputCol="_bucket", handleInvalid="keep").transform(distinct)
    bucket = F.col("_bucket") * F.lit(-1 if descending else 1)
    order = [F.col(value).desc() if descending else F.col(value).asc()]
    return running_totals(bucketed, bucket, order, {f"cum_{n}": F.col(n) for n in counts}, keys).drop("_bucket")


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation: columns ``q`` and ``value`` per key.

    Works from ranks of distinct values, so no task holds all values of a group.
    """
    keys = list(keys)
    ranked = ranked_totals(df, value, {"n": F.lit(1)}, keys)
    if keys:
        ranked = ranked.join(ranked.groupBy(*keys).agg(F.sum("n").alias("_size")), keys)
    else:
        # One row: the size of the whole input.
        size = ranked.agg(F.sum("n").alias("_size")).withColumn("_all", F.lit(0))
        ranked = ranked.withColumn("_all", F.lit(0)).join(F.broadcast(size), "_all").drop("_all")
    ranked = ranked.withColumn("q", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    pos = F.col("q") * (F.col("_size") - 1)
    below, upto = F.col("cum_n") - F.col("n"), F.col("cum_n")
    holds_low = (below <= F.floor(pos)) & (F.floor(pos) < upto)
    holds_high = (below <= F.ceil(pos)) & (F.ceil(pos) < upto)
    ends = (
        ranked.filter(holds_low | holds_high)
        .groupBy(*keys, "q")
        .agg(
            F.max(F.when(holds_low, F.col(value))).alias("_low"),
            F.max(F.when(holds_high, F.col(value))).alias("_high"),
            F.max(pos - F.floor(pos)).alias("_frac"),
        )
    )
    return ends.select(*keys, "q", (F.col("_low") + F.col("_frac") * (F.col("_high") - F.col("_low"))).alias("value"))
