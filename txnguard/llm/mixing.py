"""Mixing sources to target weights by balanced sampling with the cube method."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnguard.llm.columns import fresh, only
from txnguard.workdir import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Rows whose probabilities move together; each leaves two of a source at most to the landing.
BLOCK_ROWS = 4096
CLOSE = 1e-9


def words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(rows: DataFrame) -> DataFrame:
    """``(source, source_size, target)``: what each source should give, from ``rows(source, size)``.

    Sources in the order of their names' code points, null last, take the weights in turn. All targets together are
    ``SHARE`` of all sizes; none is above ``MOST`` times its source's size, and what one cannot take goes to the others
    by weight. One row per source is kept and nothing else is collected than four sums and a number per partition.
    """
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    part, place = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    order = [F.col("source").isNull(), F.col("source")]
    ordered = totals.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = materialize(ordered.withColumns({"part": part, "place": place}), "mix-sources")
    before, offsets = 0, []
    for r in ordered.groupBy("part").count().orderBy("part").collect():
        offsets.append((r.part, before))
        before += r["count"]
    shift = rows.sparkSession.createDataFrame(offsets, "part int, before long")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("place") + F.col("before")) % len(WEIGHTS) + 1).cast("int"))
    weighted = ordered.join(F.broadcast(shift), "part").select("source", "source_size", weight.alias("weight"))
    most = MOST * F.col("source_size")
    rate, capped = 0.0, None
    while True:
        full = most < rate * F.col("weight") if capped is not None else F.lit(False)
        sums = weighted.agg(
            F.sum("source_size").alias("every"), F.count(F.when(full, 1)).alias("capped"),
            F.sum(F.when(full, most)).alias("taken"), F.sum(F.when(~full, F.col("weight"))).alias("open"),
        ).first()
        if sums.capped == capped or not sums.every or not sums.open:
            break
        rate, capped = (SHARE * sums.every - (sums.taken or 0)) / sums.open, sums.capped
    target = F.least(most.cast("double"), F.lit(float(rate)) * F.col("weight"))
    return weighted.select("source", "source_size", target.alias("target"))


class Flight:
    """Moves the probabilities of a group's rows to 0 or 1, one after the other, while sums of (size, 1) hold.

    Three undecided rows have a direction along which neither their expected size nor their expected number changes;
    two have one that keeps the size. A random step along it, without bias, decides one row at least.
    """

    def __init__(self, land: bool) -> None:
        self.land, self.active, self.rng = land, [], random.Random(0)

    def begin(self, group: str) -> None:
        self.rng = random.Random(group)

    def add(self, unit: list) -> list[list]:
        """``unit``: [size, probability, ..]; returns the units that are decided now."""
        self.active.append(unit)
        return self.step() if len(self.active) == 3 else []

    def end(self) -> list[list]:
        """What remains of a group: undecided, or, when landing, decided with the size kept while two are left and by
        chance for the last."""
        out, self.active = [], self.active
        while self.land and len(self.active) > 1:
            out += self.step()
        if self.land:
            for u in self.active:
                u[1] = float(self.rng.random() < u[1])
        out, self.active = out + self.active, []
        return out

    def step(self) -> list[list]:
        s, p = [u[0] for u in self.active], [u[1] for u in self.active]
        if len(p) == 3:
            u = [s[1] - s[2], s[2] - s[0], s[0] - s[1]]
            u = u if any(u) else [1, -1, 0]
        else:
            u = [s[1], -s[0]]
        up = min(((1 - x) / d if d > 0 else x / -d) for x, d in zip(p, u, strict=True) if d)
        down = min((x / d if d > 0 else (1 - x) / -d) for x, d in zip(p, u, strict=True) if d)
        move = up if self.rng.random() * (up + down) < down else -down
        done, left = [], []
        for unit, x, d in zip(self.active, p, u, strict=True):
            x += move * d
            unit[1] = 0.0 if x < CLOSE else 1.0 if x > 1 - CLOSE else x
            (left if 0 < unit[1] < 1 else done).append(unit)
        self.active = left
        return done


def fly(rows: DataFrame, land: bool) -> DataFrame:
    """``rows`` with their probabilities ``p`` moved, by runs of equal (block, source); three rows of a run are held at
    a time, whatever its length."""
    where = rows.columns.index("p")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flight, group = Flight(land), None

        def late(units: list[list], p: np.ndarray | None) -> Iterator[pa.RecordBatch]:
            """Decided rows of this batch get their probability; rows held from an earlier one are given now."""
            for size, x, at, held in units:
                if held is None:
                    p[at] = x
                else:
                    yield held.set_column(where, held.schema.field(where), pa.array([x]))

        for batch in batches:
            p = batch.column("p").to_numpy(zero_copy_only=False).copy()
            size, block, source = batch.column("size").to_pylist(), batch.column("block").to_pylist(), batch.column("source").to_pylist()
            for i in range(batch.num_rows):
                if group != (this := (block[i], source[i])):
                    yield from late(flight.end(), p)
                    group = this
                    flight.begin(repr(group))
                if 0 < p[i] < 1:
                    yield from late(flight.add([size[i], float(p[i]), i, None]), p)
            kept = np.ones(batch.num_rows, bool)
            for unit in flight.active:
                if unit[3] is None:
                    kept[unit[2]], unit[3] = False, batch.take(pa.array([unit[2]]))
            yield batch.set_column(where, batch.schema.field(where), pa.array(p)).filter(pa.array(kept))
        yield from late(flight.end(), None)

    return rows.mapInArrow(of, rows.schema)


def mix(rows: DataFrame) -> DataFrame:
    """``copies`` of each row of ``rows(key, source, size)``, and ``source_size`` and ``target`` of its source.

    A source whose target is r times its size takes each of its rows floor(r) times, and once more with the fraction as
    the inclusion probability. The cube method balances these draws: the words and the number of rows drawn stay at
    their expected sums in every block of rows, in blocks of what those leave undecided, and so on, and at last, in the
    landing of at most a block's rows, in every source but for about one row.
    Results depend on the rows alone, not on how they are stored: blocks and order follow key and size; equal rows are
    interchangeable. Rows without a word are never drawn.
    """
    sized = materialize(rows, "mix-sizes")
    targets = materialize(source_targets(sized), "mix-targets").withColumnRenamed("source", "_source")
    blocks = max(1, -(-sized.count() // BLOCK_ROWS))
    ratio = F.col("target") / F.col("source_size")
    known = sized.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    whole = F.when(F.col("size") > 0, F.floor(ratio + CLOSE)).otherwise(0).cast("long")
    part = F.when(F.col("size") > 0, ratio - F.floor(ratio + CLOSE)).otherwise(0.0)
    part = F.when(part < CLOSE, 0.0).otherwise(part)
    block = F.pmod(F.xxhash64("key", "size"), F.lit(blocks))
    known = known.withColumns({"base": whole, "p": part, "block": block})
    order = ["block", "source", "key", "size"]
    flown = materialize(fly(known.repartition("block").sortWithinPartitions(*order), land=False), "mix-flown")
    decided, undecided = flown.filter("p <= 0 or p >= 1"), flown.filter("p > 0 and p < 1")
    while True:  # a source's undecided rows become about two thousand times fewer with each level
        counts = undecided.groupBy("source").agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).alias("_parts")).withColumnRenamed("source", "_source")
        if (counts.agg(F.max("_parts")).first()[0] or 0) <= 1:
            break
        again = undecided.join(counts, F.col("source").eqNullSafe(F.col("_source"))).withColumn("block", F.pmod(F.xxhash64("size", "key"), F.col("_parts")))
        again = again.select(*flown.columns).repartition("source", "block").sortWithinPartitions(*order)
        flown = materialize(fly(again, land=False), "mix-flown")
        decided, undecided = decided.union(flown.filter("p <= 0 or p >= 1")), flown.filter("p > 0 and p < 1")
    undecided = undecided.withColumn("block", F.lit(-1).cast("long"))
    landed = fly(undecided.repartition("source").sortWithinPartitions(*order), land=True)
    every = decided.unionByName(landed)
    return every.select("key", "source", "size", "source_size", "target", (F.col("base") + F.col("p").cast("long")).alias("copies"))


def mixture(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``size`` (words), ``source_size``, ``target`` and ``taken`` (words that the mix takes, repeats counted)
    for each row of ``docs``.

    Null texts have size 0 and are taken 0 times. A null source is a source of its own, a null doc_id a document like
    others; repeated rows are drawn each by itself. Other columns are not read. An empty table gives no rows; if no
    text has a word, all targets are 0.
    """
    sizes = only(docs, "doc_id", "source", "text").select(F.col("doc_id").alias("key"), "source", words(F.col("text")).alias("size"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mix(sizes).select(F.col("key").alias("doc_id"), "size", "source_size", "target", taken)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; what has no word is not taken.

    What is drawn grows with the documents, so the two are merged by row number whatever their size."""
    row, copies, copy = (fresh(docs, c) for c in ("mix_row", "mix_copies", "mix_copy"))
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "mix-docs")
    sizes = rows.select(F.col(row).alias("key"), "source", words(F.col("text")).alias("size"))
    drawn = mix(sizes).filter("copies > 0").select(F.col("key").alias(row), F.col("copies").alias(copies)).hint("merge")
    repeats = F.explode(F.array_repeat(F.lit(True), F.col(copies).cast("int")))
    return rows.join(drawn, row).withColumn(copy, repeats).select([F.col(f"`{c}`") for c in docs.columns])
