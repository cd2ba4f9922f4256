"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnguard.workdir import materialize

#: Parts of a node's links, which go to different tasks.
SALTS = 8


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for each node of the links ``(a, b)``: the label is the smallest node that it can reach.

    Rounds of two steps, each a grouping that combines before its shuffle and an equi-join: every node hands its
    smallest neighbour first to its larger neighbours, then to its smaller ones, until every link points to a label.
    A node with very many links is SALTS keys of the joins, each with its smallest neighbour; no list of neighbours is ever
    collected. Each round's links are written to the shared folder, so lineage stays short. Links of a node with
    itself and repeated links do no harm; nodes without a link to another are not in the result. Null ends are left
    out.
    """
    links = edges.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = materialize(links.distinct(), "links")
    before = None
    while True:
        links = materialize(_to_smaller(_to_larger(links)), "links")
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    label = links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return label.union(links.select("b", "b").distinct())


def _salted(links: DataFrame, other: str, least: DataFrame) -> DataFrame:
    """``links`` joined to ``least`` by ``a``, the links of a node spread by their other end."""
    salt = F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")
    copies = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return links.withColumn("salt", salt).join(copies, ["a", "salt"])


def _to_larger(links: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest node that it sees, itself included."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    larger = links.select(F.col("b").alias("a"), F.col("a").alias("v"))
    return _salted(larger, "v", least).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _to_smaller(links: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours, and itself, to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = _salted(links, "b", least).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()
