"""Conversations as a trie of their turns, from adaptive radix trees over ranges of conversations."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnguard.llm.art import Tree, common_length
from txnguard.workdir import materialize

#: Bytes of a turn's id in a key.
WIDTH = 16
#: A tree takes so many different conversations, rows, and bytes of keys at most (one more conversation may pass the last).
TREE_KEYS, TREE_ROWS, TREE_BYTES = 8192, 65_536, 1 << 24
NO_ENDS = hashlib.sha256(b"").hexdigest()

TURNS = "array<struct<turn:bigint,id:string,bytes:bigint>>"
ROWS = (
    "shared boolean, node binary, above binary, path array<binary>, depth long, conv_id long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, last_bytes long, first_end long, ends binary"
)
KINDS = {"boolean": pa.bool_(), "binary": pa.binary(), "long": pa.int64(), "array<binary>": pa.list_(pa.binary())}
ARROW = pa.schema([(c.split(" ")[0], KINDS[c.split(" ")[1]]) for c in ROWS.split(", ")])


def turn_lists(conversations: DataFrame) -> DataFrame:
    """``conv_id`` and ``turns``, in order: each turn's number, id (hex) and bytes of text.

    A turn's id is 128 bits of the SHA-256 of its role and text, null being empty; equal turns have equal ids. Null turn
    numbers come first; turns of equal number stand in the order of their ids. Rows without conv_id belong to no
    conversation. A conversation is one row of 16 bytes a turn, as a document's text is one row.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.substring(F.sha2(named, 256), 1, 2 * WIDTH).alias("id"), F.octet_length(text).cast("long").alias("bytes"))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("at"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("at")).cast(TURNS).alias("turns"))


def paths(lists: DataFrame) -> DataFrame:
    """``conv_id``, ``key`` (the turns' ids as bytes, one after the other) and ``bytes`` of each turn."""
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), ""))
    return lists.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["bytes"]).alias("bytes"))


class Run:
    """Conversations of one key, in the order of their ids."""

    __slots__ = ("key", "bytes", "ids")

    def __init__(self, key: bytes, lengths: pa.Scalar) -> None:
        self.key, self.bytes, self.ids = key, lengths.values.to_numpy(), []


class Below:
    """What a tree knows of the nodes under some place: members, the children right below (rows to be told their parent),
    and sums over the subtrees whose nodes are all of this tree alone."""

    __slots__ = ("n", "low", "kids", "rows", "leaves", "saved", "run")

    def __init__(self) -> None:
        self.n, self.low, self.kids, self.rows, self.leaves, self.saved, self.run = 0, None, 0, [], 0, 0, None

    def add(self, other: Below) -> None:
        self.n += other.n
        self.low = other.low if self.low is None else min(self.low, other.low)
        self.kids += other.kids
        self.rows += other.rows
        self.leaves += other.leaves
        self.saved += other.saved
        self.run = self.run or other.run


def chain(key: bytes) -> list[bytes]:
    """The names of the nodes on a key's path, from the root."""
    names = [hashlib.md5(b"").digest()]
    for at in range(0, len(key), WIDTH):
        names.append(hashlib.md5(names[-1] + key[at : at + WIDTH]).digest())
    return names


def rows_of(runs: list[Run], before: bytes | None, after: bytes | None) -> list[dict]:
    """The trie's nodes of sorted runs, by way of an adaptive radix tree.

    ``before`` and ``after`` are the neighbouring keys outside, None where unknown. Nodes that those may have as well are
    ``shared``: they have figures of this tree's part and names. All others are complete, but for the parents' conv_id
    of those right below a shared node.
    """
    tree, out = Tree(), []
    for run in runs:
        tree.insert(run.key, run)
    first, last = runs[0].key, runs[-1].key
    shared: dict[bytes, tuple[list[bytes], int]] = {}
    for key, other in ((first, before), (last, after)):
        names = chain(key)
        most = len(names) - 1 if other is None else common_length(key, other) // WIDTH
        shared |= {key[: t * WIDTH]: (names, t) for t in range(most + 1)}
    deepest = max(len(k) for k in shared) // WIDTH

    def node(own: Below, depth: int, run: Run | None) -> Below:
        """The row of a turn-aligned place, and what is known above it."""
        up, known = Below(), shared.get(own.run.key[: depth * WIDTH]) if depth <= deepest else None
        up.n, up.low, up.run = own.n, own.low, own.run
        size = int(own.run.bytes[depth - 1]) if depth else 0
        ends = ",".join(map(str, run.ids)).encode() if run else None
        row = {"shared": known is not None, "depth": depth, "conv_id": own.low, "n_convs": own.n, "n_children": own.kids}
        if known:
            names, t = known
            row |= {"node": names[t], "above": names[t - 1] if t else None, "path": names[: t + 1], "last_bytes": size, "n_leaves": own.leaves}
            row |= {"saved_tokens": own.saved, "first_end": run.ids[0] if run else None, "ends": ends}
            for r in own.rows:
                r["above"] = names[t]
        else:
            up.kids, up.rows = 1, [row]
            up.leaves, up.saved = own.leaves or 1, own.saved + (own.n - 1) * size
            row |= {"n_leaves": up.leaves, "saved_tokens": up.saved, "ends": hashlib.sha256(ends or b"").digest()}
            for r in own.rows:
                r["parent_conv_id"] = own.low
        out.append(row)
        return up

    held: list[Below] = []
    for place, begin, end, kids in tree.upwards():
        own, run = Below(), place.value
        for below in held[len(held) - kids :]:
            own.add(below)
        del held[len(held) - kids :]
        if run:
            own.n += len(run.ids)
            own.low = run.ids[0] if own.low is None else min(own.low, run.ids[0])
            own.run = own.run or run
        for depth in range(end // WIDTH, begin // WIDTH, -1):
            own = node(own, depth, run if depth * WIDTH == end else None)
        if place is tree.root:
            node(own, 0, run)
        held.append(own)
    return out


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Run]:
    """Runs of equal keys; a long one comes in parts."""
    run = None
    for batch in batches:
        keys, ids, sizes = batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), batch.column("bytes")
        for i, key in enumerate(keys):
            if run is None or run.key != key or len(run.ids) >= TREE_ROWS:
                if run is not None:
                    yield run
                run = Run(key, sizes[i])
            run.ids.append(ids[i])
    if run is not None:
        yield run


def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[Run] = []
    before, rows, size = None, 0, 0

    def close(after: bytes | None) -> Iterator[pa.RecordBatch]:
        found = rows_of(held, before, after)
        for at in range(0, len(found), 4096):
            yield pa.RecordBatch.from_pylist(found[at : at + 4096], ARROW)

    for run in runs_of(batches):
        if held and (len(held) == TREE_KEYS or rows + len(run.ids) > TREE_ROWS or size > TREE_BYTES or held[-1].key == run.key):
            yield from close(run.key)
            before, held, rows, size = held[-1].key, [], 0, 0
        held.append(run)
        rows, size = rows + len(run.ids), size + len(run.key)
    if held:
        yield from close(None)


def ends_of(parts: DataFrame) -> DataFrame:
    """``(node, ends)``: the digest of the blocks of each node's ids, put one after the other; a block is held at a time."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.digest()], pa.binary())], ["node", "ends"])

        for batch in batches:
            for i in range(batch.num_rows):
                name, block = batch.column("node")[i].as_py(), batch.column("ends")[i].as_py()
                if name == node:
                    digest.update(b"," + block)
                else:
                    if node is not None:
                        yield row()
                    node, digest = name, hashlib.sha256(block)
        if node is not None:
            yield row()

    blocks = parts.filter("ends is not null").select("node", "first_end", "ends")
    return blocks.repartition("node").sortWithinPartitions("node", "first_end").mapInArrow(of, "node binary, ends binary")


def merged(parts: DataFrame) -> DataFrame:
    """The shared nodes from their parts: sums by name, then sums over subtrees along the paths."""
    sums = parts.groupBy("node").agg(
        F.first("above").alias("above"), F.first("path").alias("path"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("own_children"), F.sum("n_leaves").alias("own_leaves"),
        F.sum("saved_tokens").alias("own_saved"), F.max("last_bytes").alias("last_bytes"),
    )
    sums = materialize(sums, "trie-shared")
    children = sums.filter("above is not null").groupBy(F.col("above").alias("node")).agg(F.count("*").alias("more"))
    known = sums.join(children, "node", "left").withColumn("n_children", F.col("own_children") + F.coalesce("more", F.lit(0)))
    leaf = F.col("own_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)
    saved = F.col("own_saved") + (F.col("n_convs") - 1) * F.col("last_bytes")
    along = known.select(F.explode("path").alias("node"), leaf.alias("leaf"), saved.alias("saved"))
    below = along.groupBy("node").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    parent = sums.select(F.col("node").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    whole = known.join(below, "node").join(ends_of(parts), "node", "left").join(parent, "above", "left")
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends", "node")


def prefix_trie(keyed: DataFrame) -> DataFrame:
    """One row per node of the trie of ``keyed(conv_id, key, bytes)``, as ``paths`` gives them; conv_ids are unique.

    A node is a different sequence of first turns, the root the empty one; its members are the conversations that begin
    with it. Per node: ``conv_id``, the smallest member; ``depth``, in turns; ``parent_conv_id`` (null for the root);
    ``n_convs``; ``n_children``; ``n_leaves``, childless nodes of its subtree; ``saved_tokens``, over the subtree the
    last turn's bytes times the members but one; ``ends_sha256``, of the members that end here, ids ascending and joined
    by commas.

    Rows are dealt by ranges of (key, conv_id), so a hot first turn, or one conversation repeated however often, is split
    over tasks. A task builds one adaptive radix tree after the other, each of a bounded number of conversations, and
    emits nodes at byte depths that are whole turns. Nodes that a neighbouring range or tree may have as well are few,
    those on the paths to its first and last key; their parts are added up afterwards. An empty table gives no rows.
    """
    order = ["key", "conv_id"]
    rows = materialize(keyed.select("conv_id", "key", "bytes"), "trie-paths")
    found = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(trees, ROWS)
    found = materialize(found, "trie-nodes")
    shared = materialize(merged(found.filter("shared")), "trie-merged")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    own = found.filter("not shared")
    upper = shared.select(F.col("node").alias("above"), F.col("conv_id").alias("parent"))
    under = own.filter("above is not null").join(upper.hint("merge"), "above").withColumn("parent_conv_id", F.col("parent"))
    every = own.filter("above is null").select(columns).union(under.select(columns)).union(shared.select(columns))
    ends = F.coalesce(F.lower(F.hex("ends")), F.lit(NO_ENDS))
    return every.select(*columns[:-1], ends.alias("ends_sha256"))
