"""Near-duplicate documents by SimHash fingerprints, joined by the generalised pigeonhole principle."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnguard.llm.columns import fresh, only, spread, utf8, with_columns_of
from txnguard.llm.graph import SALTS, components
from txnguard.workdir import materialize

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
#: Most rows of one signature that are compared with each other in a task; larger signatures meet at midpoints instead.
LARGEST_RUN = 32_768
#: Work of moving one signature row, in comparisons of two fingerprints.
ROW_COST = 100
PARTS = (2, 3, 4)
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
ONE = np.uint64(1)
#: The pipeline's near copies: words of a shingle, 64-bit parts of a long fingerprint, tables and the bits that each samples,
#: the parts that are compared and the bits in which candidates' may differ there, runs that are compared all at once, and
#: the shingles of sets that are compared in one task.
COPY_SHINGLE = 5
LONG = 8
TABLES, SAMPLED = 100, 16
#: The tables at which passes over them end: what one pass links is one node to the next, so links do not add up over tables.
PASSES = (10, TABLES)
COMPARED, WIDE = 3, 56
SMALL_RUN = 16
BLOCK = 1 << 21
FACTORS, TERMS = np.random.default_rng(SEED).integers(0, 2**64, (2, LONG), np.uint64) | np.uint64(1)
POSITIONS = np.array([np.random.default_rng([SEED, t]).choice(LONG * BITS, SAMPLED, replace=False) for t in range(TABLES)])
PARTS_COMPARED = [f"c{k}" for k in range(COMPARED)]


# --- fingerprints -------------------------------------------------------------------------------------------------


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """The hash of each run of ``size`` words, in order; shorter texts are one run, and no word gives none."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(size, len(words))
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans), "<u8", len(words) - size + 1)


def fingerprint_of(text: bytes) -> int:
    """The bits that are set in more than half of the shingles' hashes; 0 without a word."""
    hashed = shingle_hashes(text, SHINGLE)
    if not len(hashed):
        return 0
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashed), 8192):
        bits = np.unpackbits(hashed[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(hashed), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint as a signed long) of every row; a null text has no words."""

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = np.fromiter(map(fingerprint_of, utf8(batch.column("text"))), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return with_columns_of("doc_id long, fp long", of, only(docs, "doc_id", "text"))


# --- partitions of the bits and their thresholds --------------------------------------------------------------------


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and, for each two bits, how many have both; a 64 x 64 table whatever the input."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            fp = np.ascontiguousarray(batch.column("fp").to_numpy(zero_copy_only=False))
            for k in range(0, len(fp), 8192):
                bits = np.unpackbits(fp[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += bits.T @ bits
                n += len(bits)
        row, col = np.divmod(np.arange(BITS * BITS), BITS)
        arrays = [pa.array(row), pa.array(col), pa.array(both.ravel().astype(np.int64)), pa.array(np.full(BITS * BITS, n))]
        yield pa.RecordBatch.from_arrays(arrays, ["i", "j", "both", "n"])

    sums = fps.select("fp").mapInArrow(of, "i long, j long, both long, n long").groupBy("i", "j")
    rows = sums.agg(F.sum("both").alias("both"), F.sum("n").alias("n")).collect()
    table = np.zeros((BITS, BITS))
    for r in rows:
        table[r.i, r.j] = r.both
    return (rows[0].n if rows else 0), table


def correlation(n: int, both: np.ndarray) -> np.ndarray:
    p = both.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    out = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(out, 0)
    return out


def group_bits(corr: np.ndarray, parts: int) -> list[list[int]]:
    """Cuts the bits into parts of about equal size; each grows by the bit most correlated with those that it has."""
    left, out = set(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        own = [max(left, key=lambda b: (corr[b, list(left)].sum(), -b))]
        left.discard(own[0])
        while len(own) < size:
            nearest = max(left, key=lambda b: (corr[b, own].max(), -b))
            own.append(nearest)
            left.discard(nearest)
        out.append(own)
    return out


def chance_within(n: int, both: np.ndarray, bits: list[int]) -> np.ndarray:
    """The estimated chance that two fingerprints differ in at most 0, 1, .. RADIUS of these bits, which form a Markov
    chain in their order."""
    p = both.diagonal() / max(n, 1)
    pair = np.zeros((2, 2, RADIUS + 1))  # state of the two fingerprints in the latest bit, by differences so far

    def place(table: np.ndarray, x: int, y: int, mass: np.ndarray) -> None:
        table[x, y] += mass if x == y else np.concatenate(([0], mass[:-1]))

    first, start = bits[0], np.eye(RADIUS + 1)[0]
    for x, y in itertools.product((0, 1), repeat=2):
        place(pair, x, y, start * (p[first] if x else 1 - p[first]) * (p[first] if y else 1 - p[first]))
    for a, b in itertools.pairwise(bits):
        given = [((both.diagonal()[b] - both[a, b]) / max(n - both[a, a], 1)), both[a, b] / max(both[a, a], 1)]
        after = np.zeros_like(pair)
        for x0, y0, x, y in itertools.product((0, 1), repeat=4):
            place(after, x, y, pair[x0, y0] * (given[x0] if x else 1 - given[x0]) * (given[y0] if y else 1 - given[y0]))
        pair = after
    return np.cumsum(pair.sum(axis=(0, 1)))


def allocate(n: int, costs: list[list[float]]) -> tuple[float, list[int]]:
    """Thresholds (-1: the part is not probed) of least total cost whose values plus one add up to RADIUS + 1: if two
    fingerprints exceed all of them, they differ in more than RADIUS bits. Dynamic programming over the parts."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for spent, (total, chosen) in best.items():
            for t in range(-1, RADIUS - spent + 1):
                found = (total + (0 if t < 0 else cost[t]), [*chosen, t])
                if spent + t + 1 not in nxt or found < nxt[spent + t + 1]:
                    nxt[spent + t + 1] = found
        best = nxt
    return best[RADIUS + 1]


def plan(fps: DataFrame) -> list[tuple[list[int], int]]:
    """The probed parts: their bits and thresholds, for the number of parts with the least estimated work."""
    n, both = bit_counts(fps)
    corr, found = correlation(n, both), []
    for parts in PARTS:
        groups = group_bits(corr, parts)
        costs = []
        for bits in groups:
            near = chance_within(n, both, bits)
            variants = np.cumsum([math.comb(len(bits), d) for d in range(RADIUS + 1)])
            costs.append([float(n * (v if t == 0 else v + 1) * ROW_COST + n * n * p / 2) for t, (v, p) in enumerate(zip(variants, near, strict=True))])
        cost, thresholds = allocate(n, costs)
        found.append((cost, parts, [(b, t) for b, t in zip(groups, thresholds, strict=True) if t >= 0]))
    return min(found)[2]


# --- probing --------------------------------------------------------------------------------------------------------


def flips(bits: list[int], most: int) -> np.ndarray:
    """Masks of all sets of at most so many of these bits; the empty one first."""
    sets = (s for d in range(most + 1) for s in itertools.combinations(bits, d))
    return np.array([sum(1 << b for b in s) for s in sets], np.uint64)


def signatures(fps: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """``(part, sig, fp, own)``: each fingerprint under its own bits of every part (own), and under those that differ
    in at most the part's threshold."""
    made = [(k, np.uint64(sum(1 << b for b in bits)), flips(bits, t)) for k, (bits, t) in enumerate(parts)]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for (k, mask, masks), at in itertools.product(made, range(0, len(fp), 4096)):
                x = fp[at : at + 4096]
                sig = ((x & mask)[:, None] ^ masks[None, :]).ravel()
                own = np.tile(np.arange(len(masks)) == 0, len(x))
                arrays = [np.full(len(sig), k, np.int32), sig.view(np.int64), np.repeat(x, len(masks)).view(np.int64), own]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["part", "sig", "fp", "own"])

    return fps.select("fp").mapInArrow(of, "part int, sig long, fp long, own boolean")


def links_of_run(fp: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what the rows of one signature connect. Two rows are compared if one is there by its own
    bits. Small runs give each link; in larger ones a search from row to row gives one link for each row reached."""
    n = len(fp)
    if n <= 64:
        i, j = np.triu_indices(n, 1)
        near = (np.bitwise_count(fp[i] ^ fp[j]) <= RADIUS) & (own[i] | own[j])
        yield fp[i[near]], fp[j[near]]
        return
    left = np.arange(n)
    while len(left):
        root, left, wave = left[0], left[1:], left[:1]
        while len(wave) and len(left):
            x, wave = wave[0], wave[1:]
            near = (np.bitwise_count(fp[left] ^ fp[x]) <= RADIUS) & (own[left] | own[x])
            if near.any():
                wave = np.concatenate((wave, left[near]))
                yield np.full(near.sum(), fp[root]), fp[left[near]]
                left = left[~near]


def probe(sigs: DataFrame, largest: int = LARGEST_RUN) -> DataFrame:
    """``(a, b, part)`` from the rows of each signature: links between two near fingerprints or, with a null ``b``,
    a member ``a`` of a signature that has more than ``largest`` rows. At most so many rows are held at a time."""

    def rows(a: np.ndarray, b: np.ndarray | None, part: int) -> pa.RecordBatch:
        b = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), b, pa.array(np.full(len(a), part, np.int32))], ["a", "b", "part"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size = None, [], 0

        def close() -> Iterator[pa.RecordBatch]:
            if held and size > 1:
                found = list(links_of_run(np.concatenate([f for f, _ in held]), np.concatenate([o for _, o in held])))
                if found and (a := np.concatenate([x for x, _ in found])).size:
                    yield rows(a, np.concatenate([y for _, y in found]), key[0])

        for batch in batches:
            part = batch.column("part").to_numpy(zero_copy_only=False)
            sig = batch.column("sig").to_numpy(zero_copy_only=False)
            fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            own = batch.column("own").to_numpy(zero_copy_only=False)
            change = np.flatnonzero((part[1:] != part[:-1]) | (sig[1:] != sig[:-1])) + 1
            cuts = np.concatenate(([0], change, [len(sig)])) if len(sig) else np.array([0])
            starts, ends = cuts[:-1], cuts[1:]
            inner = np.zeros(len(starts), bool)
            if len(starts) > 2:  # runs that begin and end in this batch, of two rows: all at once
                inner[1:-1] = (ends - starts)[1:-1] == 2
                i = starts[inner]
                near = (np.bitwise_count(fp[i] ^ fp[i + 1]) <= RADIUS) & (own[i] | own[i + 1])
                if near.any():
                    found = pa.array(part[i[near]].astype(np.int32))
                    arrays = [pa.array(fp[i[near]].view(np.int64)), pa.array(fp[i[near] + 1].view(np.int64)), found]
                    yield pa.RecordBatch.from_arrays(arrays, ["a", "b", "part"])
                inner[1:-1] |= (ends - starts)[1:-1] == 1
            for s, e in zip(starts[~inner].tolist(), ends[~inner].tolist(), strict=True):
                if key != (this := (int(part[s]), int(sig[s]))):
                    yield from close()
                    key, held, size = this, [], 0
                held.append((fp[s:e], own[s:e]))
                size += e - s
                if size > largest:
                    for f, _ in held:
                        yield rows(f, None, key[0])
                    held = []
        yield from close()

    sorted_rows = sigs.repartition("part", "sig").sortWithinPartitions("part", "sig")
    return sorted_rows.mapInArrow(of, "a long, b long, part int")


def at_midpoints(members: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """Links ``(a, b)`` among members of too large signatures, without comparing any two of them.

    Two fingerprints that differ in at most 3 bits, at most ``t`` of them in the part, have a fingerprint between them
    that one reaches by at most 2 flips and the other by one. All that reach it by one flip are within 2 of each other,
    and those at 2 flips are within 3 of them. So each midpoint links its members to its nearest one, in a grouping
    that combines before the shuffle and one join; work and rows are in proportion to the members.
    """
    made = []
    for bits, t in parts:
        others = [b for b in range(BITS) if b not in bits]
        near, far = flips(bits, min(t, 2)), flips(others, 2)
        every = {int(x ^ y) for x in near for y in far if int(x ^ y).bit_count() <= 2} | {int(x) for x in flips(range(BITS), 1)}
        made.append(np.array(sorted(every, key=lambda m: (m.bit_count(), m)), np.uint64))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column("part").to_numpy(zero_copy_only=False)
            fp = batch.column("a").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for k, masks in enumerate(made):
                mine = fp[part == k]
                for at in range(0, len(mine), 64):
                    x = mine[at : at + 64]
                    mid, far = (x[:, None] ^ masks).ravel(), np.tile(np.bitwise_count(masks) > 1, len(x))
                    arrays = [mid.view(np.int64), np.repeat(x, len(masks)).view(np.int64), far]
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in arrays], ["mid", "fp", "far"])

    spots = members.select("a", "part").distinct().mapInArrow(of, "mid long, fp long, far boolean")
    heads = spots.groupBy("mid").agg(F.min(F.when(~F.col("far"), F.col("fp"))).alias("head"), F.count("*").alias("n"))
    heads = heads.filter("head is not null and n > 1").drop("n")
    return spots.join(heads, "mid").select(F.col("fp").alias("a"), F.col("head").alias("b")).filter("a <> b")


# --- the operator ---------------------------------------------------------------------------------------------------


def classes(docs: DataFrame, largest: int = LARGEST_RUN) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of ``docs`` as a written table, and ``(fp, label, component_id)`` of each different one."""
    found = materialize(fingerprints(docs), "simhash")
    folded = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-folded")
    parts = plan(folded)
    probed = materialize(probe(signatures(folded, parts), largest), "simhash-links")
    links = probed.filter("b is not null").select("a", "b")
    crowded = probed.filter("b is null")
    if not crowded.isEmpty():
        links = links.union(at_midpoints(crowded, parts))
    label = components(links).withColumnRenamed("node", "fp")
    labelled = folded.join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    return found, labelled.join(least, "label").select("fp", "label", "component_id")


def near_duplicates(docs: DataFrame, largest: int = LARGEST_RUN) -> DataFrame:
    """``doc_id``, ``fp`` (signed long) and ``component_id``, one row for each row of ``docs(doc_id, text)``.

    Documents whose fingerprints differ in at most 3 bits are linked; ``component_id`` is the smallest doc_id that
    links reach. Equal fingerprints are folded first, so copies cost nothing. Every link between different
    fingerprints is found: the parts' thresholds follow the pigeonhole principle, and each candidate is verified.

    Null text, or one without words: fingerprint zero, linked like any other. A null doc_id takes part but can't be a
    component_id; a component without any doc_id has a null one. Repeated rows stay as they are. Other columns of
    ``docs`` are not read. An empty table gives no rows.
    """
    found, known = classes(docs, largest)
    return found.join(known.drop("label"), "fp").select("doc_id", "fp", "component_id")


# --- the pipeline's stage: near copies by exact similarity ------------------------------------------------------------


def shingle_set(text: bytes) -> np.ndarray:
    """The different hashes of the text's shingles of five words, in order."""
    return np.unique(shingle_hashes(text, COPY_SHINGLE))


def node_of(own: np.ndarray) -> int:
    """The hash that stands for a set of hashes."""
    return xxhash.xxh64_intdigest(own.tobytes(), SEED)


def long_fingerprint(own: np.ndarray) -> np.ndarray:
    """The SimHash of a set of hashes in LONG parts: each bit is 1 if set in more than half of the part's hashes of them."""
    ones = np.zeros(LONG * BITS, np.int64)
    for k in range(0, len(own), 1024):
        hashed = spread(own[k : k + 1024, None] * FACTORS + TERMS)
        ones += np.unpackbits(hashed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > len(own), bitorder="little").view(np.uint64)


def sampled_bits(codes: np.ndarray, tables: range = range(TABLES)) -> np.ndarray:
    """The bits that each of ``tables`` samples of each long fingerprint, under the table's number."""
    bits = np.unpackbits(codes.view(np.uint8).reshape(len(codes), -1), axis=1, bitorder="little")
    positions = POSITIONS[tables.start : tables.stop].ravel()
    taken = np.packbits(bits[:, positions].reshape(len(codes), len(tables), SAMPLED), axis=2).astype(np.int64)
    return (np.array(tables) << SAMPLED) | (taken[:, :, 0] << 8) | taken[:, :, 1]


def similar(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of ``a`` and ``b`` elements with so many common ones have similarity 0.8 or more, in whole numbers."""
    return 5 * common >= 4 * (a + b - common)


def exact_groups(sets: list[np.ndarray]) -> np.ndarray:
    """For each set, the first one that links of similarity 0.8 or more lead to. The sets not yet reached are indexed by
    element, and indexed again when half of them are reached. A set that is similar to one of n elements has at least
    0.8 n of them, so it has one of any n - 0.8 n + 1: only the holders of the rarest ones are compared."""
    sizes, root = np.array([len(s) for s in sets], np.int64), np.full(len(sets), -1)
    left, indexed = len(sets), None
    for start in range(len(sets)):
        if root[start] >= 0:
            continue
        root[start], wave, left = start, [start], left - 1
        while wave and left:
            if indexed is None or left * 2 < len(indexed):
                indexed = np.flatnonzero(root < 0)
                elements = np.concatenate([sets[i] for i in indexed])
                order = np.argsort(elements, kind="stable")
                elements, holder = elements[order], np.repeat(np.arange(len(indexed)), sizes[indexed])[order]
            own = sets[wave.pop()]
            lo, hi = np.searchsorted(elements, own, "left"), np.searchsorted(elements, own, "right")
            rare = np.argsort(hi - lo, kind="stable")[: len(own) - (4 * len(own) + 4) // 5 + 1]
            lo, count = lo[rare], (hi - lo)[rare]
            at = np.arange(count.sum()) + np.repeat(lo - (np.cumsum(count) - count), count)
            near = indexed[np.unique(holder[at])]
            near = near[root[near] < 0]
            if len(near):
                theirs = np.concatenate([sets[i] for i in near])
                place = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
                common = np.bincount(np.repeat(np.arange(len(near)), sizes[near]), own[place] == theirs, len(near)).astype(np.int64)
                new = near[similar(common, len(own), sizes[near])]
                root[new] = start
                wave.extend(new.tolist())
                left -= len(new)
    return root


def sketches(rows: DataFrame) -> DataFrame:
    """``(k1, k2, doc_id, node, size, code)``: of each row the hash and size of its shingle set and its long fingerprint."""

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = [shingle_set(t) for t in utf8(batch.column("text"))]
        node = np.array([node_of(s) for s in sets], np.uint64)
        code = pa.array([long_fingerprint(s).tobytes() for s in sets], pa.binary())
        made = [pa.array(node.view(np.int64)), pa.array([len(s) for s in sets], pa.int64()), code]
        names = ["k1", "k2", "doc_id"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, names), *made], [*names, "node", "size", "code"])

    return with_columns_of("k1 long, k2 long, doc_id long, node long, size long, code binary", of, rows)


def table_rows(folded: DataFrame, tables: range = range(TABLES)) -> DataFrame:
    """``(sig, node, label, size, c0, ..)``: each set that is not empty under the sampled bits of every one of ``tables``."""

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not batch.num_rows:
            return
        codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint64).reshape(batch.num_rows, LONG)
        own = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "label", "size")] + [codes[:, k].view(np.int64) for k in range(COMPARED)]
        arrays = [sampled_bits(codes, tables).ravel(), *[np.repeat(c, len(tables)) for c in own]]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a)) for a in arrays], ["sig", "node", "label", "size", *PARTS_COMPARED])

    schema = ", ".join(f"{c} long" for c in ("sig", "node", "label", "size", *PARTS_COMPARED))
    return with_columns_of(schema, of, folded.filter("size > 0").select("node", "label", "size", "code"))


def are_near(size: np.ndarray, code: np.ndarray, other_size: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether two sets may be similar: compared parts within WIDE bits, sizes that allow 0.8."""
    near = np.bitwise_count(code ^ other).sum(axis=-1, dtype=np.int32) <= WIDE
    return near & similar(np.minimum(size, other_size), size, other_size)


def wide_links_of_run(label: np.ndarray, size: np.ndarray, code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what the rows of one table's bits connect."""
    left = np.arange(len(label))
    while len(left) > 1:
        root, left, wave = left[0], left[1:], left[:1]
        while len(wave) and len(left):
            x, wave = wave[0], wave[1:]
            near = are_near(size[left], code[left], size[x], code[x])
            if near.any():
                wave = np.concatenate((wave, left[near]))
                yield np.full(near.sum(), label[root]), label[left[near]]
                left = left[~near]


def links_of_small_runs(run: np.ndarray, label: np.ndarray, size: np.ndarray, code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All links within runs of at most SMALL_RUN rows, which follow each other; ``run`` numbers them."""
    for step in range(1, SMALL_RUN):
        at = np.flatnonzero(run[step:] == run[:-step]) if len(run) > step else np.zeros(0, int)
        if not len(at):
            return
        at = at[are_near(size[at], code[at], size[at + step], code[at + step])]
        yield label[at], label[at + step]


def star(label: np.ndarray, first: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of all to the first, without comparing."""
    return [(np.full(len(label), first), label)] if len(label) else []


def links_of_bands(batches: Iterator[pa.RecordBatch], largest: int, edges: bool) -> Iterator[pa.RecordBatch]:
    """``(a, b)`` between the labels of the rows of each table's bits, from rows ``(sig, node, label, size, c0, .., open)``
    sorted by sig and node. Each two labels are linked once for a batch of rows, and no label with itself.

    At most ``largest`` rows are held: those of a larger run, or of one that has an ``open`` row, are all linked to its
    first, uncompared. With ``edges``, a task's first and last runs, which may go on in other tasks, come back as rows:
    whole, or, where they have been linked already, as their first row, ``open``.
    """
    fields = ["sig", "node", "label", "size", *PARTS_COMPARED, "open"]
    held: list[tuple[np.ndarray, ...]] = []
    size, first, count = 0, None, 0

    def table(found: list[tuple[np.ndarray, np.ndarray]], rows: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        if found:
            pairs = np.sort(np.stack([np.concatenate(c) for c in zip(*found, strict=True)], axis=1), axis=1)
            pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
            a, b = (np.ascontiguousarray(c) for c in pairs.T)
            none = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *[none] * (len(fields) - 1), pa.nulls(len(a), pa.bool_())], ["a", "b", *fields])
        if rows:
            own = [np.concatenate(c) for c in zip(*rows, strict=True)]
            none = pa.nulls(len(own[0]), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, *map(pa.array, own)], ["a", "b", *fields])

    def close(edge: bool) -> tuple[list, list]:
        """Links and rows of the run that ends; ``first`` is there if all its rows are linked to it already."""
        if first is not None:
            sig, row = first
            return [], ([tuple(np.array([v]) for v in (sig, *row[1:-1], True))] if edge else [])
        if edge:
            return [], held
        if size < 2:
            return [], []
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        if columns[-1].any():
            return star(columns[2], columns[2].min()), []
        return list(wide_links_of_run(columns[2], columns[3], np.stack(columns[4:-1], axis=1).view(np.uint64))), []

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.ascontiguousarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in fields]
        columns[-1] = columns[-1].astype(bool)
        sig, rows = columns[0], []
        cuts = np.concatenate(([0], np.flatnonzero(sig[1:] != sig[:-1]) + 1, [len(sig)]))
        small = (np.diff(cuts) <= SMALL_RUN) & ~np.logical_or.reduceat(columns[-1], cuts[:-1])
        small[[0, -1]] = False  # the batch's first and last run may go on in others
        run = np.repeat(np.arange(len(small)), np.diff(cuts))
        whole = np.flatnonzero(small[run])
        found = list(links_of_small_runs(run[whole], columns[2][whole], columns[3][whole], np.stack([c[whole] for c in columns[4:-1]], axis=1).view(np.uint64)))
        cuts, small = cuts.tolist(), small.tolist()
        for s, e, done in zip(cuts[:-1], cuts[1:], small, strict=True):
            if held and held[0][0][0] != sig[s]:
                count += 1
                links, left = close(edges and count == 1)
                found, rows = found + links, rows + left
                held, size, first = [], 0, None
            if done:
                count += 1
                continue
            part = tuple(c[s:e].copy() for c in columns)
            if first is None:
                held.append(part)
                size += e - s
                if size > largest:
                    whole = [np.concatenate(c) for c in zip(*held, strict=True)]
                    first = (sig[s], [c[0] for c in whole])
                    found += star(whole[2], first[1][2])
                    held = [tuple(c[:1] for c in whole)]
            else:
                found += star(part[2], first[1][2])
        yield from table(found, rows)
    if held:
        yield from table(*close(edges))


LINK_ROWS = "a long, b long, sig long, node long, label long, size long, " + "".join(f"{c} long, " for c in PARTS_COMPARED) + "open boolean"


def wide_links(rows: DataFrame, largest: int = LARGEST_RUN) -> DataFrame:
    """Links ``(a, b)`` of labels that connect at least all that share a table's sampled bits, have fingerprints within WIDE
    bits and sizes that allow 0.8. Ranges of (sig, node) split bits that very many share; what lies at the ranges' ends is met again."""
    marked = rows.withColumn("open", F.lit(False))
    ranges = marked.repartitionByRange("sig", "node").sortWithinPartitions("sig", "node")
    found = materialize(ranges.mapInArrow(lambda b: links_of_bands(b, largest, True), LINK_ROWS), "copies-links")
    ends = found.filter("sig is not null").select("sig", "node", "label", "size", *PARTS_COMPARED, "open")
    more = ends.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(lambda b: links_of_bands(b, largest, False), LINK_ROWS)
    return found.filter("sig is null").union(more).select("a", "b")


def candidates(folded: DataFrame, largest: int = LARGEST_RUN) -> DataFrame:
    """``(node, near)`` of each set that the tables link to another: the smallest one that their links lead to.

    A group of near copies would have a link per set and table. So the tables are gone through in PASSES: sets that one pass
    has connected bear one label, and the next one links labels only. What few tables have not connected has few links in
    as many again.
    """
    label, begin = None, 0
    for end in PASSES:
        own = folded.withColumn("label", F.col("node")) if label is None else folded.join(label.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
        links = wide_links(table_rows(own, range(begin, end)), largest)
        if label is not None:
            links = links.union(label.select("node", "label"))
        label, begin = components(links), end
    return label.withColumnRenamed("label", "near")


def verified(sets: DataFrame, *keys: str) -> DataFrame:
    """``(node, label)`` from rows ``(*keys, node, shingles)``: within each key, the smallest node that links of similarity
    0.8 or more lead to. A task holds the shingle sets of one key."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, own = None, [], []

        def close() -> Iterator[pa.RecordBatch]:
            if nodes:
                found = np.array(nodes, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(found[exact_groups(own)])], ["node", "label"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*keys, "node")]
            for i, (*this, node) in enumerate(zip(*columns, strict=True)):
                if this != key:
                    yield from close()
                    key, nodes, own = this, [], []
                if not nodes or nodes[-1] != node:  # equal rows follow each other
                    nodes.append(node)
                    own.append(np.frombuffer(batch.column("shingles")[i].as_py(), "<u8"))
        yield from close()

    return sets.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(of, "node long, label long")


def labelled(wanted: DataFrame, texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(node, label)`` of ``wanted(near, node, size, k1, k2)``: the smallest node that links of similarity 0.8 or more
    lead to, by exact comparison within each ``near``.

    Candidates of up to ``block`` shingles together are compared in one task. More are dealt into blocks, and every two
    blocks meet in a task of their own, which gives links that connect what it has found; their components are the
    labels. So a task holds two blocks, and the work grows with the square of such a set, over as many tasks.
    """

    def shingled(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        made = pa.array([shingle_set(t).tobytes() for t in utf8(batch.column("text"))], pa.binary())
        yield pa.RecordBatch.from_arrays([*map(batch.column, ("near", "blocks", "node")), made], ["near", "blocks", "node", "shingles"])

    weight = wanted.groupBy("near").agg(F.ceil(F.sum("size") / F.lit(block)).cast("int").alias("blocks"))
    weight = materialize(weight, "copies-weight")

    def sets(which: str) -> DataFrame:
        own = wanted.join(weight.filter(which).hint("merge"), "near")
        found = texts.join(own.hint("merge"), ["k1", "k2"]).select("near", "blocks", "node", "text")
        return with_columns_of("near long, blocks int, node long, shingles binary", shingled, found)

    small = materialize(verified(sets("blocks < 2"), "near"), "copies-verified")
    if weight.filter("blocks > 1").isEmpty():
        return small
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    large = materialize(sets("blocks > 1").withColumn("own", own), "copies-blocks")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = large.select("near", "own", "node", "shingles", other).filter("own <> other")
    met = met.select("near", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "shingles")
    links = verified(met, "near", "i", "j")
    return small.union(components(links.select(F.col("node").alias("a"), F.col("label").alias("b"))))


# --- what no table gathers: an exact search between the tables' groups ---------------------------------------------------


def head(own: np.ndarray) -> np.ndarray:
    """The first hashes of a set, in order: a fifth, which a similar set may lack, and one and a tenth more."""
    return own[: len(own) // 5 + 1 + len(own) // 10]


#: What a set has at least in common with one of similarity 0.8 or more, and how many of their heads' hashes both heads have.
COMMON = "(4 * size + 4) div 5"
COMMON_HEAD = f"1 + ({COMMON}) div 10"


def hash_rows(rows: DataFrame, names: tuple[str, ...], of_set: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``(hash, *names, node)``: a row for each hash that ``of_set`` takes from the shingle set of each row's text. Without
    ``node`` in ``rows`` it is the set's own. Sets of less than 4 shingles are similar to none but equal ones."""
    given = [*names, *(["node"] if "node" in rows.columns else [])]

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, 32):  # sets can be large, and each hash becomes a row
            few = batch.slice(at, 32)
            sets = [shingle_set(t) for t in utf8(few.column("text"))]
            taken = [of_set(s) if len(s) > 3 else s[:0] for s in sets]
            columns = [few.column(c).to_numpy(zero_copy_only=False) for c in given]
            if "node" not in given:
                columns.append(np.array([node_of(s) for s in sets], np.uint64).view(np.int64))
            count = [len(t) for t in taken]
            arrays = [np.concatenate(taken).view(np.int64), *[np.repeat(c, count) for c in columns]]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["hash", *names, "node"])

    schema = ", ".join(f"{c} long" for c in ("hash", *names, "node"))
    return with_columns_of(schema, of, rows.select(*given, "text"))


def met_elsewhere(rows: DataFrame) -> DataFrame:
    """Those of ``rows(hash, [near,] node)`` whose hash is met under another value of the second column too, and a few more.

    Rows are dealt by ranges, so a hash that very many sets have is split over tasks. A hash at an end of a batch may go on in
    the next one and stays unchecked; whether a hash stays is so decided for all its rows alike.
    """
    names = rows.columns

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key, group, node = (batch.column(c).to_numpy(zero_copy_only=False) for c in (names[0], names[1], "node"))
            new = key[1:] != key[:-1]
            starts = np.concatenate(([0], np.flatnonzero(new) + 1))
            ends = np.append(starts[1:], len(key))
            met = group[starts] != group[ends - 1]
            met[[0, -1]] = True
            kept = np.repeat(met, ends - starts)
            kept[1:] &= new | (node[1:] != node[:-1])
            yield batch.filter(pa.array(kept))

    return rows.repartitionByRange(*names).sortWithinPartitions(*names).mapInArrow(of, rows.schema)


def missed(folded: DataFrame, near: DataFrame, texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(node, label)`` that links sets of similarity 0.8 or more with different ``near``: those that share no table's bits.

    None is lost. A set of n elements that is similar to another has at least 0.8 n of them in common with it. So it is left
    out only if fewer of its elements are met in sets of another ``near`` at all: first of its least hashes, whose number is
    enough to tell most sets, then, for the sets still there, of all. Of what is left, two similar sets share one of the
    rarest of their common elements (as many as may be lacking, and one). Sets that share such a one are compared exactly.
    """
    own = folded.filter("size > 3").join(near.hint("merge"), "node", "left")
    own = own.select("node", F.coalesce("near", "node").alias("near"), "size", F.col("first.k1").alias("k1"), F.col("first.k2").alias("k2"))

    def having(rows: DataFrame, least: str) -> DataFrame:
        """The sets that have so many of ``rows``."""
        count = rows.groupBy("node").agg(F.count("*").alias("met"))
        return materialize(own.join(count.hint("merge"), "node").filter(f"met >= {least}"), "copies-left")

    rows = materialize(met_elsewhere(hash_rows(texts, (), head)), "copies-heads")
    left = having(rows, COMMON_HEAD)
    rows = rows.join(left.hint("merge"), "node").select("hash", "near", "node")
    left = having(met_elsewhere(rows), COMMON_HEAD)
    wanted = texts.join(left.select("near", "node", "k1", "k2").hint("merge"), ["k1", "k2"]).dropDuplicates(["node"])
    wanted = materialize(wanted, "copies-left-texts")
    rows = materialize(met_elsewhere(hash_rows(wanted, ("near",), lambda s: s)), "copies-common")
    left = having(rows, COMMON)
    rows = rows.join(left.select("node", "size", "met").hint("merge"), "node")
    rows = rows.join(rows.groupBy("hash").agg(F.count("*").alias("holders")).hint("merge"), "hash")
    rank = F.row_number().over(Window.partitionBy("node").orderBy("holders", "hash"))
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).alias("salt")  # many sets can share a hash
    rarest = materialize(rows.withColumn("rank", rank).filter(f"rank <= met - {COMMON} + 1").select("hash", salt, "node"), "copies-rarest")
    first = rarest.groupBy("hash", "salt").agg(F.min("node").alias("first"))
    least = first.groupBy("hash").agg(F.min("first").alias("least"))
    links = rarest.join(first.hint("merge"), ["hash", "salt"]).select(F.col("node").alias("a"), F.col("first").alias("b"))
    group = components(links.union(first.join(least.hint("merge"), "hash").select("first", "least")))
    left = left.drop("near").join(group.withColumnRenamed("label", "near").hint("merge"), "node")
    return labelled(left.select("near", "node", "size", "k1", "k2"), wanted.select("k1", "k2", "text"), block)


# --- the stage -----------------------------------------------------------------------------------------------------------


def survivors(docs: DataFrame, largest: int = LARGEST_RUN, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` with one of each group: the one with the smallest doc_id, once if it is repeated.

    Texts are linked if their sets of five-word shingles have similarity (Jaccard) 0.8 or more. Sets that are equal are
    folded. Candidates come from SimHash: a set's long fingerprint has 512 bits, and a table samples 16 of them; candidates
    agree in those of one of TABLES tables and differ in at most WIDE of 192 bits. Sets at 0.8 differ in a bit with a
    chance of 0.152 and meet in no table with one of 6e-4, at 0.85 of 1e-5 (computed for independent bits), short ones more
    often. Candidates only gather texts, whose sets are then compared exactly; sets that no table has gathered are found by
    their rarest common shingles and compared likewise (``missed``), so no link is lost whatever the bits. Bits that more
    than ``largest`` sets share gather all of them, and candidates of more than ``block`` shingles are compared block by
    block, so no table's bits, group or set of candidates is held whole. Texts without words are equal. A
    group without any doc_id keeps one of its rows; a row is chosen by doc_id and content, so rows of one doc_id with
    different texts stay if their groups differ.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    k1, k2 = F.xxhash64(*names), F.xxhash64(F.lit(1), *names)
    texts = docs.select(k1.alias("k1"), k2.alias("k2"), F.col("doc_id"), F.col("text"))
    found = materialize(sketches(texts), "copies-rows")
    first = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "k1", "k2")
    folded = found.groupBy("node").agg(F.min(first).alias("first"), F.min("size").alias("size"), F.min("code").alias("code"))
    folded = materialize(folded, "copies-folded")
    near = candidates(folded, largest)
    wanted = folded.join(near.hint("merge"), "node").select("near", "node", "size", F.col("first.k1").alias("k1"), F.col("first.k2").alias("k2"))
    label = labelled(materialize(wanted, "copies-wanted"), texts, block)
    more = missed(folded, near, texts, block).filter("node <> label")
    if not more.isEmpty():
        label = components(label.union(more).select(F.col("node").alias("a"), F.col("label").alias("b")))
    groups = folded.select("node", "first").join(label.hint("merge"), "node", "left").groupBy(F.coalesce("label", "node")).agg(F.min("first").alias("first"))
    own = [fresh(docs, "own_k1"), fresh(docs, "own_k2")]
    kept = groups.select(F.col("first.k1").alias(own[0]), F.col("first.k2").alias(own[1]))
    keyed = docs.withColumns(dict(zip(own, (k1, k2), strict=True))).join(kept.hint("merge"), own, "left_semi")
    return keyed.dropDuplicates(own).select(names)
