"""Exact Jaccard links of sets of hashes: shared by the n-gram join and the line dedup.

1. `shared_keys`: rows (key, node), streamed by key; rows whose key has other nodes stay.
2. `likely_links`: under each key, the bit counts of bitmap signatures bound the overlap of two
   sets from above; pairs that may still link are joined to a forest. Its components, the clusters,
   hold every link. A key of more nodes than a task may hold is compared block with block.
3. `tiles`: clusters are cut into tiles of bounded weight, by size band.
4. `verify`: within a tile, wider bitmaps prune again, what is left is intersected exactly, and a
   spanning forest of the links comes out.

A bitmap holds, per hash bucket, the parity of how many members of the set fall in it; where two
bitmaps differ, the sets differ at least once, so with d differing bits the overlap is at most
(|A| + |B| - d) / 2."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, given_back

LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Hashes in one side of a tile: 3 MB. A smaller set counts as LEAST hashes, which bounds the sets.
TILE = 400_000
LEAST = 150
#: Nodes that are held at once to be compared with each other, and how many of them one by one.
HELD, FEW = 20_000, 24


def shared_keys(entries: DataFrame, held: int = HELD) -> DataFrame:
    """(key, node) long -> (key, node, block): the rows whose key has at least two nodes, each once.
    A key's nodes are numbered into blocks of half of `held`, so that no key's group has to be held
    and any two blocks can be."""
    kept = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("block", pa.int64())])
    size = max(1, held // 2)

    @given_back
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # what is open at a batch's end: the last key, its last node, its number of nodes
        open_key = open_last = None
        open_rank = 0
        for rows in batches:
            if not rows.num_rows:
                continue
            key, node = (rows.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            same = np.empty(len(key), bool)
            same[0] = key[0] == open_key
            same[1:] = key[1:] == key[:-1]
            again = same.copy()
            again[0] &= node[0] == open_last
            again[1:] &= node[1:] == node[:-1]
            key, node, same = key[~again], node[~again], same[~again]
            if not len(key):
                continue
            at = np.arange(len(key))
            start = np.maximum.accumulate(np.where(same, -1, at))
            rank = np.where(start < 0, at + open_rank, at - start)
            grouped = same.copy()
            grouped[:-1] |= same[1:]
            if same[0] and open_rank == 1:  # the open key's only node so far had no other one yet
                yield pa.RecordBatch.from_arrays([pa.array([open_key]), pa.array([open_last]), pa.array([0], pa.int64())], schema=kept)
            open_key, open_last, open_rank = key[-1], node[-1], int(rank[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(x[grouped]) for x in (key, node, rank // size)], schema=kept)

    ordered = entries.select("key", "node").repartition("key").sortWithinPartitions("key", "node")
    return ordered.mapInArrow(stream, "key long, node long, block long")


def marks(values: np.ndarray, at: np.ndarray, wider: int = 0) -> list[bytes]:
    """A parity bitmap of each row's set, of 64 bits or at least half as many as the set has members,
    doubled `wider` times."""
    n = np.diff(at)
    out: list[bytes] = [b""] * len(n)
    bits = np.maximum(64, 1 << np.maximum(np.frexp(n.astype(float))[1] - 1, 0)) << wider
    for width in np.unique(bits):
        rows = np.flatnonzero(bits == width)
        start = np.cumsum(n[rows]) - n[rows]
        flat = values[np.repeat(at[rows] - start, n[rows]) + np.arange(int(n[rows].sum()))]
        cell = np.repeat(np.arange(len(rows)) * width, n[rows]) + (flat & np.uint64(width - 1)).astype(np.int64)
        odd = (np.bincount(cell, minlength=len(rows) * width) & 1).astype(np.uint8).reshape(len(rows), width)
        packed = np.packbits(odd, axis=1, bitorder="little")
        for i, r in enumerate(rows):
            out[r] = packed[i].tobytes()
    return out


def _folded(mark: int, bits: int, to: int) -> int:
    while bits > to:
        bits //= 2
        mark = (mark >> bits) ^ (mark & ((1 << bits) - 1))
    return mark


def _wide_forest(nodes: list[int], sizes: list[int], maps: list[int], bits: int, num: int, den: int) -> Iterator[tuple[int, int]]:
    """The same for many nodes: by rising size, each against all later ones of a fitting size that it
    is not yet connected with, at once."""
    n = np.array(sizes)
    order = np.argsort(n, kind="stable")
    n, ids = n[order], np.array(nodes)[order]
    words = np.frombuffer(b"".join(maps[i].to_bytes(bits // 8, "little") for i in order), np.uint64).reshape(len(n), -1)
    root = np.arange(len(n))
    ends = np.searchsorted(n, n * den // num, side="right")
    for i in range(len(n)):
        other = np.flatnonzero(root[i + 1: ends[i]] != root[i]) + i + 1
        if not len(other):
            continue
        both = n[i] + n[other]
        bound = np.minimum((both - np.bitwise_count(words[i] ^ words[other]).sum(axis=1, dtype=np.int64)) // 2, n[i])
        near = other[den * bound >= num * (both - bound)]
        if len(near):
            joined, first = np.unique(root[near], return_index=True)
            for j in near[first]:
                yield int(ids[j]), int(ids[i])
            root[np.isin(root, joined)] = root[i]


def likely_links(shared: DataFrame, signatures: DataFrame, num: int, den: int) -> DataFrame:
    """shared(key, node, block), signatures(node, n, mark) -> distinct links (a, b): a forest, under
    each key, of the pairs whose bitmaps allow den * overlap >= num * union. Of a key with more than
    two blocks, every two blocks are a group of their own."""
    def forest(nodes, sizes, raw):
        bits = min(len(m) for m in raw) * 8
        maps = [_folded(int.from_bytes(m, "little"), len(m) * 8, bits) for m in raw]
        if len(nodes) > FEW:
            yield from _wide_forest(nodes, sizes, maps, bits, num, den)
            return
        root = list(range(len(nodes)))
        for i in range(len(nodes)):
            for j in range(i + 1, len(nodes)):
                if root[i] != root[j]:
                    both = sizes[i] + sizes[j]
                    bound = min((both - (maps[i] ^ maps[j]).bit_count()) // 2, sizes[i], sizes[j])
                    if den * bound >= num * (both - bound):
                        yield nodes[j], nodes[i]
                        old, new = root[j], root[i]
                        root = [new if r == old else r for r in root]

    def forest_of(nodes, sizes, raw):
        if len(nodes) == 2 and (den * min(sizes) < num * max(sizes) or nodes[0] == nodes[1]):
            return ()  # the sizes alone keep them apart
        return forest(nodes, sizes, raw)

    @given_back
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, group = None, ([], [], [])
        for rows in batches:
            found: list[tuple[int, int]] = []
            for key, node, n, mark in zip(*(c.to_pylist() for c in rows.columns)):
                if key != last:
                    if len(group[0]) > 1:
                        found.extend(forest_of(*group))
                    last, group = key, ([], [], [])
                for x, y in zip(group, (node, n, mark)):
                    x.append(y)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], schema=LINKS)
        if len(group[0]) > 1:
            found = list(forest_of(*group))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], schema=LINKS)

    known = shared.join(signatures, "node").select("key", "node", "block", "n", "mark")
    # keys of more than two blocks: at most one for each HELD rows of shared
    large = shared.where("block > 1").groupBy("key").agg(F.max("block").alias("last"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), "last"), lambda o: o != F.col("block"))
    groups = F.transform(others, lambda o: F.xxhash64("key", F.least("block", o), F.greatest("block", o)))
    known = known.join(F.broadcast(large), "key", "left").withColumn("group", F.explode(F.when(F.col("last").isNull(), F.array("key")).otherwise(groups)))
    ordered = known.select("group", "node", "n", "mark").repartition("group").sortWithinPartitions("group", "node")
    return ordered.mapInArrow(stream, "a long, b long").distinct()


def tiles(members: DataFrame, threshold: float, scratch: Scratch, tile: int = TILE) -> DataFrame:
    """members(id, n, cluster, ...) -> the same with (tile, side): rows of a tile are compared with
    each other (side 0 with 0), or across (side 0 with 1). A cluster of at most `tile` hashes is one
    tile; a larger one is cut by size band, and a large band into chunks by a hash of the id."""
    load = F.greatest("n", F.lit(LEAST))
    totals = members.groupBy("cluster").agg(F.sum(load).alias("weight"))
    rows = members.join(totals, "cluster")
    whole = rows.where(F.col("weight") <= tile).withColumn("tile", F.xxhash64("cluster")).withColumn("side", F.lit(0)).drop("weight")
    step = 1.000001 * math.log(1 / threshold)
    large = scratch.save(rows.where(F.col("weight") > tile).drop("weight").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / step)), "large")
    chunks = large.groupBy("cluster", "band").agg(F.ceil(F.sum(load) / tile).alias("k"))
    above = chunks.select("cluster", (F.col("band") - 1).alias("band"), F.col("k").alias("k_above"))
    below = chunks.select("cluster", (F.col("band") + 1).alias("band"), F.col("k").alias("k_below"))
    known = chunks.join(above, ["cluster", "band"], "left").join(below, ["cluster", "band"], "left")
    cut = large.join(known, ["cluster", "band"]).withColumn("c", F.pmod(F.xxhash64("id"), "k"))

    def others(k):
        return F.when(F.col(k) > 0, F.sequence(F.lit(0).cast("long"), F.col(k) - 1)).otherwise(F.array().cast("array<long>"))
    pairs = F.concat(
        F.transform(others("k"), lambda o: F.struct(F.col("band").alias("b1"), F.least("c", o).alias("c1"), F.col("band").alias("b2"), F.greatest("c", o).alias("c2"), (F.col("c") > o).cast("int").alias("side"))),
        F.transform(others("k_above"), lambda o: F.struct(F.col("band").alias("b1"), F.col("c").alias("c1"), (F.col("band") + 1).alias("b2"), o.alias("c2"), F.lit(0).alias("side"))),
        F.transform(others("k_below"), lambda o: F.struct((F.col("band") - 1).alias("b1"), o.alias("c1"), F.col("band").alias("b2"), F.col("c").alias("c2"), F.lit(1).alias("side"))))
    spread = cut.withColumn("p", F.explode(pairs))
    spread = spread.withColumn("tile", F.xxhash64("cluster", "p.b1", "p.c1", "p.b2", "p.c2")).withColumn("side", F.col("p.side"))
    return whole.unionByName(spread.select(*whole.columns))


class Sets:
    """Some sets of one tile, by rising size: ids, sides and sorted hashes."""

    def __init__(self, ids, sides, values):
        n = np.array([len(v) for v in values])
        order = np.argsort(n, kind="stable")
        self.n, self.ids, self.sides = n[order], np.asarray(ids)[order], np.asarray(sides)[order]
        self.values = [values[i] for i in order]
        self.cross = len(np.unique(self.sides)) > 1

    def bitmaps(self, lo: int, hi: int, bits: int) -> np.ndarray:
        """Parity bitmaps of sets lo..hi as rows of 64-bit words."""
        flat = np.concatenate(self.values[lo:hi]) & np.uint64(bits - 1)
        cell = np.repeat(np.arange(hi - lo) * bits, self.n[lo:hi]) + flat.astype(np.int64)
        odd = (np.bincount(cell, minlength=(hi - lo) * bits) & 1).astype(np.uint8).reshape(hi - lo, bits)
        return np.packbits(odd, axis=1).view(np.uint64)


def linked_pairs(sets: Sets, num: int, den: int) -> np.ndarray:
    """For each set the smallest id it is connected with inside the tile, by links with
    den * overlap >= num * union. Pairs already connected are not compared again."""
    m, root = len(sets.n), np.arange(len(sets.n))
    lo = 0
    while lo < m:
        # a band of sizes, and with it the sizes that its largest set may link with
        top = int(sets.n[lo]) * den // num
        hi = int(np.searchsorted(sets.n, top, side="right"))
        far = int(np.searchsorted(sets.n, int(sets.n[hi - 1]) * den // num, side="right"))
        bits = max(64, 1 << int(sets.n[hi - 1]).bit_length() - 1)
        marks = sets.bitmaps(lo, far, bits)
        for i in range(lo, hi):
            end = int(np.searchsorted(sets.n, int(sets.n[i]) * den // num, side="right"))
            other = np.flatnonzero((root[i + 1: end] != root[i]) & ~((sets.sides[i + 1: end] == sets.sides[i]) & sets.cross)) + i + 1
            if not len(other):
                continue
            differ = np.bitwise_count(marks[i - lo] ^ marks[other - lo]).sum(axis=1, dtype=np.int64)
            both = sets.n[i] + sets.n[other]
            bound = (both - differ) // 2
            for j in other[den * bound >= num * (both - bound)]:
                if root[j] == root[i]:
                    continue
                small, big = sets.values[i], sets.values[j]
                found = np.searchsorted(big, small)
                overlap = int(np.count_nonzero(big[np.minimum(found, len(big) - 1)] == small))
                if den * overlap >= num * (len(small) + len(big) - overlap):
                    root[root == root[j]] = root[i]
        lo = hi
    smallest = np.full(m, np.iinfo(np.int64).max)
    np.minimum.at(smallest, root, sets.ids)
    return smallest[root]


def _as_stored(raw: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(h, np.uint64) for h in raw]


def verify(rows: DataFrame, num: int, den: int, read: Callable[[list[bytes]], list[np.ndarray]] = _as_stored) -> DataFrame:
    """rows(tile, side, id, hashes): sorted distinct hashes as little-endian bytes, or what `read` makes
    such hashes of -> links (a, b) that connect, within each tile, just what exact links connect. Rows
    are streamed by tile; a tile has a bounded number of hashes on each side."""
    def close(ids, sides, values):
        if len(ids) < 2:
            return None
        if len(ids) == 2:  # most tiles
            small, big = sorted(values, key=len)
            overlap = int(np.count_nonzero(big[np.minimum(np.searchsorted(big, small), len(big) - 1)] == small)) if den * len(small) >= num * len(big) else 0
            if ids[0] == ids[1] or not overlap or den * overlap < num * (len(small) + len(big) - overlap):
                return None
            return pa.RecordBatch.from_arrays([pa.array([max(ids)], pa.int64()), pa.array([min(ids)], pa.int64())], schema=LINKS)
        sets = Sets(ids, sides, values)
        low = linked_pairs(sets, num, den)
        out = low != sets.ids
        return pa.RecordBatch.from_arrays([pa.array(sets.ids[out]), pa.array(low[out])], schema=LINKS) if out.any() else None

    @given_back
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, ids, sides, values = None, [], [], []
        for rows in batches:
            for t, s, i, h in zip(*(c.to_pylist() for c in rows.columns[:3]), read(rows.column(3).to_pylist())):
                if t != tile:
                    if (done := close(ids, sides, values)) is not None:
                        yield done
                    tile, ids, sides, values = t, [], [], []
                ids.append(i)
                sides.append(s)
                values.append(h)
        if (done := close(ids, sides, values)) is not None:
            yield done

    ordered = rows.select("tile", "side", "id", "hashes").repartition("tile").sortWithinPartitions("tile")
    return ordered.mapInArrow(stream, "a long, b long").distinct()
