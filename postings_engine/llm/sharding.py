"""Sharding by best-fit-decreasing bin packing of indivisible groups of equal texts.

Groups that are larger than a fixed share of a bin are units of their own; all smaller ones are
bundled, by a hash of their text, into a fixed number of units. So the units that are packed, one by
one, are bounded in number whatever the table's size: by UNITS_PER_BIN for each bin, twice over.
Units go by falling size into the bin with the least room that still takes them, found in a balanced
tree of (room, bin); a unit that no bin takes goes to a new bin, or, if their number is fixed, to the
one with the most room.

Slots run without gaps from 0 in each shard, in order of unit, chunk and doc_id. Chunks split the
rows of a unit, so that no task sorts more than a chunk of a shard, whatever the group sizes.

Defined cases. A null text has no bytes and is a group of its own kind, apart from the empty text.
Rows with equal doc_id, or none, are rows like others. An empty table gives no rows. Only doc_id and
text are read."""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch

ROW_BYTES = 16
#: A group is a unit of its own if it is larger than a bin's share by this number.
UNITS_PER_BIN = 250
CHUNK_ROWS = 1_000


class RoomTree:
    """Ordered set of (room, bin) as a two-level balanced tree: leaves of bounded size under a root
    of their first entries; a full leaf is split, an empty one removed."""

    LEAF = 256

    def __init__(self):
        self.leaves: list[list[tuple[int, int]]] = []
        self.firsts: list[tuple[int, int]] = []

    def add(self, entry: tuple[int, int]) -> None:
        if not self.leaves:
            self.leaves, self.firsts = [[entry]], [entry]
            return
        at = max(0, bisect.bisect_right(self.firsts, entry) - 1)
        leaf = self.leaves[at]
        bisect.insort(leaf, entry)
        if len(leaf) > self.LEAF:
            half = len(leaf) // 2
            self.leaves[at: at + 1] = [leaf[:half], leaf[half:]]
            self.firsts[at: at + 1] = [leaf[0], leaf[half]]
        else:
            self.firsts[at] = leaf[0]

    def _take(self, at: int, i: int) -> tuple[int, int]:
        entry = self.leaves[at].pop(i)
        if self.leaves[at]:
            self.firsts[at] = self.leaves[at][0]
        else:
            del self.leaves[at], self.firsts[at]
        return entry

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Takes out the entry with the least room of at least `size`; None if there is none."""
        wanted = (size, -1)
        at = max(0, bisect.bisect_right(self.firsts, wanted) - 1)
        while at < len(self.leaves):
            i = bisect.bisect_left(self.leaves[at], wanted)
            if i < len(self.leaves[at]):
                return self._take(at, i)
            at += 1
        return None

    def roomiest(self) -> tuple[int, int]:
        return self._take(len(self.leaves) - 1, len(self.leaves[-1]) - 1)


def pack(sizes: list[tuple[int, int]], capacity: int, bins: int | None = None) -> dict[int, int]:
    """(unit, size) pairs -> bin of each unit. With `bins`, their number is fixed and a unit that fits
    nowhere goes to the bin with the most room; without, it opens a new bin."""
    tree, out, opened = RoomTree(), {}, 0
    for b in range(bins or 0):
        tree.add((capacity, b))
    for unit, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        found = tree.tightest(size)
        if found is None and bins:
            found = tree.roomiest()
        elif found is None:
            found, opened = (max(capacity, size), opened), opened + 1
        out[unit] = found[1]
        tree.add((found[0] - size, found[1]))
    return out


def level(sizes: list[int], bins: int) -> int:
    """The size that bins come to if all of them end near equal; a unit above it fills a bin alone."""
    left, rest = sum(sizes), bins
    for size in sorted(sizes, reverse=True):
        if rest == 1 or size * rest <= left:
            break
        left, rest = left - size, rest - 1
    return -(-left // rest)


def shard(docs: DataFrame, shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, size, text_crc32, shard, slot). Give the number of shards, whose
    sizes then come out near equal, or a capacity in bytes, of which the fewest shards are used."""
    scratch = Scratch(docs.sparkSession, "sharding")
    rows = scratch.save(docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(F.col("text"), F.col("text").isNull()).alias("text_group")), "rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    share = -(-total // shards) if shards else capacity
    bins = shards or max(1, -(-total // capacity))
    bundles = bins * UNITS_PER_BIN
    # at most bins * UNITS_PER_BIN groups are that large
    large = rows.groupBy("text_group").agg(F.sum("size").alias("group_size")).where(F.col("group_size") * UNITS_PER_BIN > share).select("text_group", F.lit(True).alias("large"))
    # a bundle's number is not negative, a large group's is
    named = rows.join(F.broadcast(large), "text_group", "left").withColumn(
        "unit", F.when(F.col("large"), -F.pmod("text_group", F.lit(2**62)) - 1).otherwise(F.pmod("text_group", F.lit(bundles)))).drop("large", "text_group")
    named = scratch.save(named, "units")
    units = named.groupBy("unit").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # at most 2 * bins * UNITS_PER_BIN
    sizes = [(u["unit"], u["size"]) for u in units]
    placed = pack(sizes, level([size for _, size in sizes], shards) if shards else capacity, shards)
    plan = docs.sparkSession.createDataFrame([(u["unit"], placed[u["unit"]], -(-u["n"] // CHUNK_ROWS)) for u in units], "unit long, shard int, chunks long")
    spread = named.join(F.broadcast(plan), "unit").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), "chunks"))
    counts = spread.groupBy("shard", "unit", "chunk").agg(F.count("*").alias("n"))  # a row for each unit and CHUNK_ROWS rows
    before = counts.select("unit", "chunk", F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("unit", "chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(W.partitionBy("unit", "chunk").orderBy("doc_id", "text_crc32"))
    return (spread.withColumn("rank", rank).join(before, ["unit", "chunk"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("rank") - 1).cast("long").alias("slot")))
