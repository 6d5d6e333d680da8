"""Merkle manifest of a table, with a proof for every row by pointer jumping.

Every row is a leaf: the digest of its columns. The leaves of a group stand in the order of their
ids; runs of `arity` nodes become one node, level by level, until one is left, the group's subroot.
The subroots, in order of the groups, make a tree by the same rule; its last node is the root.

A node knows its way to an ancestor: for every level up to there the siblings left and right of it.
Round r joins the nodes whose level is a multiple of 2^r, and that have ways of 2^(r-1) levels, with
their ancestors' ways of as many and joins the two up, so ways double until every leaf has its way
to its subroot, and one more join takes it on to the root. The nodes that are read as ancestors are
fewer by arity ** 2^(r-1) in every round; a way that ends at a subroot stays as it is.

A node high up is the ancestor of all leaves of a large group, so the leaves are dealt by blocks of
arity ** BLOCK_LEVELS, and an ancestor above that level goes to each block below it: no key of a
join has more rows than a block, however large a group is.

Defined cases. Nulls count as `-` in a leaf; rows without a group or without an id come first. Rows
of equal id stand in order of their digests; equal rows are leaves like others. A null or empty text
is a leaf like others. An empty table has no leaf and gives no row. Columns other than those given
are not read. Digests travel as 32 bytes and are hashed as lower-case hex."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch

#: A block of 3 ** 9 leaves, 19,683 rows of a few hundred bytes.
BLOCK_LEVELS = 9
STEPS = "array<struct<left:binary,right:binary>>"


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def digest(*inputs: Column) -> Column:
    """sha256 of the concatenated inputs, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*inputs).cast("binary"), 256))


def field(value: Column) -> Column:
    """A value with its UTF-8 byte count before it, so that no two rows concatenate alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return digest(*(field(v) for v in values))


def placed(rows: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """rows(grp, ...) with `place`, gapless from 0 in each group by `order`, and `n`, the group's rows.
    Rows are dealt by ranges of (grp, *order), so that a large group is split over many tasks."""
    names = [c for c in rows.columns if c != "grp"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            groups, place = batch.column(0), np.empty(batch.num_rows, np.int64)
            new = np.flatnonzero(pc.not_equal(groups[1:], groups[:-1]).to_numpy(zero_copy_only=False)) + 1
            for a, b in zip([0, *new], [*new, batch.num_rows]):
                if a < b:
                    seen, last = (seen if groups[a].as_py() == last else 0), groups[a].as_py()
                    place[a:b] = np.arange(seen, seen + b - a)
                    seen += b - a
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=[*batch.schema.names, "place"])

    ddl = ", ".join([*(f"{c} {kinds[c]}" for c in ("grp", *names)), "part int", "place long"])
    # the part is written with the rows, so that a task that runs again cannot number them otherwise
    dealt = rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    local = scratch.save(dealt.select("grp", *names, F.spark_partition_id().alias("part")).mapInArrow(count, ddl), "local")
    counts = local.groupBy("grp", "part").agg(F.count("*").alias("in_part"))  # a row for each part and group
    group = W.partitionBy("grp")
    before = F.sum("in_part").over(group.orderBy("part")) - F.col("in_part")
    starts = counts.select("grp", "part", before.alias("before"), F.sum("in_part").over(group).alias("n"))
    return scratch.save(local.join(starts, ["grp", "part"]).select("grp", (F.col("before") + F.col("place")).alias("place"), "n", *names), "placed")


@dataclass
class Tree:
    """ways: for each level its nodes' ways to their parents (grp, place, n, up, steps), with `up` their
    number of levels; the leaves, at level 0, have their other columns too. tops: (grp, n, top)."""
    ways: list[DataFrame]
    tops: DataFrame

    @property
    def height(self) -> int:
        return len(self.ways) - 1


def grow(leaves: DataFrame, arity: int, scratch: Scratch) -> Tree:
    """The trees over leaves(grp, place, n, digest, ...), level by level."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    more = [c for c in leaves.columns if c not in ("grp", "place", "n")]
    alone = leaves.where("n = 1")
    ways, nodes, tops, width = [], leaves, alone.select("grp", "n", F.col("digest").alias("top")), 1
    while width < most:
        # a group ends at the level that holds one node of it; a run has at most `arity` members
        members = F.array_sort(F.collect_list(F.struct("place", "digest", *(c for c in more if c != "digest"))))
        runs = nodes.where(F.col("n") > width).groupBy("grp", part_of(F.col("place"), arity).alias("parent")).agg(F.first("n").alias("n"), members.alias("members"))
        joined = F.concat_ws("", F.transform("members", lambda m: hexed(m["digest"])))
        runs = scratch.save(runs.withColumn("digest", digest(joined)), f"level{len(ways) + 1}")

        def beside(side):
            return F.unhex(F.concat_ws("", F.transform(F.filter("members", side), lambda m: F.hex(m["digest"]))))
        way = F.transform("members", lambda m: F.struct(m.alias("m"), F.array(F.struct(
            beside(lambda o: o["place"] < m["place"]).alias("left"), beside(lambda o: o["place"] > m["place"]).alias("right"))).alias("steps")))
        columns = more if not ways else []
        ways.append(runs.select("grp", "n", F.explode(way).alias("w")).select("grp", "w.m.place", "n", F.lit(1).alias("up"), "w.steps", *(f"w.m.{c}" for c in columns)))
        width, more = width * arity, ["digest"]
        nodes = runs.select("grp", F.col("parent").alias("place"), "n", "digest")
        tops = tops.unionByName(nodes.where(F.col("n") <= width).select("grp", "n", F.col("digest").alias("top")))
    ended = alone.withColumn("up", F.lit(0)).withColumn("steps", F.array().cast(STEPS))
    return Tree([ways[0].unionByName(ended) if ways else ended, *ways[1:]], scratch.save(tops, "tops"))


def part_of(place: Column, width: int) -> Column:
    return F.floor(place / F.lit(width)).cast("long")


def jump(children: DataFrame, level: int, span: int, parents: DataFrame, arity: int) -> DataFrame:
    """Children of `level` that have ways of `span` levels -> ways of up to twice as many, by their
    ancestors' ways. Both sides are dealt by blocks of children."""
    deep = min(span, BLOCK_LEVELS)
    width = arity ** (span - deep)  # blocks below an ancestor
    last = part_of(F.col("n") - 1, arity ** (level + deep))  # a group's last block
    above = parents.select("grp", F.explode(F.sequence(F.col("place") * width, F.least(F.col("place") * width + (width - 1), last))).alias("block"),
                           F.col("up").alias("more_up"), F.col("steps").alias("more"))
    # a way that has ended at a subroot needs no ancestor: its block matches nothing
    block = part_of(F.col("place"), arity ** deep)
    own = children.withColumn("block", F.when(F.col("up") == span, block).otherwise(-1 - block))
    joined = own.join(above, ["grp", "block"], "left")
    return joined.withColumn("steps", F.concat("steps", F.coalesce("more", F.array().cast(STEPS)))).withColumn(
        "up", F.col("up") + F.coalesce("more_up", F.lit(0))).drop("block", "more", "more_up")


def whole_ways(tree: Tree, arity: int, scratch: Scratch) -> DataFrame:
    """The leaves with `steps`, their ways to the last node, by repeated self-joins of the nodes."""
    held, nodes, span = tree.ways[0], dict(enumerate(tree.ways[1:], 1)), 1
    while span <= tree.height:
        held = jump(held, 0, span, nodes[span], arity)
        nodes = {level: scratch.save(jump(ways, level, span, nodes[level + span], arity), f"jump{2 * span}-{level}") if level + span in nodes else ways
                 for level, ways in nodes.items() if level % (2 * span) == 0}
        span *= 2
    return held.drop("up")


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings lead to, as 32 bytes."""
    return F.aggregate(steps, leaf, lambda node, step: digest(hexed(step["left"]), hexed(node), hexed(step["right"])))


def proof_digest(steps: Column) -> Column:
    """Digest of a way's siblings, level by level, left to right."""
    return digest(F.concat_ws("", F.transform(steps, lambda s: F.concat(hexed(s["left"]), hexed(s["right"])))))


def manifest(rows: DataFrame, arity: int = 3) -> DataFrame:
    """rows(grp, id, digest, ...) -> the same with (subroot, root, steps): every leaf's whole proof. `grp`
    orders the groups bytewise and is not null; digests are binary."""
    scratch = Scratch(rows.sparkSession, "merkle")
    # equal rows are told apart by a number, so that ranges can part them
    saved = scratch.save(rows.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    tree = grow(placed(saved, ["id", "digest", "tie"], scratch).drop("tie"), arity, scratch)
    groups = placed(tree.tops.select(F.lit("").alias("grp"), F.col("grp").alias("own"), F.col("n").alias("own_n"), F.col("top").alias("digest")), ["own"], scratch)
    upper = grow(groups, arity, scratch)
    last = upper.tops.first()
    onward = scratch.save(whole_ways(upper, arity, scratch).select(
        F.col("own").alias("grp"), "own_n", F.col("digest").alias("subroot"), F.col("steps").alias("onward")), "onward")
    # the way from a subroot goes to every block of its group
    width = arity ** BLOCK_LEVELS
    spread = onward.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), part_of(F.col("own_n") - 1, width)))).drop("own_n")
    held = whole_ways(tree, arity, scratch).withColumn("block", part_of(F.col("place"), width))
    root = F.lit(bytearray(last["top"] if last else b""))
    return held.join(spread, ["grp", "block"]).withColumn("steps", F.concat("steps", "onward")).withColumn("root", root).drop("block", "onward", "place", "n")


def verified_manifest(docs: DataFrame, tampered_text: Column, tampered: Column, arity: int = 3) -> DataFrame:
    """A row for each row of docs(doc_id, source, lang, n_chars, text): its leaf, subroot, root and the
    digest of its proof, and what the leaf of its text as found later (tampered_text where `tampered`
    holds) leads to with the same siblings."""
    names = ("doc_id", "source", "lang", "n_chars", "text")
    leaf = leaf_of(*(F.col(c) for c in names))
    found = F.when(tampered, leaf_of(*(F.col(c) for c in names[:4]), tampered_text))
    # null sorts before all others, and a source's name bytewise
    group = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    rows = docs.select(group.alias("grp"), F.col("doc_id").alias("id"), leaf.alias("digest"), found.alias("found"))
    proofs = manifest(rows, arity)
    folded = fold(F.coalesce("found", "digest"), F.col("steps"))
    out = proofs.select(F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.select("doc_id", *(hexed(F.col(c)).alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), (F.col("folded_root") == F.col("root")).alias("verified"))
