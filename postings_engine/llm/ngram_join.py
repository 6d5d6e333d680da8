"""N-gram Jaccard join: which documents have nearly the same set of word shingles, found exactly.

Every text is hashed whole. Sets that are equal are one node. Candidates come from cutting each
set, by the range of its hashes, into more segments than two linked sets of its size class can
differ in: one segment at least is then equal in both. Parity bitmaps, hashed from the sets, bound
the overlap of such pairs from above; those that may link form clusters, which are cut into
size-banded tiles, where wider bitmaps prune again before sorted arrays are intersected. Components
of the links follow by star contractions.

Defined cases. Null and empty texts, and texts of separators only, have no shingles: n_shingles 0,
linked with nothing, component of their own. A text of fewer words than the width is one shingle.
A null doc_id takes part in nothing (component_id null). Rows that share a doc_id are each judged by
their own text; where one doc_id stands for several sets, these count as linked. Only doc_id and text are read, so other columns may have any name."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batch, given_back
from .components import components
from .hashing import U, digests, mix, row_sums, shingles, text_pieces, words
from .prefilter import narrowed
from .setjoin import likely_links, marks, shared_keys, tiles, verify

SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("mark", pa.binary())])
ENTRIES = pa.schema([("key", pa.int64()), ("node", pa.int64())])
ARRAYS = pa.schema([("tile", pa.int64()), ("side", pa.int32()), ("id", pa.int64()), ("hashes", pa.binary())])
#: Sets that one task remembers to write their segments once.
REMEMBERED = 200_000


class SizeClasses:
    """Classes of set sizes [low, next low) and, for each, the number of segments."""

    def __init__(self, num: int, den: int, largest: int = 1 << 40):
        low, at = [], 1
        while at <= largest:
            low.append(at)
            at = max(at + 1, at * 3 // 2)
        self.num, self.den = num, den
        self.low = np.array(low, np.int64)
        # the most members that two linked sets of the class can differ in
        self.differ = (den - num) * 2 * (np.append(self.low[1:], at) - 1) // (den + num)
        m = self.differ + 1
        self.segments = np.where(m < 4, m, m + 1 + m // 64)
        # the smallest set that may link with one of the class
        self.least = -(-self.low * num // den)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, n, side="right") - 1


def segment_keys(values: np.ndarray, at: np.ndarray, classes: SizeClasses) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of the segments of each row's set, in its own size class and in each higher one
    that holds sets it may link with. Classes in which only equal sets link give no key."""
    n = np.diff(at)
    row, own = np.flatnonzero(n), classes.of(n[n > 0])
    keys, rows, step = [], [], 0
    while len(row):
        k = own + step
        ok = (k < len(classes.low))
        ok[ok] &= n[row[ok]] >= classes.least[k[ok]]
        if step:
            row, own, k = row[ok], own[ok], k[ok]
        step += 1
        use = classes.differ[k] > 0
        if not use.any():
            if not len(row):
                break
            continue
        r, c = row[use], k[use]
        m = classes.segments[c]
        size = n[r]
        start = np.cumsum(size) - size
        flat = values[np.repeat(at[r] - start, size) + np.arange(int(size.sum()))]
        seg = ((flat >> U(32)) * np.repeat(m, size).astype(U)) >> U(32)
        of = np.repeat(np.arange(len(r)), size)
        new = np.empty(len(flat), bool)
        new[0] = True
        new[1:] = (seg[1:] != seg[:-1]) | (of[1:] != of[:-1])
        first = np.flatnonzero(new)
        label = mix(seg[first] + (c[of[first]].astype(U) << U(40)))
        keys.append(mix(np.add.reduceat(mix(flat), first) + label))
        rows.append(r[of[first]])
        # too many empty segments: the empty ones count as well, as two such sets may share only them
        filled = np.bincount(of[first], minlength=len(r))
        for x in np.flatnonzero(filled <= classes.differ[c]):
            empty = np.setdiff1d(np.arange(m[x], dtype=U), seg[first[of[first] == x]])
            keys.append(mix(mix(empty + (U(int(c[x])) << U(40))) ^ U(0xE6546B64)))
            rows.append(np.full(len(empty), r[x]))
    if not keys:
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(rows)


def shingle_sets(docs: DataFrame, width: int, wider: int = 0) -> DataFrame:
    """(doc_id, n, d1, d2, mark): size of each row's set, two digests and a bitmap of it, doubled
    `wider` times."""
    @given_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for lo, hi, data, offsets in text_pieces(rows.column(1)):
                hashes, _, _, per_row = words(data, offsets)
                values, at = shingles(hashes, per_row, width)
                d1, d2 = digests(values, at)
                yield batch(SETS, rows.column(0).slice(lo, hi - lo), np.diff(at), d1.view(np.int64), d2.view(np.int64), marks(values, at, wider))
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long, mark binary")


def _entries(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(key, node = d1) of every document's segments; a task writes equal sets once."""
    @given_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, known = SizeClasses(num, den), set()
        for rows in batches:
            for _, _, data, offsets in text_pieces(rows.column(0)):
                hashes, _, _, per_row = words(data, offsets)
                values, at = shingles(hashes, per_row, width)
                d1, _ = digests(values, at)
                keys, row = segment_keys(values, at, classes)
                if len(known) > REMEMBERED:
                    known.clear()
                fresh = np.zeros(len(d1), bool)
                for i, d in enumerate(d1.tolist()):
                    if d not in known:
                        known.add(d)
                        fresh[i] = True
                keep = fresh[row]
                yield batch(ENTRIES, keys[keep].view(np.int64), d1[row[keep]].view(np.int64))
    return docs.select("text").mapInArrow(run, "key long, node long")


def _hashed(members: DataFrame, width: int) -> DataFrame:
    """members(id, d1, d2, spots, text) -> (tile, side, id, hashes), a row for each of its spots in
    the tiles, of the rows whose text has the digests that are asked for."""
    @given_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for lo, hi, data, offsets in text_pieces(rows.column(4)):
                hashes, _, _, per_row = words(data, offsets)
                values, at = shingles(hashes, per_row, width)
                d1, d2 = digests(values, at)
                ids, want1, want2 = (rows.column(i).slice(lo, hi - lo).to_numpy(zero_copy_only=False) for i in range(3))
                spots = rows.column(3).slice(lo, hi - lo)
                for r in np.flatnonzero((d1.view(np.int64) == want1) & (d2.view(np.int64) == want2)):
                    of, own = spots[int(r)].as_py(), values[at[r]: at[r + 1]].tobytes()
                    yield batch(ARRAYS, [x["tile"] for x in of], [x["side"] for x in of], [int(ids[r])] * len(of), [own] * len(of))
    return members.select("id", "d1", "d2", "spots", "text").mapInArrow(run, "tile long, side int, id long, hashes binary")


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_shingles, component_id), a row per row. Two documents link
    when den * overlap >= num * union of their sets of `width`-word shingles (0.5 < num/den < 1)."""
    scratch = Scratch(docs.sparkSession, "ngram-join")
    # half of a bitmap's bits differ between unlike sets; linked ones may differ in this share of members
    wider = 1 if 10 * (den - num) > den + num else 0
    sets = scratch.save(shingle_sets(docs, width, wider), "sets")
    nodes = sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(
        F.min("doc_id").alias("id"), F.max("doc_id").alias("most"), F.min("n").alias("n"), F.min("mark").alias("mark"))
    nodes = scratch.save(nodes, "nodes")
    shared = scratch.save(shared_keys(_entries(docs, width, num, den)), "shared")
    links = likely_links(shared, nodes.select(F.col("d1").alias("node"), "n", "mark"), num, den)
    clusters = components(links, scratch, "cluster").select(F.col("node").alias("d1"), F.col("component").alias("cluster"))
    members = scratch.save(nodes.join(clusters, "d1").select("id", "n", "d1", "d2", "cluster"), "members")
    spots = tiles(members, num / den, scratch).groupBy("id", "d1", "d2").agg(F.collect_list(F.struct("tile", "side")).alias("spots"))
    texts = narrowed(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), "id", members)
    exact = scratch.save(verify(_hashed(texts.join(spots, "id"), width), num, den), "links")

    reached = components(exact, scratch, "component").select(F.col("node").alias("id"), "component")
    grouped = nodes.join(reached, "id", "left").where("component IS NOT NULL OR id < most").select(
        "d1", "d2", F.coalesce("component", "id").alias("component"))
    return sets.join(grouped, ["d1", "d2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each_group(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """docs without the documents that a smaller doc_id of their component stands for. Rows that are
    repeated with doc_id and text stay once; rows with a null doc_id all stay."""
    found = jaccard_components(docs, width, num, den)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    return left.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id IS NULL"))
