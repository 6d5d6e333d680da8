"""Centroid clustering of integer vectors by scalar lookup tables.

Components are turned into integers once and written in blocks of rows; a block holds, for each
dimension, the integers that occur in it and each row's number among these. In every round a block
tabulates, for each dimension, the squared difference of every occurring integer and every centroid's
component; the distances of all its rows are then table gathers and sums. Everything is in whole
numbers, so results do not depend on how rows are dealt. A task returns one sum for each centroid
and dimension; only centroids, of a number that is a parameter, come to the driver.

Defined cases. Vectors that are null, of another length, or with null or non-finite components are
left out, and so are those with a component whose integer is not below 2^27 in size, as a squared
distance of those might not fit 64 bits. Equal vectors and repeated ids are rows like others; a row
without an id is clustered, but starts no centroid unless too few rows have one. Fewer rows than
centroids give fewer centroids. An empty table gives no rows. Other columns are not read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, small_batches

#: Rows of a block. A table of a block has at most that many integers for each dimension.
BLOCK_ROWS = 4096
LARGEST = 2**27
BLOCK = "ids binary, known binary, sizes binary, integers binary, codes binary"


def valid_rows(vectors: pa.Array, dims: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, integers) of the vectors that are kept."""
    lengths = np.nan_to_num(vectors.value_lengths().to_numpy(zero_copy_only=False), nan=-1)
    rows = np.flatnonzero(lengths == dims)
    flat = vectors.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)  # null components become nan
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(flat * scale)
        good = np.all(np.abs(scaled) < LARGEST, axis=1)  # false for nan and infinity
    return rows[good], scaled[good].astype(np.int32)


def pack(ids: np.ndarray, known: np.ndarray, vectors: np.ndarray) -> list[bytes]:
    """A block: ids, which of them are known, and dictionary-encoded dimensions."""
    sizes, integers, codes = [], [], []
    for column in vectors.T:
        occurring, code = np.unique(column, return_inverse=True)
        sizes.append(len(occurring))
        integers.append(occurring.astype("<i4"))
        codes.append(code.astype("<u2"))
    return [ids.astype("<i8").tobytes(), known.astype("u1").tobytes(), np.array(sizes, "<i4").tobytes(), np.concatenate(integers).tobytes(), np.concatenate(codes).tobytes()]


class Block:
    def __init__(self, ids, known, sizes, integers, codes):
        self.ids, self.known = np.frombuffer(ids, "<i8"), np.frombuffer(known, "u1").astype(bool)
        ends = np.cumsum(np.frombuffer(sizes, "<i4"))
        self.integers = np.split(np.frombuffer(integers, "<i4").astype(np.int64), ends[:-1])
        self.codes = np.frombuffer(codes, "<u2").reshape(len(ends), -1)

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest centroid, squared distance) of every row; the smaller number wins a tie."""
        distance = np.zeros((len(self.ids), len(centroids)), np.int64)
        for integers, code, own in zip(self.integers, self.codes, centroids.T):
            table = np.square(integers[:, None] - own[None, :])
            distance += table[code]
        nearest = np.argmin(distance, axis=1)
        return nearest, distance[np.arange(len(nearest)), nearest]

    def sums(self, nearest: np.ndarray, k: int) -> np.ndarray:
        """For each centroid the sum of its rows' integers, by dimension; below 2^53, so exact as doubles."""
        return np.stack([np.bincount(nearest, integers[code], k) for integers, code in zip(self.integers, self.codes)], axis=1).astype(np.int64)


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            yield Block(*row)


def encode(vectors: DataFrame, dims: int, scale: float, scratch: Scratch) -> DataFrame:
    """vectors(vec_id, embedding) -> blocks of the vectors that are kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            rows = [np.concatenate(x) for x in zip(*held)]
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in pack(*rows)], names=["ids", "known", "sizes", "integers", "codes"])
        for batch in batches:
            rows, integers = valid_rows(batch.column(1), dims, scale)
            ids = batch.column(0).take(pa.array(rows))
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            for a in range(0, len(rows), BLOCK_ROWS):
                if n + len(rows[a:a + BLOCK_ROWS]) > BLOCK_ROWS:
                    yield flush()
                    held, n = [], 0
                held.append((ids[a:a + BLOCK_ROWS], known[a:a + BLOCK_ROWS], integers[a:a + BLOCK_ROWS]))
                n += len(held[-1][0])
        if n:
            yield flush()
    typed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return scratch.save(typed.mapInArrow(run, BLOCK), "blocks")


def first_centroids(vectors: DataFrame, k: int, dims: int, scale: float, seed: int) -> list[list[int]]:
    """The k kept vectors with the smallest hashes of their ids, in that order: a bounded top-k."""
    components = F.col("embedding").cast("array<double>")
    integers = F.transform(components, lambda x: F.floor(x * scale))
    kept = vectors.where((F.size(components) == dims) & F.forall(components, lambda x: F.coalesce(F.floor(x * scale).between(1 - LARGEST, LARGEST - 1), F.lit(False)) & ~F.isnan(x)))
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    top = kept.select(draw.alias("draw"), integers.alias("integers")).orderBy(F.asc_nulls_last("draw"), "integers").limit(k)
    return [[int(x) for x in r["integers"]] for r in top.collect()]


def moved(blocks: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Every centroid at the floor of its rows' mean; one without rows stays."""
    k, at = len(centroids), np.array(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(at.shape, np.int64), np.zeros(k, np.int64)
        for block in blocks_of(batches):
            nearest, _ = block.assign(at)
            total += block.sums(nearest, k)
            count += np.bincount(nearest, minlength=k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(count), pa.array(list(total), pa.list_(pa.int64()))], names=["cluster", "count", "total"])
    parts = blocks.mapInArrow(run, "cluster int, count long, total array<long>").select("cluster", "count", F.posexplode("total").alias("dim", "part"))
    found = parts.groupBy("cluster", "dim").agg(F.sum("count").alias("count"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()  # k * dims rows
    out = [list(c) for c in centroids]
    for r in found:
        if r["count"]:
            out[r["cluster"]][r["dim"]] = int(r["total"]) // r["count"]
    return out


def assigned(blocks: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance) of every row."""
    at = np.array(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_of(batches):
            nearest, distance = block.assign(at)
            yield pa.RecordBatch.from_arrays([pa.array(block.ids, mask=~block.known), pa.array(nearest, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])
    return blocks.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 40, dims: int = 64, rounds: int = 5, scale: float = 256.0, seed: int = 2) -> tuple[DataFrame, list[list[int]]]:
    """vectors(vec_id, embedding) -> ((vec_id, cluster, distance), centroids)."""
    scratch = Scratch(vectors.sparkSession, "centroids")
    blocks = encode(vectors, dims, scale, scratch)
    small_batches(vectors.sparkSession, 8)  # a block is a row of a megabyte or two
    centroids = first_centroids(vectors, k, dims, scale, seed)
    for _ in range(rounds if centroids else 0):
        centroids = moved(blocks, centroids)
    if not centroids:
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), []
    rows = scratch.save(assigned(blocks, centroids), "assigned")
    small_batches(vectors.sparkSession)
    return rows, centroids


def with_inertia(spark: SparkSession, rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """rows(vec_id, cluster, distance) with their cluster's and the whole inertia and a digest of the centroid."""
    own = {r["cluster"]: int(r["inertia"]) for r in rows.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # a row for each centroid
    about = [(c, own.get(c, 0), sum(own.values()), hashlib.sha256(",".join(map(str, at)).encode()).hexdigest()) for c, at in enumerate(centroids)]
    table = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
