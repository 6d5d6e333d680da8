"""Embedding near-duplicates by product quantisation, with exact cosines.

Equal vectors are one weighted point. Points go to the inverted list of their nearest coarse
centroid; what is left of them is coded by subspace. A query visits the lists of its nearest
centroids, as many as a test needs: pairs with exactly the wanted cosine are made from sampled points
and random directions, and the number of probes is the least that reaches the second point's list in
PROBED of them. In a list, table look-ups give the distance of the query to each point's code; as the
true distance differs from it by at most the code's own error, kept with the point, the look-ups lose
no point within reach. What remains is compared by cosine in double precision. Only the fit uses a
sample; every point is indexed and every point is a query.

Lists are cut into chunks of bounded size, and so are the queries of a list. A chunk gives each
query's number of links and a spanning forest of the links, never the pairs.

Defined cases. A vector that is null, empty or zero, or holds a null or a non-finite number, links
with nothing, and so does one with a null vec_id. Vectors of different lengths don't link. Rows
with equal vectors count as others of each other. Different vectors under one vec_id are one node: its
links add up and none is within it. Only vec_id and embedding are read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import components

#: Points of a list on average, and the most lists that are fitted.
LIST_SIZE, MOST_LISTS = 1024, 4096
#: The fit reads about this many points for each list, LEAST_SAMPLE at least.
SAMPLE_PER_LIST, LEAST_SAMPLE = 16, 4096
#: Share of pairs at the border whose list the probes must reach.
PROBED = 0.999
SUB_WIDTH, SUB_CODES, ROUNDS = 4, 64, 8
CHUNK, QUERIES = 4096, 16384
#: Queries that are compared with a chunk at once.
BLOCK = 256
POINTS = pa.schema([("list", pa.int32()), ("role", pa.int32()), ("id", pa.int64()), ("weight", pa.int64()), ("vector", pa.binary()), ("codes", pa.binary()), ("shift", pa.float64()), ("error", pa.float64())])


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (centres**2).sum(axis=1) / 2
    for lo in range(0, len(x), 8192):
        out[lo: lo + 8192] = (half - x[lo: lo + 8192] @ centres.T).argmin(axis=1)
    return out


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None] - 2 * x @ centres.T


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        of = _nearest(x, centres)
        order = np.argsort(of, kind="stable")
        n = np.bincount(of, minlength=len(centres))
        full = n > 0
        centres[full] = np.add.reduceat(x[order], (np.cumsum(n) - n)[full], axis=0) / n[full, None]
    return centres


@dataclass
class Quantiser:
    """Coarse centroids and, for each subspace, the codes of residuals. Widths are padded with zeros."""
    coarse: np.ndarray
    sub: np.ndarray  # subspace, code, coordinate
    reach: float
    n_probes: int

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, cosine: float, width: int, seed: int = 0) -> Quantiser:
        rng = np.random.default_rng(seed)
        coarse = k_means(x, min(lists, len(x)), rng)
        rest = (x - coarse[_nearest(x, coarse)]).reshape(len(x), -1, SUB_WIDTH)
        sub = [k_means(np.ascontiguousarray(rest[:, m]), min(SUB_CODES, len(x)), rng) for m in range(rest.shape[1])]
        # pairs at the border, in the coordinates that vectors have
        x = x[:LEAST_SAMPLE]
        other = np.zeros_like(x)
        other[:, :width] = rng.normal(size=(len(x), width))
        other -= (other * x).sum(axis=1, keepdims=True) * x
        norm = np.sqrt((other**2).sum(axis=1, keepdims=True))
        other = cosine * x + (1 - cosine**2) ** 0.5 * other / np.maximum(norm, 1e-300)
        far = _squares(x, coarse)
        rank = (far < far[np.arange(len(x)), _nearest(other, coarse)][:, None]).sum(axis=1)
        n_probes = 1 + int(np.quantile(rank, PROBED, method="higher"))
        return cls(coarse, np.array(sub), (2 - 2 * cosine) ** 0.5 + 1e-6, n_probes)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, shift, error): error is the distance of each point to its code."""
        of = _nearest(x, self.coarse)
        rest = (x - self.coarse[of]).reshape(len(x), -1, SUB_WIDTH)
        codes = np.stack([_nearest(np.ascontiguousarray(rest[:, m]), self.sub[m]) for m in range(rest.shape[1])], axis=1).astype(np.uint8)
        back = np.stack([self.sub[m][codes[:, m]] for m in range(rest.shape[1])], axis=1)
        error = np.sqrt(((rest - back) ** 2).sum(axis=(1, 2)))
        flat = back.reshape(len(x), -1)
        shift = 2 * (self.coarse[of] * flat).sum(axis=1) + (flat**2).sum(axis=1)
        return of, codes, shift, error

    def probes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the lists that each query visits."""
        n = min(self.n_probes, len(self.coarse))
        lists = np.argpartition(_squares(x, self.coarse), n - 1, axis=1)[:, :n]
        return np.repeat(np.arange(len(x)), n), lists.ravel()

    def distances(self, x: np.ndarray, at: int, codes: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """Squared distances of queries x to the coded points of list `at`, by table look-up."""
        parts = x.reshape(len(x), -1, SUB_WIDTH)
        dots = np.zeros((len(x), len(codes)), np.float32)
        for m in range(parts.shape[1]):
            table = (parts[:, m] @ self.sub[m].T).astype(np.float32)
            dots += table[:, codes[:, m]]
        return ((x - self.coarse[at]) ** 2).sum(axis=1)[:, None] + shift[None] - 2 * dots


def _unit(raw: pa.Array, width: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw.to_pylist()), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square over- or underflows
    x /= np.sqrt((x**2).sum(axis=1, keepdims=True))
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def keyed(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, k1, k2): two hashes of a usable vector, null for any other."""
    number = F.col("embedding").cast("array<double>")
    bad = F.exists(number, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & ~bad & F.exists(number, lambda v: v != 0), F.lit(False))
    return vectors.select("vec_id", number.alias("embedding")).withColumns({"k1": F.when(usable, F.xxhash64(number)), "k2": F.when(usable, F.hash(number))})


def points_of(rows: DataFrame) -> DataFrame:
    """(k1, k2, vector, size, id, weight): the distinct usable vectors of keyed rows as bytes of
    doubles, the smallest vec_id and the number of rows of each."""
    equal = rows.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.any_value("embedding").alias("embedding"), F.min("vec_id").alias("id"), F.count("*").alias("weight"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            raw = [np.array(v, np.float64).tobytes() for v in rows.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(raw, pa.binary()), pa.array([len(r) // 8 for r in raw], pa.int32()), rows.column(3), rows.column(4)], names=["k1", "k2", "vector", "size", "id", "weight"])
    return equal.mapInArrow(run, "k1 long, k2 int, vector binary, size int, id long, weight long")


def _roles(points: DataFrame, quantiser, width: int) -> DataFrame:
    """Each point as a member (role 0) of its list and as a query (role 1) of the lists in reach."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = quantiser.value
        for rows in batches:
            for lo in range(0, rows.num_rows, 1024):
                part = rows.slice(lo, 1024)
                x = _unit(part.column(0), width)
                of, codes, shift, error = q.encode(x)
                n, raw = len(x), x.tobytes()
                own = [raw[i * 8 * width: (i + 1) * 8 * width] for i in range(n)]
                weight, ids = part.column(3), part.column(2)
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(np.zeros(n), pa.int32()), ids, weight, pa.array(own, pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(shift), pa.array(error)], schema=POINTS)
                row, at = q.probes(x)
                none = pa.nulls(len(row), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.ones(len(row)), pa.int32()), ids.take(pa.array(row)), weight.take(pa.array(row)), pa.array([own[i] for i in row], pa.binary()), none, pa.array(np.zeros(len(row))), pa.array(np.zeros(len(row)))], schema=POINTS)
    return points.select("vector", "size", "id", "weight").mapInArrow(run, "list int, role int, id long, weight long, vector binary, codes binary, shift double, error double")


FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def _compare(tiles: DataFrame, quantiser, width: int, cosine: float) -> DataFrame:
    """tiles(tile, list, role, ...) -> (a, b, links): rows with b null give a's number of linked rows in
    the tile, rows with b a link of the tile's spanning forest. Rows are streamed by tile, members first."""
    def close(q, at, members, queries):
        ids, weights, x, codes, shift, error = members
        if not len(ids) or not queries:
            return None
        qid = np.array([r[0] for r in queries])
        qx = np.frombuffer(b"".join(r[1] for r in queries), np.float64).reshape(len(queries), width)
        near = q.distances(qx, at, codes, shift) <= ((q.reach + error) ** 2 * (1 + 1e-5) + 1e-5)[None]
        near &= qid[:, None] != ids[None]
        i, j = np.nonzero(near)
        linked = np.empty(len(i), bool)
        for lo in range(0, len(i), 1 << 16):
            linked[lo: lo + (1 << 16)] = np.einsum("ij,ij->i", qx[i[lo: lo + (1 << 16)]], x[j[lo: lo + (1 << 16)]]) >= cosine
        return qid, i[linked], j[linked], weights

    def emit(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], schema=FOUND)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = quantiser.value
        tile, at, held, queries, members, label = None, 0, [], [], None, None

        def ready():
            ids = np.array([r[0] for r in held], np.int64)
            x = np.frombuffer(b"".join(r[2] for r in held), np.float64).reshape(len(held), width)
            codes = np.frombuffer(b"".join(r[3] for r in held), np.uint8).reshape(len(held), -1)
            return (ids, np.array([r[1] for r in held], np.int64), x, codes, np.array([r[4] for r in held]), np.array([r[5] for r in held])), np.arange(len(held))

        def work():
            out = []
            got = close(q, at, members, queries)
            if got is not None and len(got[1]):
                qid, i, j, weights = got
                first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
                for a, b in zip(first, [*first[1:], len(i)]):
                    js = j[a:b]
                    out.append((int(qid[i[a]]), None, int(weights[js].sum())))
                    out.append((int(qid[i[a]]), int(members[0][js[0]]), 0))
                    of = np.unique(label[js])
                    if len(of) > 1:
                        label[np.isin(label, of)] = of[0]
            return out

        def finish():
            # members that a common query links: each with one of its kind
            return [(int(members[0][k]), int(members[0][label[k]]), 0) for k in np.flatnonzero(label != np.arange(len(label)))] if members is not None else []

        for rows in batches:
            out = []
            for t, of, role, key, weight, vector, codes, shift, error in zip(*(c.to_pylist() for c in rows.columns)):
                if t != tile:
                    if members is not None:
                        out += work() + finish()
                    tile, at, held, queries, members, label = t, of, [], [], None, None
                if role == 0:
                    held.append((key, weight, vector, codes, shift, error))
                    continue
                if members is None:
                    members, label = ready()
                queries.append((key, vector))
                if len(queries) == BLOCK:
                    out += work()
                    queries = []
            if out:
                yield emit(out)
        if members is not None and (out := work() + finish()):
            yield emit(out)

    ordered = tiles.select("tile", "list", "role", "id", "weight", "vector", "codes", "shift", "error").repartition("tile").sortWithinPartitions("tile", "role")
    return ordered.mapInArrow(stream, "a long, b long, links long")


def _tiles(roles: DataFrame) -> DataFrame:
    """Cuts each list into chunks of members and groups of queries; a tile is one of each."""
    sizes = roles.groupBy("list").agg(F.ceil(F.sum(F.when(F.col("role") == 0, 1)) / CHUNK).alias("chunks"), F.ceil(F.sum("role") / QUERIES).alias("groups")).where("chunks > 0")
    rows = roles.join(sizes, "list")
    chunk, group = F.pmod(F.xxhash64("id"), F.col("chunks")), F.pmod(F.xxhash64("id"), F.greatest("groups", F.lit(1)))
    own = F.when(F.col("role") == 0, chunk).otherwise(group)
    others = F.sequence(F.lit(0).cast("long"), F.when(F.col("role") == 0, F.greatest("groups", F.lit(1))).otherwise(F.col("chunks")) - 1)
    spread = rows.withColumn("own", own).withColumn("other", F.explode(others))
    key = F.when(F.col("role") == 0, F.xxhash64("list", "own", "other")).otherwise(F.xxhash64("list", "other", "own"))
    return spread.withColumn("tile", key)


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, seed: int = 0) -> DataFrame:
    """vectors(vec_id, embedding) -> (vec_id, n_links, component_id, kept), a row for each row. Two
    vectors link if their cosine is at least `cosine` (above 0) and a probe meets them."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "embeddings")
    rows = keyed(vectors)
    points = scratch.save(points_of(rows), "points")
    parts = []
    for size, n in [(r["size"], r["n"]) for r in points.groupBy("size").agg(F.count("*").alias("n")).collect()]:
        width = -(-size // SUB_WIDTH) * SUB_WIDTH
        lists = max(1, min(MOST_LISTS, n // LIST_SIZE))
        own = points.where(F.col("size") == size)
        share = min(1.0, max(LEAST_SAMPLE, SAMPLE_PER_LIST * lists) / n)
        raw = own.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < max(1, int(share * (1 << 20)))).select("vector").toArrow()["vector"].combine_chunks()
        if not len(raw):
            raw = own.select("vector").limit(1).toArrow()["vector"].combine_chunks()
        quantiser = spark.sparkContext.broadcast(Quantiser.fit(_unit(raw, width), lists, cosine, size, seed))
        roles = scratch.save(_roles(own, quantiser, width), "roles")
        parts.append(scratch.save(_compare(_tiles(roles), quantiser, width, cosine), "found"))
    found = parts[0] if parts else spark.createDataFrame([], "a long, b long, links long")
    for more in parts[1:]:
        found = found.unionByName(more)
    # links of a point with other points, and the component of the smallest ids of points
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("others"))
    reached = components(found.where("b IS NOT NULL").select("a", "b"), scratch).select(F.col("node").alias("id"), "component")
    known = points.select("k1", "k2", "id", "weight").join(counts, "id", "left").join(reached, "id", "left").where("weight > 1 OR others IS NOT NULL")
    return rows.select("vec_id", "k1", "k2").join(known, ["k1", "k2"], "left").select(
        "vec_id", (F.coalesce("others", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1).cast("long").alias("n_links"),
        F.coalesce("component", "id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
