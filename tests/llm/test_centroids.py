import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from postings_engine.llm import centroids as module
from postings_engine.llm.centroids import cluster, with_inertia

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       *(T.StructField(c, T.StringType()) for c in ("ids", "codes", "cluster", "distance", "draw", "label"))])


def plain(rows, k, dims, rounds, seed=2):
    """Rounds of assignment and floored means in plain integers."""
    kept = []
    for vec_id, x in rows:
        if x is not None and len(x) == dims and all(c is not None and math.isfinite(c) for c in x):
            ints = [math.floor(256 * float(np.float32(c))) for c in x]
            if all(abs(i) < module.LARGEST for i in ints):
                kept.append((vec_id, ints))

    def draw(row):
        return (row[0] is None, hashlib.sha256(f"{seed}:{row[0]}".encode()).hexdigest(), row[1])
    at = [x for _, x in sorted(kept, key=draw)[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), i) for i, c in enumerate(at))
    for _ in range(rounds):
        own = [[] for _ in at]
        for _, x in kept:
            own[nearest(x)[1]].append(x)
        at = [[sum(col) // len(xs) for col in zip(*xs)] if xs else c for xs, c in zip(own, at)]
    found = [(i, *nearest(x)[::-1]) for i, x in kept]
    return [(i, c, d, sum(e for _, b, e in found if b == c), sum(e for _, _, e in found), hashlib.sha256(",".join(map(str, at[c])).encode()).hexdigest()) for i, c, d in found]


def table(spark, rows):
    return spark.createDataFrame([(i, x, *["x"] * 6) for i, x in rows], SCHEMA)


def check(spark, rows, k, dims, rounds):
    got, at = cluster(table(spark, rows), k, dims, rounds)
    assert sorted(map(str, map(tuple, with_inertia(spark, got, at).collect()))) == sorted(map(str, plain(rows, k, dims, rounds)))


@pytest.mark.parametrize("block", [7, 4096])
def test_equals_plain_rounds(spark, monkeypatch, block):
    monkeypatch.setattr(module, "BLOCK_ROWS", block)
    rng = random.Random(block)
    rows = [(i, [rng.gauss(i % 4, 0.5) for _ in range(6)]) for i in range(120)]
    rows += [(200 + i, [0.25] * 6) for i in range(60)]  # a third are equal
    rows += [(3, rows[3][1]), (None, [0.1] * 6), (None, [0.1] * 6)]
    check(spark, rows, 9, 6, 5)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0, 2.0]), (4, [1.0, None, 2.0]), (5, [nan, 0.0, 0.0]), (6, [inf, 0.0, 0.0]), (7, [-inf, 0.0, 0.0]), (8, [3e38, 0.0, 0.0]), (9, [-3e38, 0.0, 0.0]),
            (10, [-0.001, 0.0, 0.001]), (11, [-0.001, 0.0, 0.001]), (12, [0.0, 0.0, 0.0]), (13, [524287.0, -524287.0, 0.0]), (14, [1.0, 1.0, 1.0, 1.0])]
    check(spark, rows, 3, 3, 2)
    check(spark, rows, 40, 3, 5)  # fewer rows than centroids
    check(spark, rows[:9], 3, 3, 2)
    check(spark, [], 3, 3, 2)
